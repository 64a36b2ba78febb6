"""URL filter: a blocked Bloom filter in front of an exact hash join.

Every list entry is a canonical URL (host and path, without scheme, query and fragment). A rule entry fits its
host, all subdomains, and every path that starts with its own; a listed URL fits itself alone. For each url the
keys that could be listed are formed (each suffix of the host with each path prefix of a length that some rule
has, and the whole canonical URL), a split-block Bloom filter built from the list drops nearly all of them, and
the rest meet the list in an exact join, which removes the filter's false positives.

The list may be of any length: it is joined by a shuffle on the whole URL, whose keys are single documents' addresses.
A rule's key, such as a top-level domain, may fit a third of all urls, so beyond broadcast_entries rules the join is
salted: each rule is repeated for each of `salts` numbers, and each url has one of them.

Only SQL functions are used. The filter's size is bounded (max_blocks blocks of 256 bits): a longer list raises
the share of false positives, never the result. It reaches the executors as a broadcast table of at most max_blocks rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.batches import numbered
from sparkloom.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where '://' is missing."""
    at = F.instr(url, F.lit("://"))
    rest = F.substr(url, at + 3)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    ok = F.coalesce(at > 0, F.lit(False))
    return (
        F.when(ok, F.translate(host, UPPER, LOWER)).otherwise(""),
        F.when(ok, path).otherwise(""),
    )


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (host, path, 'allow' or 'block')."""
    return spark.createDataFrame(rules, "host string, path string, action string")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key), 32), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    """The mask of the one bit that key sets in a word of its block."""
    h = F.xxhash64(key, F.lit(1))
    place = F.pmod(F.shiftrightunsigned(h, 5 * word), F.lit(32)).cast("int")
    return F.call_function("shiftleft", F.lit(1), place)


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table: block, and its eight 32-bit words w0 to w7. keys has a column key."""
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(
        *[F.bit_or(_bit(F.col("key"), w)).alias(f"w{w}") for w in range(8)]
    )


def _passed(keys: DataFrame, filter_table: DataFrame, blocks: int) -> DataFrame:
    """The rows of keys whose key the filter may hold; the filter has at most `blocks` rows and is broadcast."""
    test = F.lit(True)
    for w in range(8):
        test = test & (F.col(f"w{w}").bitwiseAND(_bit(F.col("key"), w)) != 0)
    return (
        keys.withColumn("block", _block(F.col("key"), blocks))
        .join(F.broadcast(filter_table), "block")
        .where(test)
        .select(*keys.columns)
    )


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    listed: DataFrame | None = None,
    url: str = "url",
    max_blocks: int = 1 << 18,
    broadcast_entries: int = 100_000,
    salts: int = 64,
    page_id: str = "page_id",
) -> DataFrame:
    """pages with host, path, rule and verdict added (columns of these names in pages are replaced; others, of any
    name, pass through).

    rules: (host, path, action); of the rules that fit, the longest wins (then the longest host, then 'allow').
    listed: column url; without a fitting rule a url whose canonical form is listed is blocked, any other allowed.
    Null or unparsable urls have an empty host and path, no rule, and are allowed unless an empty canonical url is
    listed. Repeated rows stay repeated. Rules with a null field are ignored. An empty list allows everything.
    """
    source = numbered(pages, page_id)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "_rid")]
    host, path = canonical(F.col(f"`{url}`"))
    entries = rules.dropna(subset=["host", "path", "action"]).select(
        F.concat(F.lit("p:"), F.translate("host", UPPER, LOWER), "path").alias("key"),
        F.struct(
            F.length(F.concat("host", "path")).alias("n"),
            F.length("host").alias("hn"),
            F.when(F.col("action") == "allow", 1).otherwise(0).alias("allow"),
            F.concat(F.translate("host", UPPER, LOWER), "path").alias("rule"),
            F.col("action").alias("action"),
        ).alias("hit"),
        F.length("path").alias("path_length"),
    )
    lengths = [r[0] for r in entries.select("path_length").distinct().collect()]  # no more than a rule's path has characters
    entries = written(entries.groupBy("key").agg(F.max("hit").alias("hit")), "rules")
    n_rules = n_listed = entries.count()
    exact = entries.select("key").where(F.lit(False))
    if listed is not None:
        h, p = canonical(F.col("url"))
        exact = written(listed.select(F.concat(F.lit("u:"), h, p).alias("key")).distinct(), "listed")
        n_listed = exact.count()
    blocks = 1
    while blocks < max_blocks and blocks * 16 < n_rules + n_listed:
        blocks *= 2
    bloom = written(bloom_blocks(entries.select("key").unionByName(exact), blocks), "bloom")

    held = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("in") if kept else F.struct(F.lit(1)).alias("in")
    rows = source.select(held, "_rid", host.alias("host"), path.alias("path"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)]) if lengths else F.array().cast("array<string>")
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(prefixes, lambda p: p.isNotNull()), lambda p: F.concat(F.lit("p:"), s, p))))
    if listed is not None:
        keys = F.concat(keys, F.array(F.concat(F.lit("u:"), F.col("host"), F.col("path"))))
    hits = _passed(rows.select("_rid", F.explode(keys).alias("key")), bloom, blocks)
    if n_rules <= broadcast_entries:
        ruled = hits.join(F.broadcast(entries), "key")
    else:
        salted = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        ruled = hits.withColumn("salt", F.pmod(F.xxhash64("_rid"), F.lit(salts)).cast("int")).join(salted, ["key", "salt"])
    best = ruled.groupBy("_rid").agg(F.max("hit").alias("hit"))
    found = rows.join(best, "_rid", "left")
    block = F.lit(False)
    if listed is not None:
        wanted = hits.where(F.col("key").startswith("u:"))
        wanted = wanted.join(F.broadcast(exact) if n_listed <= broadcast_entries else exact, "key", "left_semi")
        found = found.join(wanted.select("_rid", F.lit(True).alias("is_listed")), "_rid", "left")
        block = F.coalesce("is_listed", F.lit(False))
    verdict = F.coalesce("hit.action", F.when(block, "block").otherwise("allow")).alias("verdict")
    return found.select(*[F.col("in").getField(c).alias(c) for c in kept], "host", "path", F.col("hit.rule").alias("rule"), verdict)
