"""Benchmark decontamination: which words of a document lie in an occurrence of a benchmark item's window.

A prefix-filtered set join, in SQL functions only. A window (a run of `window` item words) is the set of its
placed shingles of `shingle` words. The corpus is read once for all document shingles that occur in some window; their
document frequencies over the whole corpus order the shingles of each window by rarity. An exact containment
needs every shingle of the window, so its necessary prefix is the rarest one alone: only occurrences of that one
become candidates (document, window, start). The start is bounded by position and length (it may not precede the
text or leave too few words), and a candidate is verified by comparing the window's words with the document's at that
place, so agreeing hashes never make a hit.

The benchmark side is broadcast where its windows number at most broadcast_windows, and joined by a shuffle beyond; so
are the documents with candidates, up to broadcast_docs. Document rows that cross the network are one narrow row for
each shingle that occurs in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.batches import numbered
from sparkloom.session import discard, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z lower-cased; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


def _grams(array: str, q: int) -> Column:
    """The hash of each run of q words."""
    at = F.when(F.size(array) >= q, F.sequence(F.lit(1), F.size(array) - (q - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(q), *[F.element_at(F.col(array), i + j) for j in range(q)]))


def item_windows(items: DataFrame, window: int = 10, shingle: int = 5, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each distinct window: w (its number, new at each reading), size in words, shingles (hashes by place), q, ws, items."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1)))
    w = w.select("item", F.explode(F.transform(at, lambda i: F.slice("ws", i, window))).alias("ws"))
    q = F.least(F.size("ws"), F.lit(shingle))
    parts = F.coalesce(*[F.when(q == n, _grams("ws", n)) for n in range(1, shingle + 1)])
    return (
        w.withColumn("q", q)
        .groupBy("ws", "q")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select(F.monotonically_increasing_id().alias("w"), F.size("ws").alias("size"), "q", parts.alias("shingles"), "ws", "items")
    )


def hits(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    shingle: int = 5,
    broadcast_windows: int = 200_000,
    broadcast_docs: int = 1_000_000,
    text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """The occurrences (_rid, start, size, w, items) in docs, rows with a column _rid that tells them apart.

    start counts words from 0. Null and empty texts have no words. Items without words have no window; items with a
    null id count in the words hit, but have no id to report.
    """
    # written once: the windows are read several times and must not change between them
    grams = written(item_windows(items, window, shingle, item_id).select("*", F.size("shingles").alias("n")), "windows")
    small = grams.count() <= broadcast_windows
    hint = F.broadcast if small else (lambda df: df)
    lengths = sorted(r.q for r in grams.select("q").distinct().collect())  # at most `shingle` of them

    rows = docs.select("_rid", words(F.col(text)).alias("_ws")).withColumn("n_words", F.size("_ws"))  # before the rows are multiplied
    if not lengths:
        return grams.select(F.lit(0).cast("long").alias("_rid"), F.lit(0).alias("start"), "size", "w", "items").where(F.lit(False))
    wanted = hint(grams.select(F.explode("shingles").alias("s")).distinct())
    found = None
    for q in lengths:
        part = rows.select("_rid", "n_words", F.posexplode(_grams("_ws", q)).alias("pos", "s"))
        found = part if found is None else found.unionByName(part)
    found = written(found.join(wanted, "s", "left_semi"), "shingles")

    rarity = found.groupBy("s", "_rid").agg(F.lit(1).alias("x")).groupBy("s").agg(F.count("*").alias("df"))
    placed = grams.select("w", "size", "n", F.posexplode("shingles").alias("off", "s"))
    prefix = (
        placed.join(rarity, "s")
        .groupBy("w", "size", "n")
        .agg(F.min(F.struct("df", "s", "off")).alias("least"), F.count("*").alias("present"))
        .where(F.col("present") == F.col("n"))
        .select("w", "size", F.col("least.s").alias("s"), F.col("least.off").alias("off"))
    )
    start = F.col("pos") - F.col("off")
    candidates = (
        found.join(hint(prefix), "s")
        .where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        .groupBy("_rid")
        .agg(F.collect_set(F.struct(start.alias("start"), "w")).alias("c"))
    )
    candidates = written(candidates, "candidates")
    if candidates.count() <= broadcast_docs:
        candidates = F.broadcast(candidates)
    texts = docs.select("_rid", F.col(text).alias("_t")).join(candidates, "_rid")
    placed = texts.select("_rid", words(F.col("_t")).alias("_ws"), "c").select("_rid", "_ws", F.explode("c").alias("c"))
    slices = placed.select("_rid", "c.start", "c.w", F.slice("_ws", F.col("c.start") + 1, window).alias("_part"))
    same = F.slice("_part", 1, F.col("size")) == F.col("ws")
    occurrences = slices.join(hint(grams.select("w", "size", "ws", "items")), "w").where(same).select("_rid", "start", "size", "w", "items")
    occurrences = written(occurrences, "occurrences")
    discard(found)
    return occurrences


def judged(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """docs (without the text) with n_words, n_hit, items (sorted ids whose windows occur), spans of hit words.

    Columns of docs with the names of results are replaced; others, of any name, pass through.
    """
    made = ("n_words", "n_hit", "items", "spans", "_rid")
    text = options.get("text", "text")
    kept = [c for c in docs.columns if c not in made and c != text]
    rows = numbered(docs, doc_id)
    occurrences = hits(rows.select("_rid", text), items, **options)
    end = F.col("start") + F.col("size")
    before = Window.partitionBy("_rid").orderBy("start", "_end").rowsBetween(Window.unboundedPreceding, -1)
    runs = occurrences.groupBy("_rid", "start").agg(F.max(end).alias("_end"))  # equal starts before the window
    fresh = runs.withColumn("_seen", F.coalesce(F.max("_end").over(before), F.lit(0)))
    n_hit = fresh.groupBy("_rid").agg(
        F.sum(F.greatest(F.lit(0), F.col("_end") - F.greatest("start", "_seen"))).alias("n_hit"),
        F.sort_array(F.collect_list(F.struct("start", F.col("_end").alias("end")))).alias("spans"),
    )
    ids = occurrences.select("_rid", F.explode("items").alias("item")).groupBy("_rid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    held = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(1))
    out = rows.select(held.alias("in"), "_rid", F.size(words(F.col(text))).cast("long").alias("n_words"))
    return out.join(n_hit.join(ids, "_rid", "left"), "_rid", "left").select(
        *[F.col("in").getField(c).alias(c) for c in kept],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        "spans",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
