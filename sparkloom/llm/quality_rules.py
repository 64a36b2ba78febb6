"""Quality rules: repetition counts of each document, and how often its lines recur across a host's documents.

Cross-document part: each line is normalised (A-Z lower-cased, runs of digits made one 0, runs of white space one
space, trimmed) and hashed; for each host the distinct documents of a line are counted; a line of more than
max_line_docs documents is boilerplate and removed from the text; a document of which less than min_left_percent of
the words remain is depleted and rejected. Documents of one host are distinct when their texts as given differ: a
family of exact copies counts once and does not turn its own text into boilerplate, whatever its size; near copies, and
pages of a template that differ in numbers, case or white space only, count each.

Only SQL functions are used. The per-document part works inside the row. The cross-document part reads the texts once
and writes one narrow row for each line (the hashes of line and document, place and words), which is counted,
pre-aggregated, and read again for the verdict; texts are not shuffled. Lines above the limit are broadcast where they
are broadcast_lines at most, and joined by a shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.batches import numbered
from sparkloom.session import discard, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def normalised_lines(text: Column) -> Column:
    """All lines of a text, normalised; blank ones are empty strings. The whole text is rewritten before it is split."""
    text = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[0-9]+", "0")
    return F.split(F.trim(F.regexp_replace(text, "[\\x20\\x09\\x0B-\\x0D]+", " ")), " ?\\n ?")


def _repeated(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with _words, and drops _words.

    The hash of each 3-word window and its place are packed in one long (44 and 20 bits) and sorted; windows equal
    to a neighbour in that order are repeated. The full hashes decide equality. A document of 2^20 words or more, or
    one where two unequal windows agree in their 44 bits, sorts pairs of full hash and place instead.
    """
    low = (1 << 20) - 1
    n = F.size("_words")
    windows = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    word = lambda i: F.element_at(F.col("_words"), i)
    docs = docs.withColumn("_h", F.transform(windows, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))))
    docs = docs.withColumn("_packed", F.when(n < low, F.transform("_h", lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))))
    docs = docs.withColumn("_sorted", F.sort_array("_packed"))
    m = F.size("_sorted")
    place = lambda x: F.element_at(F.col("_h"), (x.bitwiseAND(F.lit(low)) + 1).cast("int"))
    # for each pair of neighbours: 0 unequal, 1 equal, 2 equal in 44 bits only
    docs = docs.withColumn(
        "_same",
        F.when(
            m >= 2,
            F.zip_with(
                F.slice("_sorted", 1, m - 1),
                F.slice("_sorted", 2, m - 1),
                lambda a, b: F.when(a.bitwiseXOR(b) > low, 0).when(a.bitwiseXOR(b) < 0, 0).when(place(a) == place(b), 1).otherwise(2),
            ),
        ).otherwise(F.array().cast("array<int>")),
    )
    quick = F.filter(
        F.transform("_sorted", lambda x, i: F.when((F.get("_same", i) == 1) | (F.get("_same", i - 1) == 1), x.bitwiseAND(F.lit(low)))),
        lambda x: x.isNotNull(),
    )
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    slow = F.element_at(
        F.transform(
            F.array(pairs),
            lambda s: F.filter(
                F.transform(s, lambda x, i: F.when((F.get(s, i + 1)["h"] == x["h"]) | (F.get(s, i - 1)["h"] == x["h"]), x["i"])),
                lambda x: x.isNotNull(),
            ),
        ),
        1,
    )
    exact = (n < low) & ~F.array_contains("_same", 2)
    none = F.array().cast("array<long>")
    docs = docs.withColumn(
        "_at", F.when(exact & ~F.array_contains("_same", 1), none).when(exact, F.sort_array(quick)).otherwise(F.sort_array(slow))
    ).drop("_h", "_packed", "_sorted", "_same", "_words")
    k = F.size("_at")
    steps = F.zip_with(F.slice("_at", 1, k - 1), F.slice("_at", 2, k - 1), lambda a, b: F.least(b - a, F.lit(3)))
    return docs.withColumn(
        "n_repeat_words", F.when(k == 0, F.lit(0)).when(k == 1, F.lit(3)).otherwise(F.aggregate(steps, F.lit(3).cast("long"), lambda s, x: s + x)).cast("long")
    ).drop("_at")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _measured(rows: DataFrame, text: str) -> DataFrame:
    """rows (with `in`, a struct that holds the text) with the measures."""
    whole = F.coalesce(F.col("in").getField(text), F.lit(""))
    out = rows.withColumns(
        {
            "_words": words(whole),
            "word_chars": F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
            "_lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        }
    )
    out = out.withColumns({"n_words": F.size("_words").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")}).drop("_lines")
    out = _repeated(out)
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _held(docs: DataFrame, made: list[str], *others: str) -> tuple[DataFrame, list]:
    """docs with all its columns in the one struct `in`, so that none clashes with a column made here, and what gives
    them back but for those that a result replaces."""
    back = [F.col("in").getField(c).alias(c) for c in docs.columns if c not in made and c not in others]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in others]).alias("in"), *others), back


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; null text has no words."""
    rows, back = _held(docs, MEASURES)
    return _measured(rows, text).select(*back, *MEASURES)


def judged(
    docs: DataFrame,
    max_line_docs: int = 10,
    min_left_percent: int = 20,
    text: str = "text",
    host: str = "source",
    doc_id: str = "doc_id",
    broadcast_lines: int = 1_000_000,
) -> DataFrame:
    """docs with the measures, kept, and the text without its boilerplate lines; the measures are those of the text as given.

    Other lines stay as they are, with blank ones and the order. A null host is a host of its own. Null and empty texts
    have no lines and fail the base rules. Repeated rows and equal ids are judged each by itself. An empty table gives an
    empty one. Columns of docs with the names of results are replaced; others of any name pass through.
    """
    source = numbered(docs, doc_id)
    norm = source.select("_rid", F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("")).alias("_host"), F.xxhash64(text).alias("_doc"), normalised_lines(F.col(text)).alias("_norm"))
    lines = (
        norm.select("_rid", "_host", "_doc", F.posexplode("_norm").alias("_at", "_line"))
        .where("_line <> ''")
        .select(
            "_rid",
            "_doc",
            "_at",
            F.xxhash64("_host", "_line").alias("_key"),
            (F.length("_line") - F.length(F.translate("_line", " ", "")) + 1).cast("long").alias("_n"),
        )
    )
    lines = written(lines, "lines")
    often = lines.groupBy("_key", "_doc").agg(F.lit(1).alias("x")).groupBy("_key").count().where(F.col("count") > max_line_docs).select("_key")
    often = written(often, "often")
    few = often.count() <= broadcast_lines
    removed = lines.join(F.broadcast(often) if few else often, "_key", "left_semi").groupBy("_rid").agg(F.sum("_n").alias("_removed"), F.collect_list("_at").alias("_gone"))
    removed = written(removed, "removed")
    discard(lines, often)
    left = F.col("n_words") - F.coalesce("_removed", F.lit(0))
    whole = F.col("in").getField(text)
    # the lines are bound once, by a list of one, and not split anew for each line that stays
    rest = F.transform(
        F.array(F.split(whole, "\n")), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "_gone"), lambda i: F.get(x, i)), "\n")
    )
    rows, back = _held(source, [*MEASURES, "kept", text], "_rid")
    out = (
        _measured(rows, text)
        .join(F.broadcast(removed) if removed.count() <= broadcast_lines else removed, "_rid", "left")
        .withColumn("_left", F.when(F.col("_gone").isNull(), whole).otherwise(F.element_at(rest, 1)))
        # one CASE, not a conjunction: a filter on it stays above the join and is not copied down into the measures
        .withColumn("kept", F.when(F.col("base_failed"), False).otherwise(~(100 * left < min_left_percent * F.col("n_words"))))
        .select(*back, F.col("_left").alias(text), *MEASURES, "kept")
    )
    order = [c for c in docs.columns if c not in (*MEASURES, "kept", "_rid")]
    return out.select(*order, *MEASURES, "kept")
