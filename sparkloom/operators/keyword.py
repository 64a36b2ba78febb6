"""BM25: statistics, postings, and scores of one or many queries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.scores import EMPTY_LENGTH, bm25_term, idf
from sparkloom.functions.text import tokens
from sparkloom.session import written

#: Bytes of texts whose tokens a task counts together.
HELD = 1 << 21
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WORDS = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def words(low: str) -> list[str]:
    """The tokens of a text that is lower-cased already. str.split() knows the same white space and four control
    characters more."""
    return _WORDS.findall(low) if _SEPARATORS.search(low) else low.split()


def postings(chunks: DataFrame, key: str, text: str, only: list[str] | None = None) -> DataFrame:
    """term, chunk key, tf, length in bytes: an inverted index to keep as a table; a query then reads its terms only.

    A row's tokens are counted where the row is, in Arrow batches, so nothing is shuffled; only rows whose key others
    share (one aggregation of the keys shows it) are summed after that. only: terms to which the index is limited, for one
    query without a stored index; other tokens do not leave the row.
    """
    low = F.lower(text)
    if only is not None:
        wanted = F.array(*map(F.lit, only)) if only else F.array().cast("array<string>")
        low = F.array_join(F.filter(tokens(F.col(text)), lambda t: F.array_contains(wanted, t)), " ")
    rows = chunks.select(F.col(key), F.octet_length(text).cast("double").alias("length"), low.alias("_t"))
    names = chunks.select(F.col(key).alias("_k"))
    shared = names.groupBy("_k").agg(F.count("*").alias("_n")).where("_n > 1").select("_k")
    if shared.isEmpty():
        return _runs(rows, key)
    same = F.col(key).eqNullSafe(F.col("_k"))
    summed = _runs(rows.join(shared, same, "left_semi"), key).groupBy("term", key).agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))
    return _runs(rows.join(shared, same, "left_anti"), key).unionByName(summed)


def _runs(rows: DataFrame, key: str) -> DataFrame:
    """term, key, tf, length for each different token of the lower-cased text _t of a row. The tokens of about HELD bytes
    are counted together and come out in order of term, of which a later sort by term makes long runs."""
    schema = T.StructType([T.StructField("term", T.StringType()), rows.schema[key], T.StructField("tf", T.LongType()), rows.schema["length"]])

    def counted(frame: pa.RecordBatch) -> pa.RecordBatch:
        found = [words(t) if t else [] for t in frame.column(2).to_pylist()]
        row = np.repeat(np.arange(len(found)), [len(x) for x in found])
        seen = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
        order = pc.sort_indices(seen.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        pairs, tf = np.unique(place[seen.indices.to_numpy()] * len(found) + row, return_counts=True)
        term, row = (pa.array(x) for x in np.divmod(pairs, len(found)))
        columns = [seen.dictionary.take(order).take(term), frame.column(0).take(row), pa.array(tf, pa.int64()), frame.column(1).take(row)]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
            cuts = [0, *(np.flatnonzero(np.diff(size // HELD)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield counted(batch.slice(a, b - a))

    return rows.select(key, "length", "_t").mapInArrow(run, schema)


def term_counts(index: DataFrame) -> DataFrame:
    """term, df of a postings table."""
    return index.groupBy("term").agg(F.count("*").alias("df"))


def lengths(chunks: DataFrame, text: str) -> DataFrame:
    """One row to be summed: n (chunks) and bytes."""
    return chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0)).alias("bytes"))


def query_terms(spark, query: str) -> list[str]:
    """The different tokens of a query."""
    return sorted(set(spark.range(1).select(tokens(F.lit(query)).alias("t")).first()[0]))


def corpus(chunks: DataFrame, text: str) -> DataFrame:
    """One row: n (chunks) and average (length in bytes; 500 without chunks)."""
    return chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text)) / F.nullif(F.count("*"), F.lit(0)), F.lit(EMPTY_LENGTH)).alias("average"))


def document_frequencies(index: DataFrame, total: DataFrame) -> DataFrame:
    """term, df, idf of a postings table; total is corpus()'s row."""
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(total), how="inner").select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def scores(index: DataFrame, total: DataFrame, queries: DataFrame, key: str, query_key: str = "query_id", query_text: str = "query", broadcast_terms: int = 200_000, most: int = 4_000_000) -> DataFrame:
    """query key, chunk key, bm25 for chunks with a term of the query; a term that a query repeats counts each time.

    The postings are filtered by the queries' terms before anything is joined or summed. Document frequencies come
    from the same postings, so their filter is the same. The terms are broadcast where they are `broadcast_terms` at
    most; beyond, the joins are by shuffle. The document frequencies tell how many rows are to be summed; they are dealt
    by chunk to so many partitions that each sums about `most` at most.
    """
    wanted = queries.select(query_key, F.explode(tokens(F.col(query_text))).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("times"))
    few = wanted.count() <= broadcast_terms
    hint = F.broadcast if few else (lambda df: df)
    hits = index.join(hint(wanted.select("term").distinct()), "term", "left_semi")
    counts = written(term_counts(hits), "counts")
    rows = wanted.join(counts, "term").agg(F.sum("df")).first()[0] or 0
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))
    weights = counts.join(F.broadcast(total), how="inner").select("term", idf(F.col("n"), F.col("df")).alias("idf"), "average")
    terms = wanted.join(weights, "term")
    joined = hits.repartition(parts, key).join(F.broadcast(terms), "term") if few else hits.join(terms, "term").repartition(parts, key)
    part = F.col("times") * bm25_term(F.col("idf"), F.col("tf"), F.col("length"), F.col("average"))
    return joined.groupBy(query_key, key).agg(F.sum(part).alias("bm25"))


def overlap(query_terms: Column, text: Column) -> Column:
    """How many distinct terms occur in the lower-cased text."""
    low = F.lower(text)
    return F.size(F.filter(F.array_distinct(query_terms), lambda t: F.contains(low, t)))
