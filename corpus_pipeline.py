"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, SentencePiece ids.

Each stage works on all its predecessor kept and is written as Parquet in the shared folder before the next reads it,
so a lost executor costs part of a stage at most. All stages but the last return the columns of documents.

Null, empty and repeated rows: the first stage rejects null and empty texts (fewer than 50 words); a null doc_id is
never a duplicate; rows of one doc_id are one document to the second stage. An empty table stays empty throughout.
Columns beyond those of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, jaccard_join, pii, quality_rules, sentencepieces
from sparkloom.llm.batches import numbered
from sparkloom.llm.queries import piece_model
from sparkloom.session import scratch_path


def without(docs: DataFrame, removed: DataFrame, key: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs without the rows whose key is in removed; that is broadcast where it is short, after a count."""
    if removed.count() <= broadcast_rows:
        removed = F.broadcast(removed)
    return docs.join(removed, key, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their boilerplate lines; n_chars follows the text."""
    found = quality_rules.judged(docs).where("kept")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    found = jaccard_join.join(docs, words=5, percent=80)
    removed = found.where("component_id <> doc_id").select("doc_id").distinct()
    return without(docs, removed, "doc_id").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = numbered(docs)
    occurrences = decontaminate.hits(rows.select("_rid", "text"), items)
    return without(rows, occurrences.select("_rid").distinct(), "_rid").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    found = pii.find(docs, masked=True)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the text decoded from the ids."""
    rows = sentencepieces.round_trip(docs.select("doc_id", "lang", "source", "text"), piece_model())
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("PII", private),
    ("SentencePiece encoding and decoding", tokenized),
]

#: Personal data and SentencePiece cannot be expressed in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path, compression="zstd")
        docs = spark.read.parquet(path)
    return docs
