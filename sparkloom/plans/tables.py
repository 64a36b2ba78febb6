"""The fixture tables in their parts: documents as chunks and files, orders as commits, lineitem as their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY = "the of and that the"
QUERY_VECTOR = 7


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame, most: int = 5_000, least: int = 500) -> DataFrame:
    """rows dealt evenly to tasks of `most` rows at most, and to all cores where that leaves each `least`: a small file is
    one or two tasks, whatever is then made of its rows."""
    n = rows.count()
    return rows.repartition(max(-(-n // most), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // least)), 1))


def path():
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks without their vectors, for what reads texts alone: no join."""
    return read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), path().alias("path"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return docs.join(vectors, "chunk_id", "left")


def vector(spark: SparkSession, sf: str, key: int = QUERY_VECTOR) -> list[float]:
    return [float(x) for x in read(spark, sf, "embeddings").where(F.col("vec_id") == key).first()["embedding"]]


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def commits(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("hash"),
        F.col("o_custkey").cast("string").alias("author"),
        F.unix_timestamp("o_orderdate").alias("timestamp"),
        F.col("o_orderpriority").alias("message"),
    )


def modified(spark: SparkSession, sf: str) -> DataFrame:
    """Edges commit Modifies file, and their reverses."""
    from sparkloom.operators.graph import both_ways, node

    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    return both_ways(rows, node("commit", F.col("l_orderkey")), node("file", F.col("l_partkey")), "Modifies")


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat("p_brand", F.lit("/"), "p_name").alias("path"))


def links(spark: SparkSession, sf: str) -> DataFrame:
    """src, dst: the imports of every page, made by a fixed rule from its id, as the pages' own links are relative."""
    pages = read(spark, sf, "pages").select("page_id")
    n = F.array(F.col("page_id") * 7 % 97, F.col("page_id") * 3 % 89 + 5, F.col("page_id") + 1000000)
    return pages.select(F.col("page_id").alias("src"), F.explode(n).alias("dst")).where("src <> dst")
