"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import delete_path, discard, scratch_path, written


def _joined(rows: DataFrame, least: DataFrame, broadcast_nodes: int, hub: int) -> DataFrame:
    """rows joined with least (a, m, n: how many rows a has). All of least is broadcast where it is short; if not, that
    of nodes with more than `hub` neighbours, whose rows would else meet in one task each."""
    if least.count() <= broadcast_nodes:
        return rows.join(F.broadcast(least), "a")
    while (hubs := least.where(F.col("n") > hub)).count() > broadcast_nodes:
        hub *= 10
    rest = rows.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(least.where(F.col("n") <= hub), "a")
    return rows.join(F.broadcast(hubs), "a").unionByName(rest)


def components(edges: DataFrame, broadcast_nodes: int = 500_000, hub: int = 10_000) -> DataFrame:
    """node, component (its least reachable node) for the nodes of edges (a, b), both long.

    Each round is a few joins and pre-aggregated minima over the edges that remain; it ends when a round changes
    nothing. Each round's edges are written in the shared folder, so lost executors cost one round at most.
    Loops and repeated edges do no harm; edges with a null end are ignored. Without edges the result is empty.
    """
    spark = edges.sparkSession
    paths: list[str] = []

    def stored(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "stars")
        df.write.parquet(path)
        paths.append(path)
        for old in paths[:-2]:
            delete_path(spark, old)
        del paths[:-2]
        return spark.read.schema("a long, b long").parquet(path)

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(now)
    while True:
        both = now.union(now.select("b", "a"))
        least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")), "least")
        large = _joined(both.where("b > a"), least, broadcast_nodes, hub).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large)
        discard(least)
        least = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        joined = _joined(large, least, broadcast_nodes, hub)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", "m")).where("a <> b").distinct()
        now = stored(small)
        discard(least)
        last, seen = seen, mark(now)
        if last == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
