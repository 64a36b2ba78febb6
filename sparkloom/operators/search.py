"""Retrieval: exact and approximate vector search, hybrid blending, reranking, top-k, context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import scores as S
from sparkloom.functions import vectors as V
from sparkloom.functions.text import extension
from sparkloom.operators import keyword
from sparkloom.session import delete_path, scratch_path

OVERFETCH = 3


def best(df: DataFrame, score: str, k: int, key: str, per: str | None = None) -> DataFrame:
    """The k rows of the highest score with rank; ties by key. per: for each value of a column."""
    order = [F.desc(score), F.asc(key)]
    if per is None:
        top = df.orderBy(*order).limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= k)


def with_cosine(chunks: DataFrame, vector: Column, query: list[float], name: str = "vector_score") -> DataFrame:
    """One query vector against all rows, inside the row."""
    return chunks.withColumn(name, V.cosine(vector, F.array(*[F.lit(float(x)) for x in query])))


BLOCK = 4096  # queries that are answered by one pass over the rows


def in_blocks(queries: DataFrame, key: str, block: int, answer: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """answer(queries) for blocks of about `block` queries, dealt by a hash of their key; the answers of more than one
    block are written as they come, so that neither plan nor driver grows with the number of queries."""
    blocks = -(-queries.count() // block)
    if blocks <= 1:
        return answer(queries)
    spark, folder = queries.sparkSession, scratch_path(queries.sparkSession, name)
    for i in range(blocks):
        found = answer(queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i))
        found.write.parquet(f"{folder}/block={i}", compression="zstd")
    return spark.read.schema(found.schema).parquet(*[f"{folder}/block={i}" for i in range(blocks)])


TILE = 1 << 18  # scores that a task holds at once


def _usable(vectors, width: int) -> np.ndarray:
    return vectors.map(lambda v: v is not None and len(v) == width and width > 0).to_numpy(bool)


class _Best:
    """The k best ids of each of some queries so far; of equal scores those of the lesser id."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.ids = k, np.zeros((queries, 0)), np.zeros((queries, 0), np.int64)
        self.rows = max(1, min(2048, TILE // max(queries, 1)))  # rows whose scores are held at once

    def add(self, ids: np.ndarray, score: np.ndarray) -> None:
        """score: a row for each id, a column for each query. Queries that no row betters are left as they are."""
        new = np.arange(len(self.score)) if self.ids.shape[1] < self.k else np.flatnonzero(~(score.max(0, initial=-np.inf) < self.score[:, -1]))  # NaN counts as better
        if not len(new):
            return
        every = np.concatenate([self.score[new], score.T[new]], 1)
        names = np.concatenate([self.ids[new], np.broadcast_to(ids, (len(every), len(ids)))], 1)
        top = np.lexsort((names, -every), axis=1)[:, : self.k]
        best, own = np.take_along_axis(every, top, 1), np.take_along_axis(names, top, 1)
        if len(new) == len(self.score):
            self.score, self.ids = best, own
        else:
            self.score[new], self.ids[new] = best, own

    def frame(self, names: np.ndarray, query_key: str, key: str) -> pd.DataFrame:
        return pd.DataFrame({query_key: np.repeat(names, self.ids.shape[1]), key: self.ids.ravel(), "vector_score": self.score.ravel()})


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", block: int = BLOCK) -> DataFrame:
    """query key, key, vector_score, rank: exact cosine of all queries against all rows.

    The queries are taken in blocks of bounded size, each a matrix that goes to all tasks. A batch of rows is one matrix
    product, and a task keeps the k best of each query, so what is shuffled does not grow with rows times queries.
    """

    def answer(part: DataFrame) -> DataFrame:
        rows = part.select(query_key, vector).toPandas()
        width = max((len(v) for v in rows[vector] if v is not None), default=0)
        names = rows[query_key].to_numpy()
        right = _usable(rows[vector], width)
        matrix = np.zeros((len(rows), width))
        if right.any():
            matrix[right] = _unit(_matrix(rows[vector][right]))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = _Best(len(names), k)
            for whole in batches:
                for at in range(0, len(whole), held.rows):
                    batch = whole.iloc[at : at + held.rows]
                    good = _usable(batch[vector], width)
                    score = np.zeros((len(batch), len(names)))
                    if good.any():
                        score[good] = _unit(_matrix(batch[vector][good])) @ matrix.T
                    held.add(batch[key].to_numpy(), score)
            if held.ids.size:
                yield held.frame(names, query_key, key)

        kept = chunks.select(key, vector).mapInPandas(run, f"{query_key} long, {key} long, vector_score double")
        return best(kept, "vector_score", k, key, query_key)

    return in_blocks(queries, query_key, block, answer, "nearest")


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True)) if m.size else np.ones((len(m), 1))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def late_interaction(queries: DataFrame, docs: DataFrame, query_key: str = "query_id", key: str = "doc_id", token: str = "token", block: int = BLOCK) -> DataFrame:
    """query key, key, late_score: the mean over a query's token vectors of the highest cosine among a document's.

    Query tokens are taken in blocks, as in vector_topk; a task reduces the tokens of a batch to one row for each
    document and query token. queries: a row for each token.
    """
    numbered = queries.select(query_key, F.col(token).alias("_q"), F.xxhash64(query_key, token).alias("_n"))
    kind, query_kind = docs.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()

    def answer(part: DataFrame) -> DataFrame:
        rows = part.toPandas()
        width = max((len(v) for v in rows["_q"] if v is not None), default=0)
        good_q = _usable(rows["_q"], width)
        matrix = np.zeros((len(rows), width))
        if good_q.any():
            matrix[good_q] = _unit(_matrix(rows["_q"][good_q]))
        number = np.arange(len(rows))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), 2048):
                    batch = whole.iloc[at : at + 2048].sort_values(key, kind="stable")
                    good = _usable(batch[token], width)
                    score = np.zeros((len(batch), len(rows)))
                    if good.any():
                        score[good] = _unit(_matrix(batch[token][good])) @ matrix.T
                    names, first = np.unique(batch[key].to_numpy(), return_index=True)
                    most = np.maximum.reduceat(score, first, 0)
                    yield pd.DataFrame({query_key: np.tile(rows[query_key].to_numpy(), len(names)), key: np.repeat(names, len(rows)), "_n": np.tile(number, len(names)), "m": most.ravel()})

        pairs = docs.select(key, token).where(F.col(key).isNotNull()).mapInPandas(run, f"{query_key} {query_kind}, {key} {kind}, _n long, m double")
        return pairs.groupBy(query_key, key, "_n").agg(F.max("m").alias("m")).groupBy(query_key, key).agg(F.sum("m").alias("s"), F.count("*").alias("n"))

    parts = in_blocks(numbered, "_n", block, answer, "late")
    return parts.groupBy(query_key, key).agg((F.sum("s") / F.sum("n")).alias("late_score"))


def of_types(chunks: DataFrame, path: str, types: list[str]) -> DataFrame:
    """Rows whose path has one of the extensions, whatever their case; a path without one goes."""
    return chunks.where(extension(F.col(path)).isin([t.lower().lstrip(".") for t in types]))


def hybrid(
    chunks: DataFrame,
    query: str,
    vector: list[float],
    limit: int,
    key: str = "chunk_id",
    text: str = "content",
    embedding: str = "embedding",
    path: str | None = None,
    types: list[str] | None = None,
    index: DataFrame | None = None,
    total: DataFrame | None = None,
    late: DataFrame | None = None,
    near: DataFrame | None = None,
    weights: tuple[float, ...] | None = None,
) -> DataFrame:
    """key, score, bm25_score (normalised), vector_score, rank: the blend of cosine and BM25 over all chunks.

    index and total: a stored postings table and corpus row; without them they are computed from chunks, the index for
    the query's terms alone. The type
    filter comes first, statistics stay those of the whole corpus. near: keys that an index of vectors found; only they
    are scored. late: key, late_score; the blend is then of three, 0 for chunks it lacks. weights: of vector and
    keyword score, or of vector, late and keyword score.
    """
    spark = chunks.sparkSession
    index = keyword.postings(chunks, key, text, keyword.query_terms(spark, query)) if index is None else index
    total = keyword.corpus(chunks, text) if total is None else total
    asked = spark.createDataFrame([(0, query)], "query_id long, query string")
    found = keyword.scores(index, total, asked, key)
    rows = of_types(chunks, path, types) if types else chunks
    if near is not None:
        rows = rows.join(near.select(key).distinct(), key, "left_semi")
    rows = with_cosine(rows.select(key, embedding), F.col(embedding), vector).drop(embedding)
    rows = rows.join(found.select(key, "bm25"), key, "left").withColumn("bm25_score", S.bm25_normalised(F.coalesce("bm25", F.lit(0.0))))
    third = None
    if late is not None:
        rows = rows.join(late.select(key, "late_score"), key, "left")
        third = F.coalesce("late_score", F.lit(0.0))
    rows = rows.select(key, S.blended(F.col("vector_score"), F.col("bm25_score"), third, weights).alias("score"), "bm25_score", "vector_score")
    return best(rows, "score", limit, key)


def keyword_rerank(results: DataFrame, query: str, key: str, text: str = "content", step: float = 0.05) -> DataFrame:
    """score raised by step for each distinct query term in the text, ranked again."""
    asked = keyword.query_terms(results.sparkSession, query)
    terms = F.array(*[F.lit(t) for t in asked]) if asked else F.array().cast("array<string>")
    raised = results.withColumn("score", F.col("score") + step * keyword.overlap(terms, F.col(text)))
    return raised.drop("rank").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long"))


def rerank(results: DataFrame, scorer: Callable[[str, list[str]], list[float]] | None, query: str, limit: int, key: str, text: str = "content") -> DataFrame:
    """A pluggable scorer of (query, texts) replaces the score; without one the first `limit` rows stay."""
    if scorer is None:
        return results.orderBy("rank").limit(limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=scorer(query, batch[text].tolist()))

    rows = results.drop("rank")
    return best(rows.mapInPandas(run, rows.schema), "score", limit, key)


def answer_context(results: DataFrame, path: str = "path", text: str = "content", start: str = "start_line", end: str = "end_line", first: int = 5) -> DataFrame:
    """One row: the first results as blocks under a header, in order of rank."""
    block = F.concat(F.lit("--- File: "), path, F.lit(" (lines "), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"), F.lit(") ---\n"), text, F.lit("\n"))
    top = results.where(F.col("rank") <= first).select("rank", block.alias("block"))
    parts = F.sort_array(F.collect_list(F.struct("rank", "block")))
    return top.agg(F.array_join(F.transform(parts, lambda x: x["block"]), "\n").alias("context"))


def prompt(context: DataFrame, question: str) -> DataFrame:
    """answer_context()'s row with the prompt for a language model that is called elsewhere."""
    head = "Answer the question from the code below, and name the files you rely on.\n\n"
    return context.withColumn("prompt", F.concat(F.lit(head), F.coalesce("context", F.lit("")), F.lit(f"\n\nQuestion: {question}\n")))


def related(results: DataFrame, chunks: DataFrame, edges: DataFrame, depth: int, max_count: int, path: str = "path", key: str = "chunk_id") -> DataFrame:
    """results and, after them, the first chunk of each file within depth of theirs in the graph, score 0.5.

    edges: (src, dst) of files. Appended rows are not sorted in by score; in all at most max_count rows.
    """
    from sparkloom.operators.graph import reachable

    hits = results.select(path).distinct()
    near = reachable(edges, hits, depth, path).join(hits, path, "left_anti")
    firsts = chunks.join(near, path, "left_semi").groupBy(path).agg(F.min(key).alias(key)).orderBy(path).limit(max_count)
    last = results.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("n"))
    added = firsts.join(F.broadcast(last), how="inner").select(
        key,
        path,
        F.lit(0.5).alias("score"),
        F.lit(0.0).alias("bm25_score"),
        F.lit(0.5).alias("vector_score"),
        (F.col("n") + F.row_number().over(Window.orderBy(path))).cast("long").alias("rank"),
    )
    return results.select(key, path, "score", "bm25_score", "vector_score", "rank").unionByName(added).where(F.col("rank") <= max_count)


class IvfIndex:
    """Inverted-file index: centroids fitted on a bounded sample, every row in the cells of its `copies` nearest.

    fit_rows bounds the sample that reaches the driver; all rows are indexed. A search scores what is in the `probes`
    nearest cells of each query exactly: cells are cut into blocks of at most block_rows rows and their queries into
    blocks too, and each pair of a cell's blocks is one matrix product. Below `threshold` rows (the size from which an
    index is worth it; 0: always index) an exact search is used instead.
    """

    def __init__(self, cells: int = 32, fit_rows: int = 20_000, rounds: int = 10, threshold: int = 1000, copies: int = 1, block_rows: int = 20_000):
        self.cells, self.fit_rows, self.rounds, self.threshold, self.copies, self.block_rows = cells, fit_rows, rounds, threshold, copies, block_rows
        self.centroids = np.zeros((0, 0))
        self.key, self.vector = "vec_id", "embedding"

    def build(self, rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """rows with cell, for a table partitioned by it, once for each of its cells; null where there is no usable vector."""
        self.key, self.vector = key, vector
        sample = rows.where(F.size(vector) > 0).orderBy(F.xxhash64(key), key).limit(self.fit_rows).select(vector).toPandas()[vector]
        width = max((len(v) for v in sample), default=0)
        if any(len(v) != width for v in sample):
            raise ValueError("vectors of different lengths")
        x = _unit(_matrix(sample))
        c = x[np.linspace(0, len(x) - 1, min(self.cells, len(x))).astype(int)] if len(x) else np.zeros((0, 0))
        for _ in range(self.rounds if len(x) else 0):
            near = (x @ c.T).argmax(1)
            c = _unit(np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))]))
        self.centroids = c
        return self.add(rows)

    def _placed(self, rows: DataFrame, n: int) -> DataFrame:
        c, vector, width = self.centroids, self.vector, self.centroids.shape[1] if len(self.centroids) else 0

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                good = _usable(batch[vector], width)
                cells: list = [[None]] * len(batch)
                if good.any():
                    near = np.argsort(-(_unit(_matrix(batch[vector][good])) @ c.T), 1, kind="stable")[:, :n]
                    for i, own in zip(np.flatnonzero(good), near.tolist()):
                        cells[i] = own
                yield batch.assign(cell=cells)

        from pyspark.sql import types as T

        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.ArrayType(T.IntegerType()))])
        return rows.mapInPandas(run, schema).withColumn("cell", F.explode("cell"))

    def add(self, rows: DataFrame) -> DataFrame:
        """Rows placed in the cells of a built index, to be added to its table."""
        return self._placed(rows, self.copies)

    def removed(self, indexed: DataFrame, keys: DataFrame) -> DataFrame:
        """The index's table without some keys."""
        return indexed.join(keys.select(self.key).distinct(), self.key, "left_anti").select(*indexed.columns)

    def size(self, indexed: DataFrame) -> int:
        return indexed.select(self.key).distinct().count()

    def save(self, indexed: DataFrame, folder: str) -> None:
        """The table, partitioned by cell, and the centroids with the settings, under a folder of any store."""
        spark = indexed.sparkSession
        indexed.write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/rows")
        settings = (self.cells, self.fit_rows, self.rounds, self.threshold, self.copies, self.block_rows, self.key, self.vector)
        kinds = "cells int, fit_rows int, rounds int, threshold int, copies int, block_rows int, key string, vector string, centroids array<array<double>>"
        spark.createDataFrame([(*settings, self.centroids.tolist())], kinds).coalesce(1).write.mode("overwrite").parquet(f"{folder}/index")

    @classmethod
    def load(cls, spark, folder: str) -> tuple[IvfIndex, DataFrame]:
        r = spark.read.parquet(f"{folder}/index").first()
        index = cls(r.cells, r.fit_rows, r.rounds, r.threshold, r.copies, r.block_rows)
        index.key, index.vector, index.centroids = r.key, r.vector, np.array(r.centroids, np.float64)
        return index, spark.read.parquet(f"{folder}/rows")

    @staticmethod
    def clear(spark, folder: str) -> None:
        delete_path(spark, folder)

    def search(self, indexed: DataFrame, queries: DataFrame, k: int, probes: int = 8, query_key: str = "query_id") -> DataFrame:
        """query key, key, vector_score, rank of the best in the probed cells."""
        key, vector, width = self.key, self.vector, self.centroids.shape[1] if len(self.centroids) else 0
        if self.threshold and indexed.limit(self.threshold * self.copies).count() < self.threshold * self.copies:
            rows = indexed.drop("cell").dropDuplicates([key]) if self.copies > 1 else indexed
            return vector_topk(rows, queries, k, key, vector, query_key)
        # blocks of each cell's rows and queries, so that a unit of work is bounded whatever a cell holds
        rows = indexed.where("cell IS NOT NULL").select(key, vector, "cell")
        cut = rows.groupBy("cell").agg(F.ceil(F.count("*") / self.block_rows).cast("int").alias("blocks"))
        rows = rows.join(F.broadcast(cut), "cell").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).drop("blocks")
        asked = self._placed(queries.select(query_key, vector), probes).where("cell IS NOT NULL")
        many = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        asked = asked.join(F.broadcast(many), "cell").withColumn("part", F.pmod(F.xxhash64(query_key), F.col("parts")).cast("int")).drop("parts")
        asked = asked.join(F.broadcast(cut), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        rows = rows.join(F.broadcast(many), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def unit(own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
            held = _Best(len(wanted), k)
            if len(own) and len(wanted):
                q = _unit(_matrix(wanted[vector])).T
                for at in range(0, len(own), held.rows):
                    part = own.iloc[at : at + held.rows]
                    held.add(part[key].to_numpy(), _unit(_matrix(part[vector])) @ q)
            return held.frame(wanted[query_key].to_numpy(), query_key, key)

        by = ["cell", "block", "part"]
        scored = rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(unit, f"{query_key} long, {key} long, vector_score double")
        if self.copies > 1:
            scored = scored.groupBy(query_key, key).agg(F.max("vector_score").alias("vector_score"))
        return best(scored, "vector_score", k, key, query_key)
