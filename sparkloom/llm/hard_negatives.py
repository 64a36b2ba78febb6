"""Hard-negative mining: for each anchor and positive, the best rows of other labels within a range of scores.

Components x become integers floor(scale * x); a score is an exact integer inner product. Rows are compared with anchors
by bit-sliced products: the rows' components are taken apart into bit-planes (two's complement), and planes are
multiplied with the anchors most significant first. After each plane, what the planes below can still add bounds each
score from both sides; a pair whose interval cannot qualify any more is dropped, and once few pairs of a block are left,
the planes below are multiplied for those pairs alone. What qualifies tightens as rows stream by: a row must reach the
last of the best that its task has found for an anchor so far, for a negative also the range of one of the positives.

All rows are compared with all anchors (the stated query set), in passes of about `anchors_per_pass` anchors, which are
broadcast; a task keeps the few best of each. The few best of all tasks are ranked by a window for each anchor, which
Spark limits before and after the shuffle.

Rows with a null label or vector, with a component that is null or not finite, or with integers whose squared length is
2^50 or more take no part. Rows of different lengths have no score. Ties of score go to the smaller id; a null id comes
last and is no anchor. Repeated rows are rows of their own: each repeated anchor has its own results. Rows beyond id,
label and vector are not read. An empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.batches import bounded_batches, numbered
from sparkloom.session import discard, written

_LOW, _NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_PAIRS = 1 << 20  # of anchors and rows that are held at once


class Best:
    """The best `limit` scores of each key (0 to keys - 1), by falling score, then id."""

    def __init__(self, keys: int, limit: int):
        self.limit = limit
        self.key, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(keys, _LOW)  # what a score must reach to come in

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = np.concatenate([self.key, key]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        place = np.arange(len(key)) - np.repeat(starts, np.diff(starts, append=len(key)))
        kept = place < self.limit
        self.key, self.score, self.id = key[kept], score[kept], ids[kept]
        full = place[kept] == self.limit - 1
        self.floor[self.key[full]] = self.score[full]


def planes(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(place, bits) of integers, most significant first; the first is the sign's, which counts negative."""
    top = int(np.maximum(x, ~x).max(initial=0)).bit_length()
    return [(p, ((x >> p) & 1).astype(np.float64)) for p in range(top, -1, -1)]


def qualifying(anchors: np.ndarray, rows: list[tuple[int, np.ndarray]], low: np.ndarray, high: np.ndarray, alive: np.ndarray, best: int = 0):
    """Indices of anchor and row, and exact score, of the pairs in alive (bool) whose score lies from the anchor's low to
    its high. With best, pairs that at least so many others of the anchor's are sure to surpass are dropped as well."""
    a = anchors.astype(np.float64)  # squared length below 2^50: products with bits are exact
    below, above = np.minimum(anchors, 0).sum(axis=1), np.maximum(anchors, 0).sum(axis=1)
    low, top = low.copy(), rows[0][0]
    partial = np.zeros(alive.shape, np.int64)
    at = 0
    for at, (place, bits) in enumerate(rows):
        partial += (a @ bits.T).astype(np.int64) * ((1 << place) * (-1 if place == top else 1))
        rest = (1 << place) - 1
        if best and alive.shape[1] > best:
            sure = np.where(alive, partial + (rest * below)[:, None], _LOW)
            low = np.maximum(low, np.partition(sure, -best, axis=1)[:, -best])
        alive = alive & (partial + (rest * above)[:, None] >= low[:, None]) & (partial + (rest * below)[:, None] <= high[:, None])
        if np.count_nonzero(alive) * 16 <= alive.size:
            break
    i, j = np.nonzero(alive)
    score = partial[i, j]
    step = max(1, (1 << 22) // max(1, a.shape[1]))
    for place, bits in rows[at + 1 :]:
        for s in range(0, len(i), step):
            score[s : s + step] += np.einsum("ij,ij->i", a[i[s : s + step]], bits[j[s : s + step]]).astype(np.int64) << place
        rest = (1 << place) - 1
        kept = (score + rest * above[i] >= low[i]) & (score + rest * below[i] <= high[i])
        i, j, score = i[kept], j[kept], score[kept]
    return i, j, score


class _Anchors:
    """Anchors of one length, as arrays."""

    def __init__(self, rows: list):
        self.rid = np.array([r["_rid"] for r in rows], np.int64)
        self.id = np.array([r["id"] for r in rows], np.int64)
        self.label = np.array([r["label"] for r in rows], np.int64)
        self.x = np.array([r["x"] for r in rows], np.int64).reshape(len(rows), -1)


def _by_length(rows: list) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(len(r["x"]), []).append(r)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], known: dict) -> Iterator[tuple]:
    """(what known has for the length, rid, id, label, x) of the rows of a length."""
    for batch in batches:
        rid, ids, label = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        sizes = np.diff(batch.column(3).offsets.to_numpy())
        flat, starts = batch.column(3).flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
        for size in np.unique(sizes):
            if size in known:
                at = np.flatnonzero(sizes == size)
                x = flat[starts[at][:, None] + np.arange(size)]
                yield known[size], rid[at], ids[at], label[at], x


def _positives(shared, limit: int):
    """A task: the best rows of its own label for each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {size: (_Anchors(rows), Best(len(rows), limit)) for size, rows in _by_length(shared.value).items()}
        for (anchors, best), rid, ids, label, x in _blocks(batches, known):
            for value in np.intersect1d(label, anchors.label):
                at, of = np.flatnonzero(label == value), np.flatnonzero(anchors.label == value)
                bits, step = planes(x[at]), max(1, _PAIRS // len(at))
                for s in range(0, len(of), step):
                    o = of[s : s + step]
                    other = anchors.rid[o][:, None] != rid[at][None, :]
                    i, j, score = qualifying(anchors.x[o], bits, best.floor[o], np.full(len(o), _NO_ID), other, limit)
                    best.add(o[i], score, ids[at][j])
        for anchors, best in known.values():
            yield pa.RecordBatch.from_arrays([pa.array(anchors.rid[best.key]), pa.array(best.score), pa.array(best.id)], ["_rid", "score", "id"])

    return run


def _negatives(shared, limit: int):
    """A task: the best rows of other labels within the range of each positive of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for size, rows in _by_length(shared.value).items():
            most = max(len(r["ranges"]) for r in rows)
            low, high = np.full((len(rows), most), _NO_ID), np.full((len(rows), most), _LOW)
            for n, r in enumerate(rows):
                for k, p in enumerate(r["ranges"]):
                    low[n, k], high[n, k] = p["low"], p["high"]
            known[size] = _Anchors(rows), Best(low.size, limit), low, high, rows
        for (anchors, best, low, high, _), rid, ids, label, x in _blocks(batches, known):
            bits, step, most = planes(x), max(1, _PAIRS // len(rid)), low.shape[1]
            for s in range(0, len(low), step):
                o = np.arange(s, min(s + step, len(low)))
                reach = np.maximum(low[o], best.floor.reshape(low.shape)[o])
                i, j, score = qualifying(anchors.x[o], bits, reach.min(axis=1), high[o].max(axis=1), anchors.label[o][:, None] != label[None, :])
                fits = (score[:, None] >= reach[i]) & (score[:, None] <= high[o][i])
                n, k = np.nonzero(fits)
                best.add(o[i[n]] * most + k, score[n], ids[j[n]])
        names = ["_rid", "anchor_id", "nth", "positive_id", "positive_score", "negative_score", "negative_id"]
        for anchors, best, low, _, rows in known.values():
            n, k = np.divmod(best.key, low.shape[1])
            p = [rows[a]["ranges"][b] for a, b in zip(n, k)]
            columns = [anchors.rid[n], anchors.id[n], [x["nth"] for x in p], [x["id"] for x in p], [x["score"] for x in p], best.score, best.id]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), *4 * [pa.int64()]))], names)

    return run


def prepared(rows: DataFrame, scale: int, id: str = "id", label: str = "label", vector: str = "vector") -> DataFrame:
    """_rid, id, label, x of the rows that take part; x holds the integers, a null id is the largest number."""
    v = F.col(vector)
    rows = rows.where(F.col(label).isNotNull() & v.isNotNull())
    # 2^50 bounds the integers before they are longs; nan is larger than any number
    rows = rows.where(F.forall(v, lambda c: c.isNotNull() & F.coalesce(F.abs(c.cast("double")) * scale < 2.0**25, F.lit(False))))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = rows.select("_rid", F.coalesce(F.col(id).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(label).cast("long").alias("label"), x.alias("x"))
    return rows.where(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c) < 2.0**50)


def mine(
    rows: DataFrame,
    anchor: Column,
    id: str = "id",
    label: str = "label",
    vector: str = "vector",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    percent: tuple[int, int] = (50, 95),
    anchors_per_pass: int = 20_000,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor says of a row (id, label, vector) whether it is an anchor. An anchor's positives are its best `positives` other
    rows of its label. A negative's score must be from percent[0] to percent[1] hundredths of the positive's.
    """
    spark = rows.sparkSession
    least, most = percent
    base = numbered(rows.select(id, label, vector).withColumn("_anchor", F.coalesce(anchor, F.lit(False)) & F.col(id).isNotNull()), id)
    x = prepared(base.where("_anchor"), scale, id, label, vector)
    anchors = written(x, "anchors")
    passes = max(1, -(-anchors.count() // anchors_per_pass))
    one_of = F.pmod(F.xxhash64("_rid"), F.lit(passes))
    everything = written(prepared(base, scale, id, label, vector), "integers")

    def swept(task, queries: list, schema: str, name: str) -> DataFrame:
        shared = spark.sparkContext.broadcast([r.asDict(recursive=True) for r in queries])
        try:
            return written(everything.mapInArrow(task(shared), schema), name)
        finally:
            shared.unpersist()

    def united(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    with bounded_batches(spark):
        found = []
        for k in range(passes):
            queries = anchors.where(one_of == k).collect()
            found.append(swept(lambda shared: _positives(shared, positives), queries, "_rid long, score long, id long", "positives"))
        order = Window.partitionBy("_rid").orderBy(F.desc("score"), "id")
        ranked = united(found).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives)
        # least * p <= 100 * s <= most * p, for whole numbers s; below zero there is none
        low = F.ceil(F.col("score") * least / F.lit(100).cast("decimal(3,0)")).cast("long")
        high = F.floor(F.col("score") * most / F.lit(100).cast("decimal(3,0)")).cast("long")
        ranges = ranked.withColumns({"low": low, "high": high}).where("low <= high")
        ranges = written(ranges.groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score", "low", "high"))).alias("ranges")), "ranges")
        discard(*found)
        schema = "_rid long, anchor_id long, nth int, positive_id long, positive_score long, negative_score long, negative_id long"
        found = []
        for k in range(passes):
            queries = anchors.where(one_of == k).join(ranges, "_rid").collect()
            found.append(swept(lambda shared: _negatives(shared, negatives), queries, schema, "negatives"))
    discard(anchors, ranges, everything)
    order = Window.partitionBy("_rid", "nth").orderBy(F.desc("negative_score"), "negative_id")
    named = lambda c: F.nullif(F.col(c), F.lit(_NO_ID)).alias(c)
    return (
        united(found)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", named("positive_id"), "rank", named("negative_id"), "positive_score", "negative_score")
    )
