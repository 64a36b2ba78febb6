"""A graph index of vectors: a navigable small-world graph for each shard, searched by beams.

Rows are dealt to shards of about shard_rows by a hash of their key. A shard's nodes are its distinct vectors. A node is
linked with up to `m` of its `construction` nearest nodes, such that none is nearer to another one that it is linked with
than to the node itself, with nodes that are linked with it (2 * m links at most), and with one node far away. The
nearest ones are found exactly, by blocks of matrix products, as a shard is bounded.

A shard is one row of the index's table: keys, vectors and links as arrays in binary form. So a search reads the index
without a shuffle: each task walks its shards' graphs for a block of queries at once, always expanding each query's best
node that is not expanded yet, until the `search` best that it has met are all expanded. Their scores are exact cosines.
The best of all shards are ranked by a window that Spark limits before its shuffle.

Rows are added as new shards, and removed by their keys: a removed row stays a step of the walks but is no result. Shards
and removals have a version, and a removal holds for the shards of lower versions, so a key may come again.
scattered() tells when there are many small shards or removed rows; build(rows()) then makes the table anew.

Rows without a vector, with components that are null or not finite, of length zero or of another width than most have no
place in the index; equal scores are ranked by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.search import BLOCK, best, in_blocks

_BEAM = 256  # queries that walk a shard together


def linked(x: np.ndarray, m: int, construction: int, seed: int = 0) -> np.ndarray:
    """Links (rows of node numbers, -1 where there is none) of unit vectors that all differ."""
    n, c = len(x), min(construction, len(x) - 1)
    out = np.full((n, 2 * m + 1), -1, np.int32)
    if n < 2:
        return out
    forward: list[np.ndarray] = []
    for at in range(0, n, 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        near = np.argpartition(-s, c - 1, axis=1)[:, :c]
        value = np.take_along_axis(s, near, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
        for own, to in zip(near, value):
            between, blocked, kept = x[own] @ x[own].T, np.zeros(c, bool), []
            while len(kept) < m and not blocked.all():
                i = int(np.argmin(blocked))
                kept.append(i)
                blocked |= between[i] >= to
                blocked[i] = True
            if len(kept) < m:  # the nearest of what is left
                rest = np.setdiff1d(np.arange(c), kept)[: m - len(kept)]
                kept += rest.tolist()
            forward.append(own[kept])
    ends = np.concatenate(forward)
    starts = np.repeat(np.arange(n), [len(f) for f in forward])
    pairs = np.unique(np.concatenate([np.stack([starts, ends], 1), np.stack([ends, starts], 1)]), axis=0)
    value = np.einsum("ij,ij->i", x[pairs[:, 0]], x[pairs[:, 1]])
    own = np.zeros(len(pairs), bool)  # a node's own choice goes first
    own[np.searchsorted(pairs[:, 0] * n + pairs[:, 1], starts * n + ends)] = True
    order = np.lexsort((-value, ~own, pairs[:, 0]))
    pairs = pairs[order]
    first = np.searchsorted(pairs[:, 0], np.arange(n))
    place = np.arange(len(pairs)) - first[pairs[:, 0]]
    fits = place < 2 * m
    out[pairs[fits, 0], place[fits]] = pairs[fits, 1]
    far = np.random.default_rng(seed).integers(1, n, n)
    far = ((np.arange(n) + far) % n).astype(np.int32)
    out[:, 2 * m] = np.where((out[:, : 2 * m] == far[:, None]).any(1), -1, far)
    return out


def walk(x: np.ndarray, links: np.ndarray, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (-1: none) and scores of the `width` best that each query's beam met, and how many rows it scored."""
    n, q = len(x), len(queries)
    width = min(width, n)
    entries = np.unique(np.linspace(0, n - 1, min(16, n)).astype(int))
    seen = np.zeros((q, n), bool)
    seen[:, entries] = True
    node = np.full((q, width + max(links.shape[1], len(entries))), -1, np.int64)
    score = np.full(node.shape, -np.inf)
    done = np.zeros(node.shape, bool)
    node[:, : len(entries)], score[:, : len(entries)] = entries, queries @ x[entries].T
    scored, live = np.full(q, len(entries)), np.arange(q)
    while len(live):
        order = np.argsort(-score[live], axis=1, kind="stable")[:, :width]
        for a in (node, score, done):
            a[live, :width] = np.take_along_axis(a[live], order, 1)
        score[live, width:], node[live, width:], done[live, width:] = -np.inf, -1, False
        open_ = ~done[live, :width] & (node[live, :width] >= 0)
        at = open_.argmax(1)
        going = open_[np.arange(len(live)), at]
        live, at = live[going], at[going]
        if not len(live):
            break
        done[live, at] = True
        near = links[node[live, at]]
        fresh = near >= 0
        fresh[fresh] = ~seen[np.broadcast_to(live[:, None], near.shape)[fresh], near[fresh]]
        row, column = np.nonzero(fresh)
        found = near[row, column]
        seen[live[row], found] = True
        node[live[row], width + column] = found
        score[live[row], width + column] = np.einsum("ij,ij->i", queries[live[row]], x[found])
        scored[live] += fresh.sum(1)
    return node[:, :width], score[:, :width], scored


def _units(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


class GraphIndex:
    def __init__(self, m: int = 16, construction: int = 128, search: int = 64, shard_rows: int = 20_000, key: str = "vec_id", vector: str = "embedding"):
        self.m, self.construction, self.width, self.shard_rows, self.key, self.vector = m, construction, search, shard_rows, key, vector

    def schema(self, rows: DataFrame) -> str:
        return f"shard string, version int, keys array<{rows.schema[self.key].dataType.simpleString()}>, owners binary, vectors binary, links binary, width int, size int"

    def usable(self, rows: DataFrame) -> DataFrame:
        v = F.col(self.vector)
        rows = rows.select(self.key, v).where(F.col(self.key).isNotNull() & v.isNotNull() & (F.size(v) > 0))
        finite = F.forall(v, lambda c: c.isNotNull() & F.coalesce(F.abs(c.cast("double")) < 1e30, F.lit(False)))
        rows = rows.where(finite & F.exists(v, lambda c: c != 0))
        usual = rows.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        return rows.where(F.size(v) == (usual.d if usual else 0)).withColumn("_n", F.lit(usual.n if usual else 0))

    def build(self, rows: DataFrame, version: int = 0) -> DataFrame:
        """The index's table of rows (key, vector), or shards of that version to be added to it."""
        good, key, vector, m, construction = self.usable(rows), self.key, self.vector, self.m, self.construction
        shards = F.greatest(F.lit(1), F.ceil(F.col("_n") / self.shard_rows))
        dealt = good.withColumn("shard", F.pmod(F.xxhash64(key), shards).cast("int"))

        def unit(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values(key, kind="stable")
            raw = np.stack(own[vector].to_numpy()).astype(np.float32)
            x, owners = np.unique(raw, axis=0, return_inverse=True)
            links = linked(_units(x.astype(np.float64)).astype(np.float32), m, construction)
            packed = (f"{version}-{own['shard'].iloc[0]}", version, own[key].tolist(), owners.astype(np.int32).tobytes(), x.tobytes(), links.tobytes(), x.shape[1], len(x))
            return pd.DataFrame([packed], columns=["shard", "version", "keys", "owners", "vectors", "links", "width", "size"])

        return dealt.select("shard", key, vector).groupBy("shard").applyInPandas(unit, self.schema(rows))

    def search(self, index: DataFrame, queries: DataFrame, k: int, gone: DataFrame | None = None, query_key: str = "query_id", width: int | None = None) -> DataFrame:
        """query key, key, vector_score, rank: the k best that the beams find. gone: removals (key, version)."""
        found = self._found(index, queries, k, gone, query_key, width).where(F.col(self.key).isNotNull())
        return best(found.drop("scored"), "vector_score", k, self.key, query_key)

    def scored(self, index: DataFrame, queries: DataFrame, k: int, query_key: str = "query_id", width: int | None = None) -> DataFrame:
        """query key, scored: how many rows a search compares with each query."""
        found = self._found(index, queries, k, None, query_key, width).where(F.col(self.key).isNull())
        return found.groupBy(query_key).agg(F.sum("scored").alias("scored"))

    def _found(self, index: DataFrame, queries: DataFrame, k: int, gone: DataFrame | None, query_key: str, width: int | None) -> DataFrame:
        key, vector, beam = self.key, self.vector, max(width or self.width, k)
        kinds = index.schema["keys"].dataType.elementType.simpleString(), queries.schema[query_key].dataType.simpleString()
        if gone is None:
            rows = index.withColumn("gone", F.array().cast(f"array<{kinds[0]}>"))
        else:
            removed = self._removed(index, gone).groupBy("shard").agg(F.collect_list("_key").alias("gone"))  # as many as the shard has rows at most
            rows = index.join(removed, "shard", "left").withColumn("gone", F.coalesce("gone", F.array().cast(f"array<{kinds[0]}>")))

        def answer(part: DataFrame) -> DataFrame:
            asked = part.select(query_key, vector).toPandas()
            names, sizes = asked[query_key].tolist(), np.array([0 if v is None else len(v) for v in asked[vector]])
            by_width = {int(d): (np.flatnonzero(sizes == d), _units(np.stack([np.asarray(asked[vector][i], np.float64) for i in np.flatnonzero(sizes == d)]))) for d in set(sizes.tolist()) - {0}}

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    for r in batch.itertuples(index=False):
                        if r.width not in by_width:
                            continue
                        at, q = by_width[r.width]
                        x = _units(np.frombuffer(r.vectors, np.float32).reshape(r.size, r.width).astype(np.float64))
                        links = np.frombuffer(r.links, np.int32).reshape(r.size, -1)
                        keys, owners, dead = np.asarray(r.keys), np.frombuffer(r.owners, np.int32), set(np.asarray(r.gone).tolist())
                        order = np.argsort(owners, kind="stable")
                        first = np.searchsorted(owners[order], np.arange(r.size + 1))
                        alive = [[y for y in keys[order[first[i] : first[i + 1]]].tolist() if y not in dead][:k] for i in range(r.size)]
                        for s in range(0, len(q), _BEAM):
                            node, score, scored = walk(x, links, q[s : s + _BEAM], beam)
                            out: list[tuple] = []
                            for row, (nodes, values) in enumerate(zip(node, score)):
                                name, left = names[at[s + row]], k
                                out.append((name, None, 0.0, int(scored[row])))
                                for i, v in sorted(zip(nodes.tolist(), values.tolist()), key=lambda p: (-p[1], p[0])):
                                    if i < 0 or left <= 0:
                                        break
                                    out += [(name, y, v, 0) for y in alive[i]]
                                    left -= len(alive[i])
                            yield pd.DataFrame(out, columns=[query_key, key, "vector_score", "scored"])

            return rows.select("keys", "owners", "vectors", "links", "width", "size", "gone").mapInPandas(run, f"{query_key} {kinds[1]}, {key} {kinds[0]}, vector_score double, scored long")

        return in_blocks(queries, query_key, BLOCK, answer, "beams")

    def _removed(self, index: DataFrame, gone: DataFrame) -> DataFrame:
        """shard and _key of the rows that are removed."""
        until = gone.groupBy(F.col(self.key).alias("_key")).agg(F.max("version").alias("_until"))
        return index.select("shard", "version", F.explode("keys").alias("_key")).join(until, "_key").where("version < _until").select("shard", "_key")

    def rows(self, index: DataFrame, gone: DataFrame | None = None) -> DataFrame:
        """key and vector of all rows of an index that are not removed."""
        key, vector = self.key, self.vector

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    x = np.frombuffer(r.vectors, np.float32).reshape(r.size, r.width)
                    yield pd.DataFrame({"shard": r.shard, key: list(r.keys), vector: list(x[np.frombuffer(r.owners, np.int32)])})

        kind = index.schema["keys"].dataType.elementType.simpleString()
        out = index.select("shard", "keys", "owners", "vectors", "width", "size").mapInPandas(run, f"shard string, {key} {kind}, {vector} array<float>")
        if gone is not None:
            out = out.join(self._removed(index, gone).withColumnRenamed("_key", key), ["shard", key], "left_anti")
        return out.select(key, vector)

    def scattered(self, index: DataFrame, removed: int) -> bool:
        """Whether an index has four times the shards that it needs, or as many removed rows as others."""
        shards, rows = index.agg(F.count("*"), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
        return shards > 4 * max(1, -(-rows // self.shard_rows)) or 2 * removed > rows > 0
