"""Incremental indexing, the stored tables, and their catalog."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sparkloom.functions.text import chunk_id, file_hash, hierarchy
from sparkloom.operators import imports, keyword, snapshots
from sparkloom.operators.chunking import chunk_files
from sparkloom.operators.providers import EmbeddingProvider, HashingProvider, local_provider
from sparkloom.operators.snapshots import clear_all, stores  # noqa: F401
from sparkloom.operators.symbols import code_map, latest
from sparkloom.session import discard, written


@dataclass
class IndexConfig:
    """tier: fast (no vectors), balanced or quality. provider makes the embedder of the balanced tier, quality_provider
    that of the quality tier, by default a pooled model of 768 dimensions that reads long texts."""

    tier: str = "balanced"
    batch: int = 50
    incremental: bool = True
    syntax: bool = True
    provider: Callable[[], EmbeddingProvider] = field(default=HashingProvider)
    graph_from: int = 1000  # chunks from which a graph index of their vectors is kept
    quality_provider: Callable[[], EmbeddingProvider] = field(default=lambda: local_provider("code"))
    repo: str = ""  # the repository's root, of which the ids of files in edges are made


def embedded(chunks: DataFrame, config: IndexConfig, text: str = "content") -> DataFrame:
    """chunks with embedding, in batches; a batch that fails has empty vectors."""
    if config.tier == "fast":
        return chunks.withColumn("embedding", F.array().cast("array<float>"))
    make, size = config.quality_provider if config.tier == "quality" else config.provider, config.batch

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            out: list = []
            for at in range(0, len(batch), size):
                texts = batch[text].iloc[at : at + size].fillna("").tolist()
                try:
                    out += provider.embed(texts)
                except Exception:  # the provider is remote code
                    out += [[] for _ in texts]
            yield batch.assign(embedding=out)

    from pyspark.sql import types as T

    schema = T.StructType([*[f for f in chunks.schema.fields if f.name != "embedding"], T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return chunks.drop("embedding").mapInPandas(run, schema)


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files (path, hash, ...) that are new or whose hash differs from the manifest's."""
    return files.join(manifest.select("path", "hash"), ["path", "hash"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of equal key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def removed(rows: DataFrame, paths: DataFrame, column: str, path: str = "path") -> DataFrame:
    """rows without those of the paths."""
    return rows.join(paths.select(F.col(path).alias(column)).distinct(), column, "left_anti").select(*rows.columns)


class Store(snapshots.Store):
    """A store with what indexing keeps in it: files, chunks, contents, postings, terms and lengths (and the views corpus
    and idf), imports and edges, symbols and summaries, and an index of vectors beside its versions."""

    def save_code_map(self, files: DataFrame) -> None:
        """Compiles files (path, content, language) to symbols and summaries; the other tables stay."""
        self.save(code_map(files))

    def save_graph(self, edges: DataFrame) -> None:
        self.save({"edges": edges})

    def save_index(self, index, rows: DataFrame) -> None:
        """An index of vectors and its table, beside the other tables."""
        index.save(rows, f"{self.path}/vectors")

    def load_index(self):
        """The index of vectors and its table."""
        from sparkloom.operators.search import IvfIndex

        return IvfIndex.load(self.spark, f"{self.path}/vectors")


def _counted(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """rows as written() gives them, and their number, counted as they are written."""
    seen = Observation()
    return written(rows.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]


def _negated(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: -F.col(n) for n in names})


def start_statistics(step: snapshots.Commit, stored: DataFrame, key: str = "id", text: str = "content") -> None:
    """Postings, document frequencies and lengths of all chunks."""
    index = step.restart("postings", keyword.postings(stored, key, text), key, order=("term", key))
    step.restart("terms", keyword.term_counts(index), by=("term",), order=("term",))
    step.restart("lengths", keyword.lengths(stored, text), by=())


def change_statistics(step: snapshots.Commit, stored: DataFrame, lost: DataFrame, key: str = "id", text: str = "content") -> None:
    """What chunks that came and chunks that went add to postings, document frequencies and lengths, and take from them."""
    index = step.change("postings", keyword.postings(stored, key, text), lost.select(key), key, ("term", key))
    less = keyword.term_counts(keyword.postings(lost, key, text))
    counts = keyword.term_counts(index).unionByName(_negated(less, "df")).groupBy("term").agg(F.sum("df").alias("df"))
    step.add("terms", counts.where("df <> 0"), ("term",), ("term",))
    sizes = keyword.lengths(stored, text).unionByName(_negated(keyword.lengths(lost, text), "n", "bytes"))
    step.add("lengths", sizes.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")), ())


def _graph(step: snapshots.Commit, base: snapshots.Snapshot, stored: DataFrame, lost: DataFrame | None, n: int, n_lost: int, config: IndexConfig) -> None:
    """The graph index of the chunks' vectors, from graph_from chunks on: new vectors come as shards, lost ones as removals;
    what is scattered is built anew."""
    from sparkloom.operators.graph_index import GraphIndex

    index, version, none = GraphIndex(key="id"), step.base.version + 1, "id string, version int"
    spark = stored.sparkSession
    has = "graph" in base.tables() and any(s.rows for s in base.manifest.tables["graph"].segments)
    if lost is None or not has:
        if n >= config.graph_from and config.tier != "fast":
            every = stored if lost is None else base.table("chunks").join(lost, "id", "left_anti").select("id", "embedding").unionByName(stored.select("id", "embedding"))
            step.restart("graph", index.build(every, version), "shard")
            step.restart("graph_gone", spark.createDataFrame([], none), "id")
        elif has:  # all is new, and an older graph does not fit it
            step.restart("graph", index.build(stored.where("false"), version), "shard")
            step.restart("graph_gone", spark.createDataFrame([], none), "id")
        return
    old, gone = base.table("graph"), base.table("graph_gone")
    if index.scattered(old, n_lost + sum(s.rows for s in base.manifest.tables["graph_gone"].segments)):
        live = index.rows(old, gone.unionByName(lost.select("id", F.lit(version).alias("version"))))
        step.restart("graph", index.build(live.unionByName(stored.select("id", "embedding")), version), "shard")
        step.restart("graph_gone", spark.createDataFrame([], none), "id")
        return
    step.change("graph", index.build(stored, version), spark.createDataFrame([], "shard string"), "shard")
    step.change("graph_gone", lost.select("id", F.lit(version).alias("version")), spark.createDataFrame([], "id string"), "id")


def _edges(step: snapshots.Commit, base: snapshots.Snapshot, now: DataFrame, fresh: DataFrame, touched: DataFrame | None, repo: str) -> None:
    """Imports of the files, and the edges: those of files that came, changed or went, and of the files whose imports may
    name one that came or went. A graph that was saved as a whole is built anew."""
    tables = base.manifest.tables
    if touched is None or "imports" not in tables or tables["edges"].kind != "keyed":
        own = step.restart("imports", imports.imports_of(now), "path", order=("path",))
        step.restart("edges", imports.edges_of(now, imports.resolved(own, now), repo), "owner", order=("owner",))
        return
    old = base.table("contents").join(touched, "path", "left_semi").select("path", "language")
    own = step.change("imports", imports.imports_of(fresh), touched, "path", ("path",))
    before = base.table("imports").join(touched, "path", "left_anti")
    moved = old.unionByName(fresh.select("path", "language")).groupBy("path", "language").count().where("count = 1")  # not those that changed in content alone
    again = written(imports.affected(before, moved).unionByName(touched.select("path")).distinct(), "again")
    wanted = before.join(again, "path", "left_semi").unionByName(own)
    edges = imports.edges_of(now.join(again, "path", "left_semi"), imports.resolved(wanted, now), repo)
    step.change("edges", edges, again.select(F.col("path").alias("owner")), "owner", ("owner",))
    discard(again)


def nearest(store: Store, vector: list[float], k: int) -> DataFrame | None:
    """id of the k chunks whose vectors the graph index finds nearest; None where the store has no such index."""
    from sparkloom.operators.graph_index import GraphIndex

    now = store.snapshot()
    if "graph" not in now.tables() or not any(s.rows for s in now.manifest.tables["graph"].segments):
        return None
    asked = store.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id long, embedding array<double>")
    return GraphIndex(key="id").search(now.table("graph"), asked, k, now.table("graph_gone")).select("id")


def index_files(store: Store, files: DataFrame, config: IndexConfig | None = None, ledger: tuple[str, int] | None = None) -> dict:
    """Brings a store up to date with files (path, content, language) in one commit: changed files are cut and embedded
    anew, files that are gone are removed, postings and statistics change by what these chunks add and take away. Returns
    the metrics, which are counted as tables are written.

    files is read once, so hashes, chunks and contents are those of the same bytes. ledger: (stream, batch) of a stream
    that calls this; a batch that the store has noted already changes nothing.
    """
    config = config or IndexConfig()
    began = time.monotonic()
    step = store.begin()
    if ledger and step.base.ledger.get(ledger[0], -1) >= ledger[1]:
        return {"total_files": 0, "indexed": 0, "skipped": 0, "chunks": 0, "duration_ms": 0, "files_per_second": 0.0, "replayed": True}
    base = snapshots.Snapshot(store, step.base)
    now, total = _counted(files.withColumn("hash", file_hash(F.col("content"))), "scan")
    have = "files" in base.tables() and config.incremental
    fresh, touched, indexed = now, None, total
    if have:
        old = base.table("files")
        new_paths, indexed = _counted(changed(now, old).select("path"), "fresh")
        fresh = now.join(new_paths, "path", "left_semi")
        touched = written(new_paths.unionByName(old.join(now, "path", "left_anti").select("path")).distinct(), "touched")
    chunks = chunk_files(fresh, config.syntax)
    chunks = chunks.select(
        chunk_id(F.col("path"), F.col("start_line"), F.col("end_line")).alias("id"),
        F.col("path").alias("file_path"),
        "content",
        "start_line",
        "end_line",
        "chunk_type",
        F.col("name").alias("symbol_name"),
        "parent_name",
        hierarchy(F.col("parent_name"), F.col("name")).alias("hierarchy_path"),
    )
    # an id is path and lines: of a line that fills up a chunk alone and its overlap, the longer text stays
    chunks = embedded(latest(chunks.withColumn("_n", F.struct(F.length("content"), F.col("content"))), "id", "_n").drop("_n"), config)
    entries = fresh.select("path", "hash", F.current_timestamp().alias("indexed_at"))
    contents = fresh.select("path", "content", "language")
    by_file = ("file_path", "start_line")
    if have:
        step.change("files", entries, touched, "path", ("path",))
        step.change("contents", contents, touched, "path", ("path",))
        stored = step.change("chunks", chunks, touched.select(F.col("path").alias("file_path")), "file_path", by_file)
        went = base.table("chunks").join(F.broadcast(touched) if indexed <= snapshots.BROADCAST_KEYS else touched, F.col("file_path") == F.col("path"), "left_semi")
        lost, n_lost = _counted(went.select("id", "content"), "lost")
        change_statistics(step, stored, lost)
        _graph(step, base, stored, lost, base.table("corpus").first().n + step.wrote["chunks"] - n_lost, n_lost, config)
    else:
        step.restart("files", entries, "path", order=("path",))
        step.restart("contents", contents, "path", order=("path",))
        stored = step.restart("chunks", chunks, "file_path", order=by_file)
        start_statistics(step, stored)
        _graph(step, base, stored, None, step.wrote["chunks"], 0, config)
    _edges(step, base, now, fresh, touched if have else None, config.repo)
    step.commit(ledger)
    discard(*([now, new_paths, touched, lost] if have else [now]))
    spent = time.monotonic() - began
    return {
        "total_files": total,
        "indexed": indexed,
        "skipped": total - indexed,
        "chunks": store.table("corpus").first().n,
        "duration_ms": round(1000 * spent),
        "files_per_second": round(indexed / spent, 2) if spent else 0.0,
    }


def sync(store: Store, scan: Callable[[], DataFrame], config: IndexConfig | None = None) -> dict:
    """Brings a store up to date with chunks found line by line; a batch whose vectors fail keeps its files."""
    return index_files(store, scan(), replace(config or IndexConfig(), syntax=False))


def ensure_indexed(store: Store, scan: Callable[[], DataFrame], config: IndexConfig | None = None) -> bool:
    """Indexes without vectors where the store has no file yet, for a first search at once; whether it did."""
    if "files" in store.tables() and not store.table("files").isEmpty():
        return False
    index_files(store, scan(), replace(config or IndexConfig(), tier="fast"))
    return True


def upgrade(store: Store, scan: Callable[[], DataFrame], config: IndexConfig | None = None) -> dict:
    """Indexes all files anew, with vectors; index_files()'s metrics."""
    config = config or IndexConfig()
    return index_files(store, scan(), replace(config, tier="balanced" if config.tier == "fast" else config.tier, incremental=False))


def status(files: DataFrame, chunks: DataFrame, idf: DataFrame, dimensions: int) -> DataFrame:
    """One row: files, chunks, vocabulary, megabytes of vectors."""
    out = files.agg(F.count("*").alias("files"))
    out = out.join(F.broadcast(chunks.agg(F.count("*").alias("chunks"))), how="inner").join(F.broadcast(idf.agg(F.count("*").alias("vocabulary"))), how="inner")
    return out.withColumn("megabytes", F.col("chunks") * (dimensions * 4) / (1 << 20))


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


@dataclass
class Settings:
    """User settings, kept as JSON text; keys are shown masked."""

    provider: str = "local"
    api_key: str | None = None
    max_results: int = 10
    PROVIDERS = ("local", "openai", "hashing")

    def set(self, key: str, value: str) -> None:
        if key == "provider" and value not in self.PROVIDERS:
            raise ValueError(f"unknown provider {value}")
        if key not in ("provider", "api_key", "max_results"):
            raise KeyError(key)
        setattr(self, key, int(value) if key == "max_results" else value)

    def shown(self) -> dict:
        key = self.api_key
        return {"provider": self.provider, "api_key": None if key is None else f"{key[:4]}..." if len(key) > 8 else "***", "max_results": self.max_results}

    def dumps(self) -> str:
        return json.dumps({"provider": self.provider, "api_key": self.api_key, "max_results": self.max_results})

    @classmethod
    def loads(cls, text: str) -> Settings:
        return cls(**json.loads(text))
