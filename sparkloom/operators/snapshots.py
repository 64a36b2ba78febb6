"""A store of tables with a snapshot log.

A version is a manifest that names, for each table, the segments it is made of. A commit writes new segments and one
manifest for all its tables; segments that did not change are named again, not copied. So a reader of any version keeps
all its files, and a commit writes in proportion to what it changes.

Three kinds of table:
- whole: one segment, replaced by each commit that names the table;
- keyed: a segment adds rows and may remove keys, which takes the rows of those keys out of all segments before it;
- summed: a segment adds numbers to those of its key (`by` columns); keys whose numbers are all zero are gone.

Segments of a table are merged when they are many, the newest ones first and always as many as together outweigh the
next older one, so that a row is rewritten a logarithmic number of times. A manifest is published by a rename that fails
where the version exists; a commit that lost that race is put on top of the winner if they touch different tables, and
fails with CommitConflict if not.

Old versions are deleted by expire(): those older than an age, but for the newest one and for versions that readers hold
by a lease (Store.reading). Data files are deleted when no version names them.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.scores import EMPTY_LENGTH, idf
from sparkloom.session import delete_path

MOST_SEGMENTS = 8
BROADCAST_KEYS = 200_000


class CommitConflict(RuntimeError):
    """Another commit has changed a table of this one since it began."""


class Files:
    """Small files of any store that Spark reaches."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        p = self.jvm.org.apache.hadoop.fs.Path(name)
        return p, p.getFileSystem(self.conf)

    def list(self, folder: str) -> dict[str, int]:
        """Names and times of modification (ms) in a folder; empty where it does not exist."""
        p, fs = self.path(folder)
        return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(p)} if fs.exists(p) else {}

    def read(self, name: str) -> str:
        p, fs = self.path(name)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        p, fs = self.path(name)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def publish(self, name: str, text: str) -> bool:
        """Writes a file that is there whole or not at all; False where it exists."""
        temporary = f"{name.rpartition('/')[0]}/.{uuid4().hex}.tmp"
        self.write(temporary, text)
        (source, _), (target, _) = self.path(temporary), self.path(name)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(source, target, none)
        except Exception as e:
            delete_path(self.spark, temporary)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True


@dataclass(frozen=True)
class Segment:
    """rows in `path`; keys that it removes in `gone`; seq orders the segments of a table."""

    seq: int
    path: str
    rows: int
    gone: str | None = None
    gone_rows: int = 0

    @property
    def size(self) -> int:
        return self.rows + self.gone_rows


@dataclass(frozen=True)
class Table:
    kind: str  # whole, keyed or summed
    schema: str
    segments: tuple[Segment, ...]
    key: str | None = None
    by: tuple[str, ...] = ()
    order: tuple[str, ...] = ()

    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    at: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    ledger: dict[str, int] = field(default_factory=dict)

    def dumps(self) -> str:
        tables = {n: {**vars(t), "segments": [vars(s) for s in t.segments]} for n, t in self.tables.items()}
        return json.dumps({"version": self.version, "at": self.at, "tables": tables, "ledger": self.ledger})

    @classmethod
    def loads(cls, text: str) -> Manifest:
        raw = json.loads(text)
        tables = {
            n: Table(**{**t, "segments": tuple(Segment(**s) for s in t["segments"]), "by": tuple(t["by"]), "order": tuple(t["order"])}) for n, t in raw["tables"].items()
        }
        return cls(raw["version"], raw["at"], tables, raw["ledger"])

    def files(self) -> set[str]:
        return {p for t in self.tables.values() for s in t.segments for p in (s.path, s.gone) if p}


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere and no metadata, as files give it back."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType))
    return kind


def merged(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


class Snapshot:
    """The tables of one version."""

    def __init__(self, store: Store, manifest: Manifest):
        self.store, self.manifest, self.version = store, manifest, manifest.version

    def tables(self) -> list[str]:
        """Names of the tables, with those that are derived from others."""
        own = set(self.manifest.tables)
        return sorted(own | {n for n, (needs, _) in DERIVED.items() if set(needs) <= own})

    def table(self, name: str) -> DataFrame:
        if name in self.manifest.tables:
            own = self.manifest.tables[name]
            return self.store._live(own, own.segments)
        if name in DERIVED:
            needs, made = DERIVED[name]
            return made(*[self.table(n) for n in needs])
        raise KeyError(f"no table {name} in version {self.version} of {self.store.path}")


def _corpus(lengths: DataFrame) -> DataFrame:
    """n and average length of the summed lengths; one row, also without chunks."""
    sums = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("bytes").alias("bytes"))
    return sums.select("n", F.coalesce(F.col("bytes") / F.nullif(F.col("n"), F.lit(0)), F.lit(EMPTY_LENGTH)).alias("average"))


def _idf(terms: DataFrame, lengths: DataFrame) -> DataFrame:
    return terms.join(F.broadcast(_corpus(lengths)), how="inner").select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


#: Tables that are views of stored ones.
DERIVED = {"corpus": (("lengths",), _corpus), "idf": (("terms", "lengths"), _idf)}


class Commit:
    """Changes of several tables that become one version. Each method writes its segment at once and gives back what a
    reader of it will see; nothing is visible before commit()."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.manifest()
        self.new: dict[str, tuple[Table, Segment | None]] = {}
        self.wrote: dict[str, int] = {}

    def _put(self, name: str, kind: str, rows: DataFrame, order: tuple[str, ...], key: str | None = None, by: tuple[str, ...] = (), gone: DataFrame | None = None) -> DataFrame:
        path, n = self.store._put(rows.sortWithinPartitions(*order) if order else rows)
        removed, gone_rows = (None, 0) if gone is None else self.store._put(gone.distinct())
        segment = Segment(self.base.version + 1, path, n, removed if gone_rows else None, gone_rows)
        table = Table(kind, nullable(rows.schema).json(), (segment,), key, by, order)
        self.new[name], self.wrote[name] = (table, segment), n
        return self.store._read(path, rows.schema)

    def replace(self, name: str, rows: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
        """The table is these rows."""
        return self._put(name, "whole", rows, order)

    def restart(self, name: str, rows: DataFrame, key: str | None = None, by: tuple[str, ...] | None = None, order: tuple[str, ...] = ()) -> DataFrame:
        """The table is these rows; later commits change it by key, or add to its sums (by: perhaps no column)."""
        found = self._put(name, "keyed" if by is None else "summed", rows, order, key, by or ())
        self.new[name] = (self.new[name][0], None)
        return found

    def change(self, name: str, rows: DataFrame, gone: DataFrame, key: str, order: tuple[str, ...] = ()) -> DataFrame:
        """The table's rows of the keys in gone (one column, named as key) go, and these rows come."""
        return self._put(name, "keyed", rows, order, key, gone=gone.select(key))

    def add(self, name: str, rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...] = ()) -> DataFrame:
        """Numbers to be added to the table's sums."""
        return self._put(name, "summed", rows, order, by=by)

    def _onto(self, base: Manifest) -> dict[str, Table]:
        tables = dict(base.tables)
        for name, (table, segment) in self.new.items():
            old = tables.get(name)
            if segment is None or table.kind == "whole" or old is None or old.kind != table.kind:
                tables[name] = table
                continue
            if old.schema != table.schema:
                raise ValueError(f"table {name} has another schema")
            segment = Segment(old.segments[-1].seq + 1, segment.path, segment.rows, segment.gone, segment.gone_rows)
            kept = old.segments if not segment.size else (*old.segments, segment)
            tables[name] = self.store._compacted(Table(old.kind, old.schema, kept, old.key, old.by, old.order))
        return tables

    def commit(self, ledger: tuple[str, int] | None = None) -> int:
        """Publishes the version and gives its number. ledger: (stream, batch), noted with the data."""
        base = self.base
        while True:
            noted = base.ledger | (dict([ledger]) if ledger else {})
            found = Manifest(base.version + 1, int(1000 * time.time()), self._onto(base), noted)
            if self.store.files.publish(f"{self.store.path}/log/{found.version:012d}.json", found.dumps()):
                break
            base = self.store.manifest()
            if any(base.tables.get(n) != self.base.tables.get(n) for n in self.new) or ledger and base.ledger.get(ledger[0]) != self.base.ledger.get(ledger[0]):
                raise CommitConflict(f"version {base.version} changed {sorted(self.new)} first")
        self.store.expire(self.store.retain_seconds)
        return found.version


class Store:
    """A named set of tables under a folder; see the module for how versions are kept. retain_seconds: how long versions
    that are no longer the newest stay for readers without a lease."""

    def __init__(self, spark: SparkSession, root: str, name: str = "default", retain_seconds: float = 3600, most_segments: int = MOST_SEGMENTS):
        self.spark, self.path, self.retain_seconds, self.most_segments = spark, f"{root.rstrip('/')}/{name}", retain_seconds, most_segments
        self.files = Files(spark)

    # ---- files

    def _put(self, rows: DataFrame) -> tuple[str, int]:
        """Writes rows to a new folder; its name and their number, which is counted as they are written."""
        name, seen = f"data/{uuid4().hex}", Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/{name}")
        return name, seen.get["n"]

    def _read(self, *names: str | T.StructType) -> DataFrame:
        *paths, schema = names
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def _live(self, table: Table, segments: tuple[Segment, ...]) -> DataFrame:
        """What is left of segments that follow one another."""
        schema = table.struct()
        if not segments:
            return self.spark.createDataFrame([], schema)
        if table.kind == "summed" and len(segments) > 1:
            numbers = [f.name for f in schema.fields if f.name not in table.by]
            rows = self._read(*[s.path for s in segments], schema).groupBy(*table.by).agg(*[F.sum(c).cast(schema[c].dataType).alias(c) for c in numbers])
            return rows.where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in numbers])).select(*schema.names)
        graves = [s for s in segments[1:] if s.gone]
        if not graves:
            return self._read(*[s.path for s in segments], schema)
        last = max(s.seq for s in graves)
        after = [s for s in segments if s.seq >= last]
        before = [s for s in segments if s.seq < last]
        rows = merged([self._read(s.path, schema).withColumn("_seq", F.lit(s.seq)) for s in before])
        only = T.StructType([schema[table.key]])
        gone = merged([self._read(s.gone, only).withColumn("_at", F.lit(s.seq)) for s in graves]).groupBy(table.key).agg(F.max("_at").alias("_at"))
        if sum(s.gone_rows for s in graves) <= BROADCAST_KEYS:
            gone = F.broadcast(gone)
        kept = rows.join(gone, table.key, "left").where(F.col("_at").isNull() | (F.col("_seq") >= F.col("_at"))).select(*schema.names)
        return kept.unionByName(self._read(*[s.path for s in after], schema))

    def _compacted(self, table: Table) -> Table:
        """The table with its newest segments merged, where it has too many."""
        if len(table.segments) <= self.most_segments:
            return table
        first, size = len(table.segments) - 2, table.segments[-1].size + table.segments[-2].size
        while first and table.segments[first - 1].size <= size:
            first -= 1
            size += table.segments[first].size
        part = table.segments[first:]
        rows = self._live(table, part)
        path, n = self._put(rows.sortWithinPartitions(*table.order) if table.order else rows)
        graves, gone = [s.gone for s in part if s.gone], (None, 0)
        if first and graves:  # the segments before still need the keys that are gone
            gone = self._put(self._read(*graves, T.StructType([table.struct()[table.key]])).distinct())
        done = Segment(part[-1].seq, path, n, *gone)
        return Table(table.kind, table.schema, (*table.segments[:first], done), table.key, table.by, table.order)

    # ---- versions

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.list(f"{self.path}/log") if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.version() if version is None else version
        return Manifest.loads(self.files.read(f"{self.path}/log/{version:012d}.json")) if version else Manifest()

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The tables of the newest version, or of another that is still there."""
        return Snapshot(self, self.manifest(version))

    @contextmanager
    def reading(self, version: int | None = None) -> Iterator[Snapshot]:
        """A snapshot that no expiry touches until the block ends."""
        found = self.snapshot(version)
        lease = f"{self.path}/readers/{uuid4().hex}.json"
        self.files.write(lease, json.dumps({"version": found.version}))
        try:
            yield found
        finally:
            delete_path(self.spark, lease)

    def begin(self) -> Commit:
        return Commit(self)

    def expire(self, age_seconds: float, lease_seconds: float = 86_400) -> list[int]:
        """Deletes versions older than an age that are neither the newest nor held by a reader, then files that no
        version names; the numbers of the versions. A lease older than lease_seconds is of a reader that has died."""
        now = 1000 * time.time()
        held = set()
        for name, at in self.files.list(f"{self.path}/readers").items():
            if now - at > 1000 * lease_seconds:
                delete_path(self.spark, f"{self.path}/readers/{name}")
            elif name.endswith(".json"):
                held.add(json.loads(self.files.read(f"{self.path}/readers/{name}"))["version"])
        every = self.versions()
        written = self.files.list(f"{self.path}/log")
        # a version is in use until the next one comes: its age counts from there
        old = [v for v, after in zip(every, every[1:]) if v not in held and now - written.get(f"{after:012d}.json", now) >= 1000 * age_seconds]
        if not old:
            return []
        for v in old:
            delete_path(self.spark, f"{self.path}/log/{v:012d}.json")
        named = set().union(*[self.manifest(v).files() for v in self.versions()])
        for name, at in self.files.list(f"{self.path}/data").items():
            if f"data/{name}" not in named and now - at >= 1000 * age_seconds:  # younger ones may be of a commit on its way
                delete_path(self.spark, f"{self.path}/data/{name}")
        return old

    # ---- tables

    def tables(self) -> list[str]:
        return self.snapshot().tables()

    def table(self, name: str) -> DataFrame:
        """A table of the newest version. The DataFrame stays with that version."""
        return self.snapshot().table(name)

    def save(self, tables: dict[str, DataFrame]) -> int:
        """One version in which these tables are replaced; the others stay as they are."""
        step = self.begin()
        for name, rows in tables.items():
            step.replace(name, rows)
        return step.commit()

    def applied(self, stream: str) -> int:
        """The last batch of a stream that a commit has noted; -1 before the first."""
        return self.manifest().ledger.get(stream, -1)

    def export_json(self, folder: str) -> None:
        with self.reading() as now:
            for name in now.tables():
                now.table(name).write.mode("overwrite").json(f"{folder}/{name}")

    def import_json(self, folder: str, schemas: dict[str, str]) -> None:
        self.save({n: self.spark.read.schema(s).json(f"{folder}/{n}") for n, s in schemas.items()})

    def file(self, path: str) -> DataFrame:
        return self.table("files").where(F.col("path") == path)

    def counts(self) -> dict[str, int]:
        """Rows of each table."""
        now = self.snapshot()
        return {n: now.table(n).count() for n in now.tables()}

    def clear(self) -> None:
        delete_path(self.spark, self.path)


def stores(spark: SparkSession, root: str) -> DataFrame:
    """name, bytes of each store under root."""
    p, fs = Files(spark).path(root)
    found = [(s.getPath().getName(), fs.getContentSummary(s.getPath()).getLength()) for s in fs.listStatus(p)] if fs.exists(p) else []
    return spark.createDataFrame(found, "name string, bytes long")


def clear_all(spark: SparkSession, root: str) -> int:
    """Removes every store under root; how many there were."""
    names = [r["name"] for r in stores(spark, root).collect()]
    for name in names:
        Store(spark, root, name).clear()
    return len(names)
