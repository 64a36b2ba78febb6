"""Line dedup: lines that are found in several documents stay in one of them.

A line's key is the line without white space at its ends, A-Z lower-cased; keys of at least `least_chars` code points
that at least `least_docs` documents hold lose all their lines except in the document of the largest id that holds them.

Keys are 128-bit hashes, kept in levelled sorted runs (LineRuns): each batch of documents is merge-joined with the runs
that are there, the keys that the runs have settled are anti-joined away, and the rest is added as a run of its own;
when `fanout` runs of a level have come together, they are compacted to one of the next level. Runs are bucketed and
sorted by hash, so a join with them shuffles and sorts the batch alone. A key is settled when it has enough documents
and a larger id than any of the batch's; batches come by falling id, so that happens early, but no result depends on
the order.

Documents are rows: repeated rows are documents of their own, and where several share a key's largest id, all of them
keep it. A null id is smaller than any other. A null or empty text is one empty line and comes out empty. Columns of
docs with the names of results are replaced, others pass through. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.batches import numbered, slices
from sparkloom.session import delete_path, discard, scratch_path, written

_SPACE = b" \t\n\x0b\x0c\r"
_INTEGERS = ("byte", "short", "integer", "long")


def line_hash(line: bytes, least_chars: int) -> bytes | None:
    """The hash of a line's key; None for a key that is too short."""
    key = line.strip(_SPACE).lower()  # of bytes: A-Z alone
    if len(key) < least_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < least_chars:
        return None
    return blake2b(key, digest_size=16).digest()


@dataclass(frozen=True)
class _Run:
    first: int
    last: int
    table: str
    path: str

    def level(self, fanout: int) -> int:
        size, level = self.last - self.first + 1, 0
        while size >= fanout:
            size, level = size // fanout, level + 1
        return level


class LineRuns:
    """Levelled sorted runs of (h, n, top): a key's hash, how many documents of the run's batches hold it, the largest
    id among them. They lie in a folder that all executors share; a LineRuns of the same folder goes on where the last
    one stopped. A run's folder names the batches it covers, and counts once it is complete; a run that another one
    covers was compacted. The tables are entries of the session's catalogue, which close() removes."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "bigint", least_docs: int = 3, fanout: int = 4):
        self.spark, self.folder, self.id_type, self.least, self.fanout = spark, folder.rstrip("/"), id_type, least_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[_Run] = []
        self._mark = uuid4().hex[:12]
        self._open()

    def _open(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = []
        for s in fs.listStatus(path) if fs.exists(path) else []:
            m = re.fullmatch(r"run-(\d+)-(\d+)-b(\d+)", s.getPath().getName())
            if m and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                found.append(tuple(map(int, m.groups())))
        for first, last, buckets in sorted(found):
            if any(a <= first and last <= b and (a, b) != (first, last) for a, b, _ in found):
                continue
            self.buckets = buckets
            run = self._run(first, last)
            self.spark.sql(
                f"CREATE TABLE {run.table} (h BINARY, n BIGINT, top {self.id_type}) USING parquet "
                f"CLUSTERED BY (h) SORTED BY (h) INTO {buckets} BUCKETS LOCATION '{run.path}'"
            )
            self.runs.append(run)

    def _run(self, first: int, last: int) -> _Run:
        return _Run(first, last, f"line_run_{self._mark}_{first}_{last}", f"{self.folder}/run-{first}-{last}-b{self.buckets}")

    def _write(self, rows: DataFrame, first: int, last: int) -> _Run:
        run = self._run(first, last)
        rows.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").option("path", run.path).mode("overwrite").saveAsTable(run.table)
        return run

    def _read(self, run: _Run) -> DataFrame:
        return self.spark.table(run.table)

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """batch (h, top: a row for each document and key) as h, n, top, without the keys that the runs have settled."""
        new = batch.groupBy("h").agg(F.count("*").alias("n"), F.max("top").alias("top"))
        new = new.select("h", "n", "top", F.lit(0).cast("long").alias("had"), F.lit(None).cast(self.id_type).alias("had_top"))
        for run in self.runs:
            old = self._read(run).select("h", F.col("n").alias("run_n"), F.col("top").alias("run_top"))
            new = new.join(old.hint("merge"), "h", "left").select(
                "h", "n", "top", (F.col("had") + F.coalesce("run_n", F.lit(0))).alias("had"), F.greatest("had_top", "run_top").alias("had_top")
            )
        settled = (F.col("had") >= self.least) & (F.col("top").isNull() | F.coalesce(F.col("top") <= F.col("had_top"), F.lit(False)))
        return new.where(~settled).select("h", "n", "top")

    def add(self, batch: DataFrame) -> None:
        """Adds a batch of documents, none of which is in the runs: h, top, a row for each document and key."""
        at = self.runs[-1].last + 1 if self.runs else 0
        self.runs.append(self._write(self.unsettled(batch), at, at))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(same := [r for r in self.runs if r.level(self.fanout) == level]) >= self.fanout:
            run = self._write(self._merged(same), same[0].first, same[-1].last)
            self.runs = sorted([r for r in self.runs if r not in same] + [run], key=lambda r: r.first)
            for old in same:
                self._remove(old)
            level += 1

    def _remove(self, run: _Run, files: bool = True) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run.table}")
        if files:
            delete_path(self.spark, run.path)

    def _merged(self, runs: list[_Run]) -> DataFrame:
        # read by path: of bucketed tables, the planner takes a union for dealt by bucket and then adds without a shuffle
        tables = [self.spark.read.schema(self._read(r).schema).parquet(r.path) for r in runs]
        both = tables[0]
        for t in tables[1:]:
            both = both.unionByName(t)
        return both.groupBy("h").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def totals(self) -> DataFrame:
        """h, n, top over all runs. n is exact below least_docs, and at least that where it is not."""
        if not self.runs:
            return self.spark.createDataFrame([], f"h binary, n long, top {self.id_type}")
        return self._read(self.runs[0]) if len(self.runs) == 1 else self._merged(self.runs)

    def close(self, files: bool = False) -> None:
        for run in self.runs:
            self._remove(run, files)
        self.runs = []


def line_keys(rows: DataFrame, least_chars: int = 20) -> DataFrame:
    """h and rid, doc, batch for each key of each row of rows (rid, doc, batch, text: binary), once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            found = [{h for line in (t or b"").split(b"\n") if (h := line_hash(line, least_chars))} for t in batch.column(3).to_pylist()]
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found]))
            h = pa.array([h for x in found for h in x], pa.binary())
            yield pa.RecordBatch.from_arrays([h, *(batch.column(i).take(at) for i in range(3))], ["h", "rid", "doc", "batch"])

    schema = T.StructType([T.StructField("h", T.BinaryType()), *rows.schema.fields[:3]])
    return rows.mapInArrow(run, schema)


def _rebuilt(rows: DataFrame, least_chars: int) -> DataFrame:
    """rows (..., text: binary, _gone: hashes) with the lines dropped, n_lines and n_dropped."""
    names = [c for c in rows.columns if c != "_gone"]
    at_text, at_gone = rows.columns.index("text"), rows.columns.index("_gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at_text):
            kept, before, dropped = [], [], []
            for text, gone in zip(batch.column(at_text).to_pylist(), batch.column(at_gone).to_pylist()):
                lines = (text or b"").split(b"\n")
                before.append(len(lines))
                if gone:
                    hashes = set(gone)
                    lines = [x for x in lines if line_hash(x, least_chars) not in hashes]
                dropped.append(before[-1] - len(lines))
                kept.append(b"\n".join(lines))
            out = [pa.array(kept, pa.binary()) if i == at_text else batch.column(i) for i in range(batch.num_columns) if i != at_gone]
            yield pa.RecordBatch.from_arrays([*out, pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    fields = [f for f in rows.schema.fields if f.name != "_gone"] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return rows.mapInArrow(run, T.StructType(fields)).withColumn("text", F.col("text").cast("string"))


def _repeated(pairs: DataFrame, repeated: DataFrame, broadcast_keys: int, hub: int) -> DataFrame:
    """pairs joined with repeated (h, top). All of it is broadcast where it is short; if not, the keys of more than
    `hub` documents, whose rows would else meet in one task each. They are counted in pairs: a key that the runs have
    settled has too low a count there."""
    if repeated.count() <= broadcast_keys:
        return pairs.join(F.broadcast(repeated), "h")
    often = written(pairs.groupBy("h").agg(F.count("*").alias("often")).where(F.col("often") > hub), "hubs")
    while (hubs := often.where(F.col("often") > hub)).count() > broadcast_keys:
        hub *= 10
    hubs = F.broadcast(hubs.select("h"))
    rest = pairs.join(hubs, "h", "left_anti").join(repeated, "h")
    return pairs.join(F.broadcast(repeated.join(hubs, "h", "left_semi")), "h").unionByName(rest)


def deduplicated(
    docs: DataFrame,
    key: str = "doc_id",
    least_chars: int = 20,
    least_docs: int = 3,
    batches: int = 8,
    fanout: int = 4,
    broadcast_keys: int = 200_000,
    hub: int = 10_000,
) -> DataFrame:
    """docs (key, text, ...) with the text that is left, n_lines (before dropping) and n_dropped.

    batches: in how many parts the documents are added to the runs.
    """
    spark = docs.sparkSession
    rows = numbered(docs.drop("n_lines", "n_dropped", "_gone"), key)
    kind = rows.schema[key].dataType
    if kind.typeName() in _INTEGERS:
        cuts = rows.agg(F.percentile_approx(F.col(key).cast("double"), [i / batches for i in range(1, batches + 1)], 1000)).first()[0] or []
        part = sum([(F.coalesce(F.col(key).cast("double") <= c, F.lit(True))).cast("int") for c in cuts[:-1]], F.lit(0))
    else:
        part = F.pmod(F.xxhash64("_rid"), F.lit(batches)).cast("int")
    narrow = rows.select(F.col("_rid").alias("rid"), F.col(key).alias("doc"), part.alias("batch"), F.col("text").cast("binary").alias("text"))
    pairs_at = scratch_path(spark, "line-keys")
    line_keys(narrow, least_chars).write.partitionBy("batch").parquet(pairs_at, compression="zstd")
    pairs = spark.read.schema(T.StructType([T.StructField("h", T.BinaryType()), T.StructField("rid", T.LongType()), T.StructField("doc", kind), T.StructField("batch", T.IntegerType())])).parquet(pairs_at)

    runs = LineRuns(spark, scratch_path(spark, "line-runs"), kind.simpleString(), least_docs, fanout)
    for i in range(batches):
        runs.add(pairs.where(F.col("batch") == i).select("h", F.col("doc").alias("top")))
    repeated = written(runs.totals().where(F.col("n") >= least_docs).select("h", "top"), "repeated-lines")
    runs.close(files=True)

    found = _repeated(pairs.select("h", "rid", "doc"), repeated, broadcast_keys, hub).where(~F.col("doc").eqNullSafe(F.col("top")))
    gone = written(found.groupBy(F.col("rid").alias("_rid")).agg(F.collect_list("h").alias("_gone")), "dropped-lines")
    discard(repeated)
    delete_path(spark, pairs_at)
    joined = rows.join(gone.hint("merge"), "_rid", "left").drop("_rid")
    return _rebuilt(joined.withColumn("text", F.col("text").cast("binary")), least_chars)
