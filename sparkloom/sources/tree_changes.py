"""A streaming source of the changes of a source tree.

An offset is the number of a snapshot of the tree: path, size, time of change and file number of each file that its ignore
rules leave. Snapshots are written, in shards by a hash of the path, to a folder beside the stream's checkpoint before
their number becomes an offset; the rows between two offsets are the differences of two snapshots, shard by shard in
tasks. So a batch that is run again after a failure gives the same rows, and what changes while no query runs is found by
the first batch of the next one: no change is lost or doubled.

Rows are key (the root), path, kind (create, modify or remove) and ts (the file's time of change; of a removal, the time
of the snapshot that lacks it). A rename is a removal and a creation. A file that changes twice between two snapshots
gives one row, one that comes and goes between them none. A file that is replaced with the same size within the clock's
resolution is told by its file number.

    spark.dataSource.register(TreeChanges)
    spark.readStream.format("tree_changes").option("snapshots", folder).load(root)

Options: snapshots (the folder, required, which driver and executors share), initial ("true": the first batch creates
every file that is there; default: the stream starts from the tree as it is), shards (8).
"""

from __future__ import annotations

import json
import os
import time
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sparkloom.sources.files import tree_paths

SCHEMA = "key string, path string, kind string, ts timestamp"

State = dict[str, list[int]]  # size, time of change in ns, file number, by path


def tree_state(root: str) -> State:
    out = {}
    for path in tree_paths(root):
        try:
            s = os.stat(path)
        except OSError:  # gone since it was listed
            continue
        out[path] = [s.st_size, s.st_mtime_ns, s.st_ino]
    return out


def differences(old: State, new: State, at_ns: int) -> Iterator[tuple[str, str, int]]:
    """path, kind and time (ns) of each change, by path."""
    for path in sorted(old.keys() | new.keys()):
        if path not in new:
            yield path, "remove", at_ns
        elif path not in old:
            yield path, "create", new[path][1]
        elif old[path] != new[path]:
            yield path, "modify", new[path][1]


class Snapshots:
    """Snapshots under a folder: <number>/<shard>.json, complete once <number>.done is there."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = Path(folder.removeprefix("file://").removeprefix("file:")), shards

    def numbers(self) -> list[int]:
        return sorted(int(p.stem) for p in self.folder.glob("*.done")) if self.folder.exists() else []

    def write(self, number: int, state: State, at_ns: int) -> None:
        own = self.folder / str(number)
        own.mkdir(parents=True, exist_ok=True)
        parts: list[State] = [{} for _ in range(self.shards)]
        for path, x in state.items():
            parts[zlib.crc32(path.encode("utf-8", "surrogateescape")) % self.shards][path] = x
        for i, part in enumerate(parts):
            (own / f"{i}.json").write_text(json.dumps(part))
        done = self.folder / f"{number}.tmp"
        done.write_text(json.dumps({"at": at_ns, "shards": self.shards}))
        done.rename(self.folder / f"{number}.done")

    def about(self, number: int) -> dict:
        return json.loads((self.folder / f"{number}.done").read_text())

    def shard(self, number: int, shard: int) -> State:
        """A shard of a snapshot; the one before all is empty."""
        return json.loads((self.folder / str(number) / f"{shard}.json").read_text()) if number else {}

    def whole(self, number: int) -> State:
        return {k: v for i in range(self.shards) for k, v in self.shard(number, i).items()}

    def remove(self, number: int) -> None:
        (self.folder / f"{number}.done").unlink(missing_ok=True)
        for p in (self.folder / str(number)).glob("*"):
            p.unlink(missing_ok=True)
        if (self.folder / str(number)).exists():
            (self.folder / str(number)).rmdir()


class _Shard(InputPartition):
    def __init__(self, start: int, end: int, shard: int):
        super().__init__((start, end, shard))


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str, folder: str, shards: int, initial: bool):
        self.root, self.initial = root, initial
        self.snapshots = Snapshots(folder, shards)
        self.last: tuple[int, State] | None = None

    def _latest(self) -> tuple[int, State] | None:
        if self.last is None and (known := self.snapshots.numbers()):
            self.snapshots.shards = self.snapshots.about(known[-1])["shards"]  # a stream keeps its number of shards
            self.last = known[-1], self.snapshots.whole(known[-1])
        return self.last

    def _take(self) -> int:
        """The number of a snapshot that equals the tree: the last one's, or that of a new one."""
        known, now = self._latest(), tree_state(self.root)
        if known is None or known[1] != now:
            number = known[0] + 1 if known else 1
            self.snapshots.write(number, now, time.time_ns())
            self.last = number, now
        return self.last[0]

    def initialOffset(self) -> dict:
        return {"snapshot": 0 if self.initial else self._take()}

    def latestOffset(self) -> dict:
        return {"snapshot": self._take()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["snapshot"], end["snapshot"]
        return [_Shard(a, b, i) for i in range(self.snapshots.about(b)["shards"])] if a < b else []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start, end, shard = partition.value
        at = self.snapshots.about(end)["at"]
        for path, kind, ns in differences(self.snapshots.shard(start, shard), self.snapshots.shard(end, shard), at):
            yield self.root, path, kind, datetime.fromtimestamp(ns // 1000 / 1e6, timezone.utc)

    def commit(self, end: dict) -> None:
        for number in self.snapshots.numbers():
            if number < end["snapshot"]:
                self.snapshots.remove(number)


class TreeChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        if "path" not in self.options or "snapshots" not in self.options:
            raise ValueError("tree_changes needs a path and the option snapshots")
        root = os.path.abspath(self.options["path"].removeprefix("file://"))
        return _Reader(root, self.options["snapshots"], int(self.options.get("shards", "8")), self.options.get("initial", "false").lower() == "true")


def tree_changes(spark, root: str, snapshots: str, initial: bool = False, shards: int = 8):
    """The stream of a tree's changes."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("tree_changes").option("snapshots", snapshots).option("initial", str(initial)).option("shards", shards).load(root)
