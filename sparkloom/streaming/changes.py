"""The change feed: debounced flushes of changed paths, and reindexing by micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Debounce:
    """A flush comes after a quiet time, after the longest wait since the first change, or at a number of paths."""

    quiet_ms: int = 500
    longest_ms: int = 5000
    most_paths: int = 100


def visible(events: DataFrame, path: str = "path") -> DataFrame:
    """Events of other than hidden paths."""
    return events.where(~F.contains(F.col(path), F.lit("/.")))


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Runs of a key's events with gaps below `gap`: key, start, events. In batch and in streams alike."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), "events")


FLUSH_SCHEMA = "key string, flushed_at timestamp, paths long, reason string"


def flushes(events: DataFrame, rule: Debounce, key: str = "key", path: str = "path", ts: str = "ts") -> DataFrame:
    """key, flushed_at, paths, reason of each flush of a finished feed, by event time.

    Each key's events stream through one worker in order; keys are roots that are watched, and state is the distinct
    paths since the last flush, at most most_paths of them.
    """

    columns = ["key", "flushed_at", "paths", "reason"]

    def run(batches):
        now, paths, first, last = None, set(), 0, 0  # of one key, since its last flush
        out: list[tuple] = []

        def flush(at: int, reason: str) -> None:
            out.append((now, pd.Timestamp(at, unit="ms"), len(paths), reason))
            paths.clear()

        for batch in batches:
            for k, p, t in zip(batch["key"], batch["path"], batch["ms"]):
                if paths:
                    at, reason = min((last + rule.quiet_ms, "quiet"), (first + rule.longest_ms, "longest"), key=lambda x: x[0])
                    if k != now or at <= t:
                        flush(at, reason)
                now, last = k, t
                first = first if paths else t
                paths.add(p)
                if len(paths) >= rule.most_paths:
                    flush(t, "paths")
            yield pd.DataFrame(out, columns=columns)
            out.clear()
        if paths:
            flush(*min((last + rule.quiet_ms, "quiet"), (first + rule.longest_ms, "longest"), key=lambda x: x[0]))
        yield pd.DataFrame(out, columns=columns)

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(path).cast("string").alias("path"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))
    return rows.repartition("key").sortWithinPartitions("key", "ms", "path").mapInPandas(run, FLUSH_SCHEMA)


def flush_stream(events: DataFrame, rule: Debounce) -> DataFrame:
    """The same on a stream (key, path), by arrival: distinct paths are state, processing-time timers flush."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.paths = handle.getMapState("paths", "path string", "at long")
            self.times = handle.getValueState("times", "first long, last long")

        def _emit(self, key, reason: str, at: int):
            n = sum(1 for _ in self.paths.keys())
            self.paths.clear()
            self.times.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            return pd.DataFrame([(str(key[0]), pd.Timestamp(at, unit="ms"), n, reason)], columns=["key", "flushed_at", "paths", "reason"])

        def handleInputRows(self, key, rows, timerValues):
            now = timerValues.getCurrentProcessingTimeInMs()
            first = self.times.get()[0] if self.times.exists() else now
            for batch in rows:
                for p in batch["path"]:
                    self.paths.updateValue((p,), (now,))
            self.times.update((first, now))
            if sum(1 for _ in self.paths.keys()) >= rule.most_paths:
                yield self._emit(key, "paths", now)
                return
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(min(now + rule.quiet_ms, max(first + rule.longest_ms, now + 1)))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = timerValues.getCurrentProcessingTimeInMs()
            first, last = self.times.get() if self.times.exists() else (now, now)
            yield self._emit(key, "longest" if now - first >= rule.longest_ms else "quiet", now)

        def close(self) -> None:
            pass

    return events.groupBy("key").transformWithStateInPandas(Processor(), outputStructType=FLUSH_SCHEMA, outputMode="append", timeMode="ProcessingTime")


def watch(files: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "1 second"):
    """Runs action on each micro-batch of a stream; a handle with stop() and awaitTermination(). every=None: what is
    there now, then stop."""
    writer = files.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def reindex(store, scan: Callable[[], DataFrame], config=None, stream: str | None = None) -> Callable[[DataFrame, int], None]:
    """The action of a watch: when a micro-batch holds visible paths, or flushes, the store is brought up to date with all
    files that scan gives, incrementally. The paths themselves only say that something changed.

    stream: a name of the stream for the store's ledger, which is committed with the data: a batch that is run again
    after a failure between the commit and the stream's checkpoint changes nothing.
    """
    from sparkloom.operators.indexing import index_files

    def action(events: DataFrame, batch: int) -> None:
        if stream is not None and store.applied(stream) >= batch:
            return
        # counted, not asked whether it is empty: all partitions of a stateful stream must run, or its state is not kept
        if (visible(events) if "path" in events.columns else events).count():
            index_files(store, scan(), config, None if stream is None else (stream, batch))

    return action


def daemon(store, scan: Callable[[], DataFrame], events: DataFrame, checkpoint: str, every: str | None = "1 second", config=None):
    """Indexes all files once, then again after each micro-batch of change events; watch()'s handle."""
    from sparkloom.operators.indexing import index_files

    index_files(store, scan(), config)
    return watch(events, reindex(store, scan, config, checkpoint), checkpoint, every)


def watch_tree(store, root: str, checkpoint: str, every: str | None = "1 second", config=None, rule: Debounce | None = None, scan: Callable[[], DataFrame] | None = None):
    """Keeps a store up to date with a source tree; watch()'s handle.

    The first batch holds every file and so makes the first index; after a restart from the checkpoint, the next batch
    holds what changed meanwhile. Changes of hidden files do not count. rule: changes are collected to flushes first.
    """
    from sparkloom.sources.files import scan_tree
    from sparkloom.sources.tree_changes import tree_changes

    spark = store.spark
    events = tree_changes(spark, root, f"{checkpoint.rstrip('/')}-snapshots", initial=True)
    events = events.where(~F.contains(F.expr("substring(path, length(key) + 1)"), F.lit("/.")))
    if rule is not None:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        events = flush_stream(events.select("key", "path"), rule)
    else:
        events = events.select("key", F.expr("substring(path, length(key) + 1)").alias("path"))
    return watch(events, reindex(store, scan or (lambda: scan_tree(spark, root)), config, checkpoint), checkpoint, every)


def gap_number(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """events with the running number of the key's session: one more where the gap is gap_seconds or longer."""
    order = Window.partitionBy(key).orderBy(ts)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    wide = at - F.lag(at).over(order) >= gap_seconds * 1_000_000
    return events.withColumn("session", F.sum(F.coalesce(wide, F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
