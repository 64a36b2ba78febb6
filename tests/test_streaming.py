"""The change feed."""

import time

from pyspark.sql import functions as F

from sparkloom.streaming import changes


def test_debounce_defaults():
    r = changes.Debounce()
    assert (r.quiet_ms, r.longest_ms, r.most_paths) == (500, 5000, 100)


def test_flushes(spark):
    burst = [("k", f"p{i}", 1000 + i) for i in range(120)]
    trickle = [("t", "p", i * 400) for i in range(20)]
    rows = spark.createDataFrame(burst + trickle + [("o", "one", 0)], "key string, path string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = sorted((r.key, r.paths, r.reason, int(r.flushed_at.timestamp() * 1000)) for r in changes.flushes(rows, changes.Debounce()).collect())
    assert ("k", 100, "paths", 1099) in got and ("k", 20, "quiet", 1619) in got
    assert ("o", 1, "quiet", 500) in got
    assert ("t", 1, "longest", 5000) in got


def test_flush_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = str(tmp_path / "in")
    spark.createDataFrame([("k", f"p{i % 7}") for i in range(20)], "key string, path string").write.parquet(folder)
    events = spark.readStream.schema("key string, path string").parquet(folder)
    q = changes.flush_stream(events, changes.Debounce(500, 5000, 7)).writeStream.format("memory").queryName("flushed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    until = time.time() + 60
    while time.time() < until and not spark.sql("SELECT * FROM flushed").count():
        time.sleep(0.5)
    q.stop()
    assert [(r.key, r.paths, r.reason) for r in spark.sql("SELECT * FROM flushed").collect()] == [("k", 7, "paths")]


def test_watch_and_hidden(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("/r/a",), ("/r/.git/b",)], "path string").write.parquet(folder)
    seen = []
    stream = changes.visible(spark.readStream.schema("path string").parquet(folder))
    changes.watch(stream, lambda df, n: seen.extend(r.path for r in df.collect()), str(tmp_path / "c"), None).awaitTermination(60)
    assert seen == ["/r/a"]


def test_daemon_reindexes(spark, tmp_path):
    """The first index, then another after a micro-batch with visible paths, and none after hidden ones only."""
    from sparkloom.operators.indexing import IndexConfig, Store

    schema = "path string, content string, language string"
    now = [("a.py", "def a():\n    return 'a long enough text to be kept as a chunk of its own'\n", "python")]
    scan = lambda: spark.createDataFrame(now, schema)
    store, folder = Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    spark.createDataFrame([("/r/b.py",)], "path string").write.parquet(folder)
    events = lambda: spark.readStream.schema("path string").parquet(folder)
    changes.daemon(store, scan, spark.readStream.schema("path string").parquet(folder), str(tmp_path / "c0"), None, IndexConfig("fast")).awaitTermination(60)
    assert {r.path for r in store.table("files").collect()} == {"a.py"}
    now.append(("b.py", "x = 1\n", "python"))
    changes.watch(events(), changes.reindex(store, scan, IndexConfig("fast")), str(tmp_path / "c1"), None).awaitTermination(60)
    assert {r.path for r in store.table("files").collect()} == {"a.py", "b.py"}
    version = store.version()
    changes.reindex(store, scan)(spark.createDataFrame([("/r/.git/x",)], "path string"), 0)
    assert store.version() == version
