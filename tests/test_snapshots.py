"""The store's snapshot log, incremental postings, and the change source with exactly-once reindexing."""

import os
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import indexing, snapshots
from sparkloom.sources import tree_changes as tc
from sparkloom.streaming import changes

FILES = "path string, content string, language string"
FAST = indexing.IndexConfig("fast", syntax=False)


def rows(df, *names):
    return sorted(map(str, df.select(*names).collect() if names else df.collect()))


def text(i, n=3):
    return "\n".join(f"line {k} of file {i} holds the words alpha{i % 5} beta{k}" for k in range(n)) + "\n"


@pytest.fixture
def store(spark, tmp_path):
    return indexing.Store(spark, str(tmp_path / "root"))


def test_keyed_and_summed_tables_equal_a_model(spark, tmp_path):
    """Any sequence of changes, with merged segments, equals a dict."""
    for seed in (5,):
        rng = random.Random(seed)
        store = snapshots.Store(spark, str(tmp_path), f"s{seed}", retain_seconds=0, most_segments=3)
        held, sums = {}, {}
        for turn in range(9):
            step = store.begin()
            new = {rng.randrange(12): rng.randrange(100) for _ in range(rng.randrange(5))}
            gone = set(new) | {rng.randrange(12) for _ in range(rng.randrange(3))}
            numbers = [(rng.randrange(4), rng.randrange(-1, 2)) for _ in range(3)]
            step.change("t", spark.createDataFrame(list(new.items()), "k int, v int"), spark.createDataFrame([(k,) for k in gone], "k int"), "k", ("k",))
            step.add("s", spark.createDataFrame(numbers, "k int, n int"), ("k",))
            assert step.commit(("q", turn)) == turn + 1
            held = {k: v for k, v in held.items() if k not in gone} | new
            for k, n in numbers:
                sums[k] = sums.get(k, 0) + n
            if turn % 3 == 2:
                assert {r.k: r.v for r in store.table("t").collect()} == held
                assert {r.k: r.n for r in store.table("s").collect()} == {k: n for k, n in sums.items() if n}
        now = store.manifest()
        assert all(len(t.segments) <= 3 for t in now.tables.values()) and store.applied("q") == 8 and store.applied("other") == -1
        assert store.versions() == [9]
        named = {p.split("/")[1] for p in now.files()}
        assert set(os.listdir(f"{store.path}/data")) == named  # nothing is left over


def test_readers_survive_index_runs(spark, store):
    files = [(f"d/{i}.txt", text(i), None) for i in range(6)]
    indexing.index_files(store, spark.createDataFrame(files, FILES), FAST)
    assert store.version() == 1  # one commit for a run
    held, before = store.table("chunks"), rows(store.table("chunks"), "id")
    for i in range(2):
        files[i] = (files[i][0], text(90 + i), None)
        indexing.index_files(store, spark.createDataFrame(files, FILES), FAST)
    assert store.version() == 3 and rows(held, "id") == before
    assert not [r for r in store.table("chunks").collect() if "file 0 " in r.content]
    with store.reading(1) as old:
        assert store.expire(0) == [2]
        assert rows(old.table("chunks"), "id") == before
    assert store.expire(0) == [1] and store.versions() == [3] and os.listdir(f"{store.path}/readers") == []
    assert rows(held, "id") == before  # its files are part of the newest version as well
    indexing.upgrade(store, lambda: spark.createDataFrame(files, FILES), FAST)
    assert store.expire(0) == [3] and set(os.listdir(f"{store.path}/data")) == {p.split("/")[1] for p in store.manifest().files()}
    with pytest.raises(Exception):
        held.collect()
    chunks = store.table("chunks")
    assert {r.file_path for r in chunks.collect()} == {f[0] for f in files}


def test_a_changed_file_rewrites_little(spark, store):
    files = [(f"d/{i}.txt", text(i, 40), None) for i in range(200)]
    indexing.index_files(store, spark.createDataFrame(files, FILES), FAST)
    size = lambda names: sum(os.path.getsize(os.path.join(d, f)) for n in names for d, _, fs in os.walk(f"{store.path}/{n}") for f in fs if f.endswith(".parquet"))
    first = store.manifest().files()
    files[7] = ("d/7.txt", text(777, 40), None)
    metrics = indexing.index_files(store, spark.createDataFrame(files[:199], FILES), FAST)
    assert (metrics["total_files"], metrics["indexed"], metrics["skipped"]) == (199, 1, 198)
    second = store.manifest().files()
    assert first < second
    by = {n: (t.segments[-1].rows, t.segments[-1].gone_rows) for n, t in store.manifest().tables.items()}
    assert by["files"] == (1, 2) and by["contents"] == (1, 2) and by["lengths"] == (1, 0)
    assert 0 < by["postings"][0] < 200 and size(second - first) < size(first)


def test_conflicting_commits(spark, store):
    one = spark.createDataFrame([(1,)], "a int")
    store.save({"x": one})
    first, second, third = store.begin(), store.begin(), store.begin()
    for step, name in ((first, "x"), (second, "y"), (third, "x")):
        step.replace(name, one)
    assert first.commit() == 2 and second.commit() == 3  # another table: on top of the first
    with pytest.raises(snapshots.CommitConflict):
        third.commit()
    assert store.version() == 3 and store.tables() == ["x", "y"]


def test_postings_equal_a_rebuild(spark, tmp_path):
    """Any sequence of additions, changes and removals gives the tables of a rebuild."""
    rng = random.Random(11)
    store = indexing.Store(spark, str(tmp_path), "kept", most_segments=3)
    files: dict = {}
    for turn in range(6):
        for i in rng.sample(range(10), 4):
            if rng.random() < 0.3:
                files.pop(f"{i}.txt", None)
            else:
                files[f"{i}.txt"] = rng.choice([text(rng.randrange(20), rng.randrange(1, 60)), "", "x\n" * 300])
        indexing.index_files(store, spark.createDataFrame([(p, c, None) for p, c in files.items()], FILES), FAST)
    again = indexing.Store(spark, str(tmp_path), "again")
    indexing.index_files(again, spark.createDataFrame([(p, c, None) for p, c in files.items()], FILES), FAST)
    for name in ("chunks", "contents", "postings", "terms", "lengths", "idf", "corpus"):
        assert rows(store.table(name)) == rows(again.table(name)), name
    assert rows(store.table("files"), "path", "hash") == rows(again.table("files"), "path", "hash")
    emptied = indexing.index_files(store, spark.createDataFrame([], FILES), FAST)
    assert emptied["chunks"] == 0 and store.table("postings").isEmpty() and store.table("terms").isEmpty() and store.table("corpus").first().average == 500


# ---- change source


def tree(folder, **files):
    for name, content in files.items():
        path = folder / name.replace("__", "/").replace("_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)


def test_differences_and_snapshots(tmp_path):
    old = {"a": [1, 5, 7], "b": [1, 5, 8], "c": [1, 5, 9]}
    new = {"a": [1, 5, 7], "b": [1, 6, 8], "d": [1, 5, 9]}
    assert list(tc.differences(old, new, 99)) == [("b", "modify", 6), ("c", "remove", 99), ("d", "create", 5)]
    own = tc.Snapshots(str(tmp_path), 3)
    own.write(1, old, 4)
    assert own.whole(1) == old and own.whole(0) == {} and own.numbers() == [1] and own.about(1) == {"at": 4, "shards": 3}
    own.remove(1)
    assert own.numbers() == [] and os.listdir(tmp_path) == []


def test_source_misses_and_doubles_nothing(spark, tmp_path):
    """Edits, renames, removals, with restarts between and a batch that is run again."""
    root, seen = tmp_path / "tree", []
    tree(root, a_py="a", b_py="b", sub__c_py="c", _gitignore="x.py\n")
    stream = tc.tree_changes(spark, str(root), str(tmp_path / "snapshots"), shards=3)

    def note(df, n):
        seen.extend((n, r.kind, r.path.removeprefix(f"{root}/")) for r in df.collect())

    def once(fail=False):
        def broken(df, n):
            note(df, n)
            raise RuntimeError("killed between the sink and the checkpoint")

        q = changes.watch(stream, broken if fail else note, str(tmp_path / "checkpoint"), None)
        try:
            q.awaitTermination(60)
        except Exception:
            assert fail
        found = sorted((k, p) for _, k, p in seen)
        seen.clear()
        return found

    assert once() == []  # the stream starts from the tree as it is
    tree(root, a_py="longer", d_py="d", x_py="ignored")
    (root / "b.py").rename(root / "e.py")
    (root / "sub" / "c.py").unlink()
    want = [("create", "d.py"), ("create", "e.py"), ("modify", "a.py"), ("remove", "b.py"), ("remove", "sub/c.py")]
    assert once(fail=True) == want
    tree(root, f_py="f")
    assert once() == want  # the batch again, with the same rows
    assert once() == [("create", "f.py")] and once() == []
    tree(root, a_py="same s")  # the same size
    assert once() == [("modify", "a.py")] and once() == []


def test_watch_tree_reindexes_after_restart(spark, tmp_path):
    root = tmp_path / "tree"
    tree(root, a_py="def a():\n    return 1\n", _hidden__h_py="x = 1\n")
    store = indexing.Store(spark, str(tmp_path / "root"))
    run = lambda: changes.watch_tree(store, str(root), str(tmp_path / "c"), None, FAST).awaitTermination(90)
    run()
    have = lambda: {r.path.removeprefix(f"{root}/") for r in store.table("files").collect()}
    assert have() == {"a.py", ".hidden/h.py"} and store.version() == 1
    (root / "a.py").rename(root / "b.py")
    tree(root, c_py="y = 2\n")
    run()
    assert have() == {"b.py", "c.py", ".hidden/h.py"} and store.version() == 2
    tree(root, _hidden__h_py="x = 3\n")
    run()
    assert store.version() == 2  # hidden files alone do not count


def test_flushes_of_a_tree_reindex(spark, tmp_path):
    root = tmp_path / "tree"
    tree(root, a_py="def a():\n    return 1\n")
    store = indexing.Store(spark, str(tmp_path / "root"))
    start = lambda: changes.watch_tree(store, str(root), str(tmp_path / "c"), "200 milliseconds", FAST, changes.Debounce(300, 3000, 100))

    def until(version):
        q, end = start(), time.time() + 90
        while store.version() < version and time.time() < end and q.isActive:
            time.sleep(0.3)
        time.sleep(2)  # let the batch end
        q.stop()
        assert store.version() == version, q.exception()

    until(1)
    (root / "a.py").unlink()
    tree(root, b_py="def b():\n    return 2\n")
    until(2)
    assert {r.path for r in store.table("files").collect()} == {f"{root}/b.py"}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    """The batch commits, the query dies before its checkpoint, and the batch is run again."""
    root, store, checkpoint = tmp_path / "tree", indexing.Store(spark, str(tmp_path / "root")), tmp_path / "c"
    tree(root, a_py="def a():\n    return 1\n")
    run = lambda: changes.watch_tree(store, str(root), str(checkpoint), None, FAST).awaitTermination(90)
    run()
    tree(root, b_py="def b():\n    return 2\n")
    run()
    before, version = rows(store.table("chunks")), store.version()
    last = max((checkpoint / "commits").iterdir(), key=lambda p: (p.name.isdigit(), int(p.name) if p.name.isdigit() else 0))
    last.unlink()
    shutil.rmtree(checkpoint / "commits" / f".{last.name}.crc", ignore_errors=True)
    (checkpoint / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert store.version() == version and rows(store.table("chunks")) == before
    assert indexing.index_files(store, spark.createDataFrame([], FILES), FAST, (str(checkpoint), 0))["replayed"] and store.version() == version
    tree(root, c_py="def c():\n    return 3\n")
    run()
    assert store.version() == version + 1 and rows(store.table("files"), F.col("path").endswith("c.py").alias("c")).count("Row(c=True)") == 1
