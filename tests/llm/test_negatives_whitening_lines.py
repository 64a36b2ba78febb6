"""Hard negatives, whitening and line dedup against brute force."""

import hashlib
import math
import os
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import hard_negatives, line_dedup, whitening
from sparkloom.llm import queries as Q
from sparkloom.session import scratch_path

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, label int, embedding array<float>"


# ---- 11 hard negatives


def mined(rows, positives=5, negatives=3, scale=256):
    """Brute force over (id, label, vector); anchors are ids divisible by 50."""
    ok = lambda v: v is not None and all(c is not None and math.isfinite(c) for c in v)
    rows = [(i, y, [math.floor(scale * float(np.float32(c))) for c in v]) for i, y, v in rows if y is not None and ok(v)]
    big = 1 << 70
    out = []
    for a, (ai, ay, av) in enumerate(rows):
        if ai is None or ai % 50:
            continue
        scored = [(sum(p * q for p, q in zip(av, v)), big if i is None else i, y) for r, (i, y, v) in enumerate(rows) if r != a and len(v) == len(av)]
        best = sorted((-s, i) for s, i, y in scored if y == ay)[:positives]
        for ps, pi in best:
            fit = sorted((-s, i) for s, i, y in scored if y != ay and 50 * -ps <= 100 * s <= 95 * -ps)[:negatives]
            out += [(ai, None if pi == big else pi, n + 1, None if ni == big else ni, -ps, -ns) for n, (ns, ni) in enumerate(fit)]
    return sorted(map(str, out))


def test_hard_negatives_ties_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [rng.randrange(-3, 4) / 8 for _ in range(6)]) for i in range(400)]
    rows += [(50, 1, [0.5] * 6), (50, 1, [0.5] * 6), (None, 1, [0.5] * 6), (None, 2, [0.25] * 6), (500, None, [1.0] * 6), (501, 1, None)]
    rows += [(502, 1, [1.0, None]), (550, 1, [math.nan] * 6), (600, 1, [math.inf] + [0.0] * 5), (650, 2, []), (651, 2, []), (652, 1, [])]
    rows += [(700, 1, [1.0, 2.0]), (701, 1, [2.0, 1.0]), (702, 2, [1.0, 1.0]), (750, 1, [-100.0, 99.5]), (751, 1, [-100.0, 98.0]), (752, 0, [-60.0, 90.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("clash")).repartition(7)
    got = hard_negatives.mine(df, F.col("vec_id") % 50 == 0, "vec_id", "label", "embedding", anchors_per_pass=4)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == mined(rows)
    for none in (df.where("false"), df.where("vec_id % 50 <> 0"), df.where("label = 1")):
        assert hard_negatives.mine(none, F.col("vec_id") % 50 == 0, "vec_id", "label", "embedding").count() == 0


def test_hard_negatives_hot_label(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 0 if i % 3 else int(rng.integers(1, 9)), rng.normal(size=16).tolist()) for i in range(3000)]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(5), F.col("vec_id") % 50 == 0, "vec_id", "label", "embedding")
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == mined(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 30), st.sampled_from([1, 2, 7, 100, 30_000_000]), st.integers(0, 10**6), st.integers(0, 4))
def test_planes_find_what_products_find(m, n, size, seed, best):
    rng = np.random.default_rng(seed)
    a, x = rng.integers(-size, size + 1, (m, 3)), rng.integers(-size, size + 1, (n, 3))
    scores = a @ x.T
    low, high = np.full(m, int(np.median(scores))), np.full(m, int(scores.max()) - 1)
    alive = rng.random((m, n)) < 0.8
    bits = hard_negatives.planes(x)
    assert (sum(b.astype(np.int64) * ((1 << p) * (-1 if p == bits[0][0] else 1)) for p, b in bits) == x).all()
    i, j, s = hard_negatives.qualifying(a, bits, low, high, alive, best)
    found = dict(zip(zip(i.tolist(), j.tolist()), s.tolist()))
    for r in range(m):
        want = [(int(scores[r, c]), c) for c in range(n) if alive[r, c] and low[r] <= scores[r, c] <= high[r]]
        if best:  # more may be left, but none of the best may be missing
            floor = sorted((int(scores[r, c]) for c in range(n) if alive[r, c]), reverse=True)[:best]
            want = [w for w in want if w[0] >= floor[-1]]
        assert all(found.get((r, c)) == v for v, c in want)
    assert all(scores[p] == v for p, v in found.items())


# ---- 12 whitening


def check_whitening(rows, got, scale=64, k=16):
    x = np.array([[math.floor(scale * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], np.int64)
    distinct = np.unique(x, axis=0)
    n, total = len(distinct), distinct.sum(axis=0)
    r = x * n - total
    v = np.cov((distinct - total / n).T, bias=True)
    values, vectors = np.linalg.eigh(np.atleast_2d(v))
    values, vectors = values[::-1], vectors[:, ::-1]
    w = (r / n) @ vectors[:, :k] / np.sqrt(values[:k])
    by = {(g["vec_id"], g["component"]): g for g in got}
    assert len(by) == len(got) == len(rows) * min(k, x.shape[1])
    for c in range(min(k, x.shape[1])):
        mine = np.array([by[i, c + 1]["whitened"] for i, _ in rows])
        assert np.abs(mine - np.sign(mine @ w[:, c]) * w[:, c]).max() < 1e-7
        one = by[rows[0][0], c + 1]
        assert abs(one["explained"] / (values[c] / np.trace(np.atleast_2d(v))) - 1) < 1e-9
        assert one["n"] == n and 0 <= one["identity_error"] < 1e-9
    assert [by[i, 1]["deviation"] for i, _ in rows] == [int(s) for s in (r.astype(object) ** 2).sum(axis=1)]


def test_whitening_query(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY 1").fetchall()
    check_whitening(rows, Q.op12_whitening(spark, SF).collect())


def whitened(spark, rows, k=16, schema="vec_id long, embedding array<float>"):
    df = whitening.usable(spark.createDataFrame(rows, schema).repartition(3), "embedding")
    model = whitening.fit(df, "embedding", components=k)
    return model, whitening.whiten(df.withColumn("whitened", F.lit("clash")), "embedding", model)


def test_whitening_copies_and_far_means(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=5) * [1, 3, 9, 27, 81] + 3000).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(150)]  # a third of all rows are copies: the fit takes one
    model, out = whitened(spark, rows, 3)
    got = [{"vec_id": r.vec_id, "component": c + 1, "whitened": w, "deviation": r.deviation, "n": model.n, "explained": model.variances[c] / model.trace, "identity_error": model.identity_error} for r in out.collect() for c, w in enumerate(r.whitened)]
    check_whitening(rows, got, k=3)


def test_whitening_odd_rows(spark):
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [2.0, 1.0]), (4, [5.0, 5.5])]
    odd = [(5, None), (6, [1.0, None]), (7, [math.nan, 1.0]), (8, [math.inf, 1.0]), (9, [1.0]), (10, []), (11, [1e38, 0.0])]
    model, out = whitened(spark, good + odd)
    assert model.n == 3 and len(model.variances) == 2 and sorted(str(r.vec_id) for r in out.collect()) == ["1", "1", "4", "None"]
    model, out = whitened(spark, good[:2])
    assert model.n == 1 and [(len(r.whitened), r.deviation) for r in out.collect()] == [(0, 0)] * 2
    model, out = whitened(spark, odd[:1])
    assert model.n == 0 and out.count() == 0
    model, out = whitened(spark, [(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [0.0, 0.0])])  # a deviation beyond a long is null
    assert sorted(str(r.deviation is None) for r in out.collect()) == ["False", "True", "True"]
    one = Q.op12_whitening  # a table of one distinct vector has no components
    path = scratch_path(spark, "one")
    spark.createDataFrame([(1, 1, [1.0, 2.0])] * 3, VECTORS).write.parquet(f"{path}/embeddings.parquet")
    assert one(spark, path).count() == 0


def test_eigen_equals_library():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 64):
        for _ in range(5):
            a = rng.normal(size=(n, n)) * 10 ** rng.uniform(-3, 3)
            a = a @ a.T if rng.random() < 0.5 else a + a.T
            if n > 2 and rng.random() < 0.3:
                a[:, 0] = a[0] = 0
            values, vectors = whitening.eigen(a)
            assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=1e-12 * np.abs(a).max())
            assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * max(1e-300, np.abs(a).max()) * n
            assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12
    assert (whitening.eigen(np.zeros((4, 4)))[0] == 0).all() and (whitening.eigen(np.eye(4))[0] == 1).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 39), st.integers(0, 10**6))
def test_moments_of_parts_equal_those_of_all(n, cut, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 10, 100, 0] + 5
    parts = [whitening.Moments.zero(4) for _ in range(2)]
    for i, row in enumerate(x):
        parts[i >= cut].add(row)
    parts[0].merge(parts[1])
    assert parts[0].n == n and np.allclose(parts[0].mean, x.mean(axis=0)) and np.allclose(parts[0].m2 / n, np.cov(x.T, bias=True))


# ---- 13 line dedup


def deduplicated(rows, least_chars=20, least_docs=3):
    """Brute force over (doc_id, text): (doc_id, lines, dropped, text) of each row."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    held = defaultdict(set)
    for r, (_, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(r)
    order = lambda d: (d is not None, d)
    top = {k: max((rows[r][0] for r in at), key=order) for k, at in held.items() if len(at) >= least_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if top.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(str, out))


def drop(df, **options):
    return sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.text)) for r in line_dedup.deduplicated(df, **options).collect())


def corpus(n, seed):
    rng = random.Random(seed)
    pool = [f"{w} shared line number {i} é" for i, w in enumerate(["Alpha", "beta", "GAMMA", "delta"] * 5)] + ["short", "", " \t", "nineteen characters", "İ" * 19 + "Z", "x" * 5000]
    odd = [lambda x: x, str.upper, lambda x: f" \t{x}\r", lambda x: x + " "]
    return [(rng.choice([i, i, i, 7, None]), rng.choice([None, "", "\n"]) if rng.random() < 0.1 else "\n".join(rng.choice(odd)(rng.choice(pool)) for _ in range(rng.randrange(1, 9)))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"batches": 5, "fanout": 2, "broadcast_keys": 3, "hub": 5}, {"batches": 1, "broadcast_keys": 0, "hub": 1}, {"least_docs": 2, "least_chars": 1, "batches": 3}])
def test_line_dedup(spark, options):
    rows = corpus(120, len(options))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    least = {k: options[k] for k in ("least_docs", "least_chars") if k in options}
    if "broadcast_keys" in options and not options["broadcast_keys"]:
        options = options | {"broadcast_keys": 30, "hub": 40}
    assert drop(df, **options) == deduplicated(rows, **least)


def test_line_dedup_odd(spark):
    long = "a long line of more than twenty characters"
    rows = [(i, f"{long}\n{long}\n{i}") for i in range(2)] + [(2, "\n".join([long] * 3000)), (3, "lone line of twenty characters"), (None, long), (4, "y" * 2_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(1), "top": F.lit(1), "rid": F.lit(1), "n_lines": F.lit("x")})
    assert drop(df) == deduplicated(rows)
    found = line_dedup.deduplicated(df)
    assert set(found.columns) == {"doc_id", "text", "h", "top", "rid", "n_lines", "n_dropped"}
    assert drop(df.where("false")) == []
    names = df.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")  # ids of text
    assert drop(names) == deduplicated([(None if d is None else f"d{d}", t) for d, t in rows])


def test_line_runs_levels_and_reopening(spark):
    rng = random.Random(5)
    folder = scratch_path(spark, "runs")
    runs = line_dedup.LineRuns(spark, folder, fanout=2)
    held = defaultdict(list)
    for batch in range(7):
        rows = [(bytes([rng.randrange(12)]) * 16, 1000 * rng.randrange(3) + batch) for _ in range(10)]
        rows = sorted(set(rows))
        for h, d in rows:
            held[h].append(d)
        df = spark.createDataFrame(rows, "h binary, top long")
        before = {bytes(r.h): (r.n, r.top) for r in runs.totals().collect()}
        kept = {bytes(r.h) for r in runs.unsettled(df).collect()}
        for h, d in rows:  # settled keys are not added again
            n, top = before.get(h, (0, -1))
            assert (h in kept) == (n < 3 or max(x for k, x in rows if k == h) > top)
        runs.add(df)
        if batch == 3:
            runs.close()  # the files stay
            runs = line_dedup.LineRuns(spark, folder, fanout=2)
    assert [(r.first, r.last) for r in runs.runs] == [(0, 3), (4, 5), (6, 6)]
    for r in runs.totals().collect():
        assert r.top == max(held[bytes(r.h)]) and min(r.n, 3) == min(len(held[bytes(r.h)]), 3)
    assert {bytes(r.h) for r in runs.totals().collect()} == set(held)
    files = [f for f in os.listdir(runs.runs[0].path.removeprefix("file:")) if f.startswith("part-")] if runs.runs[0].path.startswith("file:") else [1]
    assert len(files) <= runs.buckets
    plan = runs.unsettled(spark.createDataFrame([(b"x" * 16, 1)], "h binary, top long"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the batch alone is shuffled
    runs.close(files=True)


def test_line_dedup_digests(spark):
    rows = {r.doc_id: r for r in Q.op13_line_dedup(spark, SF).collect()}
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert sorted(map(str, [(d, r.n_lines, r.n_dropped, r.kept_sha256) for d, r in rows.items()])) == sorted(
        str((d, n, k, hashlib.sha256(t.encode()).hexdigest())) for d, n, k, t in map(eval, deduplicated(texts))
    )
