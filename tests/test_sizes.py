"""What bounds memory and shuffles at size: rows are counted where they are, and work is dealt in bounded parts."""

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkloom.functions.text import tokens
from sparkloom.operators import chunking, keyword, search
from sparkloom.plans import catalogue
from sparkloom.plans import tables as T

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_counted_inside_rows(spark):
    rows = spark.createDataFrame([(1, "b a B c"), (2, ""), (3, None), (4, " a ")], "id long, text string")
    index = keyword.postings(rows, "id", "text")
    assert "Exchange" not in plan(index)
    assert sorted(map(tuple, index.collect())) == [("a", 1, 1, 7.0), ("a", 4, 1, 3.0), ("b", 1, 2, 7.0), ("c", 1, 1, 7.0)]


def test_postings_come_in_order_of_term(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"w{i % 7} v{i % 5} u{i} w{i % 7}") for i in range(200)], "id long, text string").coalesce(1)
    whole = list(map(tuple, keyword.postings(rows, "id", "text").collect()))
    assert len(whole) == 600 and [(r[0], r[1]) for r in whole] == sorted((r[0], r[1]) for r in whole)
    monkeypatch.setattr(keyword, "HELD", 300)  # many frames count the same
    assert sorted(map(tuple, keyword.postings(rows, "id", "text").collect())) == whole


def test_postings_know_the_tokens_of_all_white_space(spark):
    every = [chr(i) for i in (*range(1, 0x3100), 0xFEFF, 0x1D7CE, 0x1F600)]
    rows = spark.createDataFrame([(i, f"X{c}y {c} \u0130\u03a3{c}") for i, c in enumerate(every)], "id long, text string")
    want = {(r.id, t, r.t.count(t)) for r in rows.select("id", tokens(F.col("text")).alias("t")).collect() for t in r.t}
    assert {(r.id, r.term, r.tf) for r in keyword.postings(rows, "id", "text").collect()} == want
    some = keyword.postings(rows, "id", "text", ["y", "x\x1cy"]).collect()
    assert {(r.id, r.term, r.tf) for r in some} == {x for x in want if x[1] in ("y", "x\x1cy")}


def test_postings_of_shared_and_null_keys_are_summed(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "b c"), (None, "a a"), (None, "a b"), (2, "a b")], "id long, text string")
    found = sorted(map(tuple, keyword.postings(rows, "id", "text").collect()), key=str)
    assert found == sorted([("a", 1, 1, 3.0), ("b", 1, 2, 3.0), ("c", 1, 1, 3.0), ("a", None, 3, 3.0), ("b", None, 1, 3.0), ("a", 2, 1, 3.0), ("b", 2, 1, 3.0)], key=str)


def test_term_queries_do_not_join_vectors(spark):
    for name in ("postings_terms", "bm25_idf", "bm25_top_terms", "bm25_batch"):
        assert "embedd" not in catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_small_files_are_dealt_to_all_cores(spark):
    rows = spark.range(21_000).coalesce(1)
    sizes = [r["count"] for r in T.spread(rows).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 21_000 and len(sizes) >= 4 and max(sizes) <= 5_500
    assert T.spread(rows.where("id < 10")).rdd.getNumPartitions() == 1 and T.spread(rows.where("id < 0")).count() == 0
    for name in ("chunk_lines", "chunk_code", "code_definitions", "import_targets", "parse_symbols"):
        assert "REPARTITION_BY_NUM" in plan(catalogue.queries()[name](spark, SF))


def test_index_of_imports_is_never_broadcast(spark):
    found = plan(catalogue.queries()["import_targets"](spark, SF))
    assert "SortMergeJoin" in found and "BroadcastHashJoin" not in found


def test_best_rows_of_many_queries_in_bounded_memory():
    rng = np.random.default_rng(5)
    for queries, n in ((3000, 600), (7, 5000)):
        score, ids = rng.integers(0, 50, (n, queries)).astype(float), rng.permutation(n)
        held = search._Best(queries, 5)
        tracemalloc.start()
        for at in range(0, n, held.rows):
            held.add(ids[at : at + held.rows], score[at : at + held.rows])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40 * search.TILE * 2
        for q in range(0, queries, 97):
            top = np.lexsort((ids, -score[:, q]))[:5]
            assert held.ids[q].tolist() == ids[top].tolist() and held.score[q].tolist() == score[top, q].tolist()


def test_chunks_are_passed_on_in_bounded_frames(spark):
    held = {}

    class Files:  # stands for a table: keeps the function that runs in tasks
        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            held["run"] = run

    chunking.chunk_files(Files())
    batch = pd.DataFrame({"path": [str(i) for i in range(400)], "content": ["line of text\n" * 2000] * 400, "language": [None] * 400})
    sizes = [f["content"].str.len().sum() for f in held["run"](iter([batch]))]
    assert len(sizes) > 3 and max(sizes) < 2 * chunking.HELD and sum(sizes) > 400 * 20_000
