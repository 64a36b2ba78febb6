"""The graph index of vectors."""

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import graph_index as G
from sparkloom.operators import indexing, search

FILES = "path string, content string, language string"


def test_recall_and_rows_scored(spark):
    """The registered query, in its own settings: recall of at least 0.95 with less than a fifth of the rows scored."""
    from sparkloom.plans import search_queries

    sf = "/root/testdata/sf0.1"
    index, table, asked = search_queries.graph_index(spark, sf)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = {(r.query_id, r.vec_id) for r in search.vector_topk(rows, asked, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in index.search(table, asked, 10).collect()}
    assert len(found & exact) >= 0.95 * len(exact)
    assert index.scored(table, asked, 10).agg(F.avg("scored")).first()[0] < 0.2 * rows.count()


def test_links():
    rng = np.random.default_rng(0)
    x = G._units(rng.normal(size=(400, 8)))
    links = G.linked(x, 6, 40)
    assert links.shape == (400, 13) and all(len(set(own := [v for v in r if v >= 0])) == len(own) and i not in own for i, r in enumerate(links.tolist()))
    node, score, scored = G.walk(x, links, x[:50], 400)
    assert (scored == 400).all() and all(sorted(r) == list(range(400)) for r in node.tolist())  # every node is reached
    for n in (1, 2, 3):
        node, score, scored = G.walk(x[:n], G.linked(x[:n], 6, 40), x[:1], 8)
        assert sorted(node[0].tolist()) == list(range(n)) and scored[0] == n


def test_equals_exact_search_with_copies_removals_and_shards(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 6)).astype(np.float32)
    rows = [(i, vectors[i % 200 if i % 3 else 0].tolist()) for i in range(600)]  # a third of all rows are one vector
    odd = [(700, None), (701, []), (702, [1.0]), (703, [float("nan")] * 6), (704, [0.0] * 6), (None, [1.0] * 6), (705, [None] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 20 = 0 AND vec_id < 600").select(F.col("vec_id").alias("query_id"), "embedding")
    index = G.GraphIndex(shard_rows=150)
    table = index.build(df.where("vec_id < 400 OR vec_id >= 700"), 1).unionByName(index.build(df.where("vec_id >= 400 AND vec_id < 600"), 2)).cache()
    assert table.count() > 3
    good = df.where("vec_id < 600")
    got = lambda gone=None: sorted((r.query_id, r.vec_id, r["rank"], round(r.vector_score, 6)) for r in index.search(table, asked, 12, gone, width=600).collect())
    want = lambda kept: sorted((r.query_id, r.vec_id, r["rank"], round(r.vector_score, 6)) for r in search.vector_topk(kept, asked, 12).collect())
    assert {x[:2] + x[3:] for x in got()} == {x[:2] + x[3:] for x in want(good)}
    gone = spark.createDataFrame([(i, 2) for i in range(0, 600, 5)], "vec_id long, version int")  # holds for the first shards alone
    left = good.where("vec_id >= 400 OR vec_id % 5 <> 0")
    assert {x[:2] + x[3:] for x in got(gone)} == {x[:2] + x[3:] for x in want(left)}
    assert sorted(r.vec_id for r in index.rows(table, gone).collect()) == sorted(r.vec_id for r in left.collect())
    assert not index.scattered(table, 10) and index.scattered(table, 400)
    empty = index.build(df.where("false"))
    assert empty.count() == 0 and index.search(empty, asked, 3).count() == 0


def test_store_keeps_and_probes_a_graph(spark, tmp_path):
    text = lambda i: "\n".join(f"file {i} line {k} speaks of topic{i % 7} and item{(i * k) % 50}" for k in range(12))
    config = indexing.IndexConfig(syntax=False, graph_from=20)
    files = {f"{i}.txt": text(i) for i in range(30)}
    store = indexing.Store(spark, str(tmp_path))
    run = lambda: indexing.index_files(store, spark.createDataFrame([(p, c, None) for p, c in files.items()], FILES), config)
    files = {f"{i}.txt": text(i) for i in range(8)}
    run()
    assert indexing.nearest(store, [1.0] * 64, 5) is None  # too few chunks
    files = {f"{i}.txt": text(i) for i in range(30)}
    run()
    for change in (lambda: None, lambda: [files.pop("3.txt"), files.update({"4.txt": text(99)})], lambda: files.update({"4.txt": text(4)})):
        change()
        run()
        chunks = store.table("chunks")
        for r in chunks.where("file_path IN ('4.txt', '11.txt')").collect():
            exact = chunks.select("id", "embedding")
            top = {x.id for x in search.best(search.with_cosine(exact, F.col("embedding"), r.embedding), "vector_score", 6, "id").collect()}
            found = {x.id for x in indexing.nearest(store, r.embedding, 6).collect()}
            assert r.id in found and len(found & top) >= 5 and found <= {x.id for x in chunks.collect()}
