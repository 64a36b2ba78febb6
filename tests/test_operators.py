"""Behaviour that SQL twins do not show: edge cases, properties, golden chunks and symbols."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import scores as S
from sparkloom.functions import text as X
from sparkloom.functions import vectors as V
from sparkloom.operators import chunking, graph, indexing, keyword, search, symbols
from sparkloom.sources import files, history

RUST = "use a::b;\n\n\npub fn long_name(x: u8, y: u8) -> u8 {\n    x + y // something that makes it long enough to keep as a chunk\n}\n\nstruct Point {\n    x: f64,\n}\n"
PYTHON = "import os\n\n\ndef top(a, b):\n    '''Adds two numbers and returns the sum of both of them.'''\n    return a + b\n\n\nclass Box(Base):\n    def first(self):\n        return 1\n\n    def second(self):\n        return 2\n"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_cosine_guards(spark):
    assert one(spark, V.cosine(arr(1, 0), arr(1, 0))) == pytest.approx(1)
    assert one(spark, V.cosine(arr(0, 0), arr(1, 0))) == 0
    assert one(spark, V.cosine(arr(1, 0, 0), arr(1, 0))) == 0
    assert one(spark, V.cosine(F.array().cast("array<double>"), F.array().cast("array<double>"))) == 0
    assert one(spark, V.cosine(F.lit(None).cast("array<double>"), arr(1))) == 0


def test_normalise_3_4_5(spark):
    assert one(spark, V.normalised(arr(3, 4))) == pytest.approx([0.6, 0.8])
    assert one(spark, V.normalised(arr(0, 0))) == [0, 0]


def test_scores(spark):
    assert one(spark, S.bm25_normalised(F.lit(0.0))) == 0.5
    assert one(spark, S.percent(F.lit(-0.2))) == 0
    assert one(spark, S.percent(F.lit(0.999))) == 99
    assert one(spark, S.band(F.lit(0.4))) == "medium"


def test_tokens_split_on_unicode_space(spark):
    assert one(spark, X.tokens(F.lit("A b  C\n"))) == ["a", "b", "c"]


def test_lines(spark):
    assert one(spark, X.lines(F.lit("a\r\nb\n"))) == ["a", "b"]
    assert one(spark, X.lines(F.lit(""))) == []
    assert one(spark, X.lines(F.lit("a\n\n"))) == ["a", ""]


@pytest.mark.parametrize(("path", "want"), [("main.rs", "rust"), ("app.py", "python"), ("index.ts", "typescript"), ("README.md", None)])
def test_chunk_language(spark, path, want):
    assert one(spark, X.language(F.lit(path), X.CHUNK_LANGUAGES)) == want


def test_shortened_path(spark):
    assert len(one(spark, X.shortened_path(F.lit("/a" * 60), 30))) <= 30


def test_repeated_query_terms_count_each_time(spark):
    chunks = spark.createDataFrame([(1, "x y"), (2, "y z")], "id long, content string")
    total = keyword.corpus(chunks, "content")
    ask = lambda q: keyword.scores(keyword.postings(chunks, "id", "content"), total, spark.createDataFrame([(0, q)], "query_id long, query string"), "id")
    once, twice = ({r.id: r.bm25 for r in ask(q).collect()} for q in ("x", "x x"))
    assert set(once) == {1}
    assert twice[1] == pytest.approx(2 * once[1])


def test_empty_corpus_length(spark):
    assert keyword.corpus(spark.createDataFrame([], "content string"), "content").first().average == 500


def test_bm25_length_is_bytes(spark):
    assert keyword.corpus(spark.createDataFrame([("é",)], "content string"), "content").first().average == 2


def test_extension_filter_drops_paths_without(spark):
    rows = spark.createDataFrame([("a.RS",), ("Makefile",), ("b.py",)], "path string")
    assert [r.path for r in search.of_types(rows, "path", ["rs"]).collect()] == ["a.RS"]


def test_ann_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = search.IvfIndex(cells=24)
    found = {(r.query_id, r.vec_id) for r in index.search(index.build(rows), asked, 10, probes=6).collect()}
    exact = {(r.query_id, r.vec_id) for r in search.vector_topk(rows, asked, 10).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_small_set_is_searched_exactly(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    index = search.IvfIndex()
    assert [r.vec_id for r in index.search(index.build(rows), asked, 2).orderBy("rank").collect()] == [1, 2]


def test_rerank_with_scorer(spark):
    rows = spark.createDataFrame([(1, "aa", 0.1, 1), (2, "a", 0.2, 2)], "id long, content string, score double, rank long")
    best = search.rerank(rows, lambda q, t: [float(len(x)) for x in t], "q", 1, "id")
    assert [(r.id, r.score) for r in best.collect()] == [(1, 2.0)]


def test_contained_spans_property(spark):
    random.seed(3)
    spans = [(g, a, a + random.randint(0, 8)) for g in range(20) for a in random.choices(range(20), k=12)]
    df = spark.createDataFrame(spans, "g long, a long, b long")
    got = sorted(tuple(r) for r in chunking.drop_contained(df, "g", "a", "b").collect())
    want = []
    for g in range(20):
        own = set(s[1:] for s in spans if s[0] == g)
        want += [(g, a, b) for a, b in own if not any((c, d) != (a, b) and c <= a and d >= b for c, d in own)]
    assert got == sorted(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 10)), max_size=15))
def test_contained_spans_greedy(pairs):
    spans = [(a, a + n) for a, n in pairs]
    want = sorted({s for s in spans if not any(o != s and o[0] <= s[0] and o[1] >= s[1] for o in spans)})
    assert chunking.without_contained(spans) == want


def test_line_chunks():
    c = chunking.LineChunker(least=20)
    kinds = [(k, a, b) for _, a, b, k in c.chunk(RUST, "rust")]
    assert kinds == [("function", 4, 6), ("class", 8, 10)]
    assert c.chunk("", "rust") == []
    assert [x[3] for x in c.chunk("y" * 2000, "rust")] == ["code", "code"]  # one long line, and the tail that overlaps it


def test_oversize_block_is_cut():
    body = "fn f() {\n" + "    let x = 1; // some words\n" * 100 + "}\n"
    parts = chunking.LineChunker().chunk(body, "rust")
    assert len(parts) > 1 and all(len(p[0]) <= 1500 for p in parts)
    assert parts[1][1] == parts[0][2] - 1  # two lines of overlap


def test_syntax_chunks():
    c = chunking.SyntaxChunker(least=5)
    assert [(x[3], x[4], x[5]) for x in c.chunk(PYTHON, "python")] == [("import", None, None), ("function", "top", None), ("class", "Box", None)]
    assert any(x[3] == "function" for x in c.chunk(RUST, "rust"))
    assert c.chunk("def broken(:\n", "python")[0][3] == "code"


def test_symbols():
    rust, imports = symbols.parse("a.rs", RUST, "rust")
    assert [(s[1], s[3], s[4], s[5]) for s in rust] == [("long_name", 2, "function", "long_name(x: u8, y: u8) -> u8"), ("Point", 7, "struct", "struct Point")]
    assert imports == ["a::b"]
    python, imports = symbols.parse("a.py", PYTHON, "python")
    assert [(s[1], s[5]) for s in python] == [("top", "def top(a, b) -> None"), ("Box", "class Box(Base)")]  # no methods
    go, _ = symbols.parse("a.go", "func (r T) Run(a int) error {\n}\ntype S struct {\n}\n", "go")
    assert [s[5] for s in go] == ["func Run(a int) error", "type S struct"]
    ts, imports = symbols.parse("a.ts", "import {x} from 'y'\nexport class K extends L {\n}\nconst f = (a) => a\ntype Q = 1\n", "typescript")
    assert [s[5] for s in ts] == ["f = () => ...", "class K extends L", "type Q"] and imports == ["y"]


def test_graph_one_file(spark):
    edges = graph.file_edges(spark.createDataFrame([("r:a", "r")], "id string, repo_id string"))
    out = graph.edges_from(edges, "file", "r:a").collect()
    assert [e.kind for e in out] == ["BelongsTo"]


def test_graph_import_pair(spark):
    edges = graph.import_edges(spark.createDataFrame([("a", "b"), ("a", "x")], "src string, dst string"))
    known = spark.createDataFrame([("a", "a.py"), ("b", "b.py")], "id string, path string")
    assert [(r.src, r.id) for r in graph.imports_of(edges, known).collect()] == [("a", "b")]
    assert {(r.src, r.name) for r in graph.file_imports(edges, known).collect()} == {("a", "b.py"), ("a", "x (external)")}
    assert [e.src.id for e in edges.where("kind = 'ImportedBy'").where("dst.id = 'a'").orderBy("src.id").collect()] == ["b", "x"]


def test_reachable_takes_the_shorter_path(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (1, 4), (4, 5), (5, 5), (3, 1)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    assert sorted(r.id for r in graph.reachable(edges, spark.range(1, 2), 2).collect()) == [2, 3, 4, 5]


def test_git_sources(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    run("add", "."), run("commit", "-qm", "one | two")
    (tmp_path / "a.py").rename(tmp_path / "b.py")
    run("add", "-A"), run("commit", "-qm", "move")
    commits = history.log(spark, str(tmp_path), 10).orderBy("message").collect()
    assert [c.message for c in commits] == ["move", "one "]  # a bar in a subject shifts the fields
    moved = history.parse_name_status(history.git_lines(spark, str(tmp_path), "diff", "--name-status", "-M", "HEAD~1", "HEAD")).collect()
    assert [tuple(r) for r in moved] == [("R", "b.py", "a.py")]
    blame = history.parse_blame(history.git_lines(spark, str(tmp_path), "blame", "--porcelain", "b.py")).collect()
    assert [(b.line_number, b.author, b.content) for b in blame] == [(1, "n", "x = 1")]
    assert history.repo_info(str(tmp_path))["tracked"] == 1 and history.is_tracked(str(tmp_path), "b.py")


def test_history_over_blocks(spark):
    """Small blocks, so that commits and headers reach over several of them; no window holds all lines."""
    sha = lambda i: f"{i:040x}"
    log, blame = ["noise"], []
    for i in range(9):
        log += [f"{sha(i)}|a{i}|{i}|m|", ""] + [f"f{i}.{k}" for k in range(i)]
        blame += [f"{sha(i % 4)} 1 {i + 1}"] + ([f"author a{i}", f"author-time {i}"] if i < 4 else []) + ["filename f", f"\tline {i}"]
    table = lambda x: spark.createDataFrame(list(enumerate(x, 1)), "line_no long, line string").repartition(5)
    for block in (1, 3, 1 << 16):
        got = {r.hash: (r.author, r.timestamp, r.files_modified) for r in history.parse_log(table(log), block).collect()}
        assert got == {sha(i): (f"a{i}", i, [f"f{i}.{k}" for k in range(i)]) for i in range(9)}
        got = sorted(tuple(r) for r in history.parse_blame(table(blame), block).collect())
        assert got == [(i + 1, sha(i % 4), f"a{i % 4}", i % 4, f"line {i}") for i in range(9)]
    rows = spark.range(100).selectExpr("(id * 37) % 100 AS k", "id").repartition(4)
    assert all(r.line_no == r.k + 1 for r in history.numbered(rows, F.floor(F.col("k") / 7), "k").collect())


def test_blame_makes_its_lines_once(spark):
    """Blocks' last headers and filling read the same dealt lines; the last header of a block reaches over blocks without."""
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    blame = [x for i in range(40) for x in (f"{i % 7:040x} 1 {i}", f"author a{i % 7}", *["filename f"] * 30, f"\tline {i}")]
    lines = spark.createDataFrame(list(enumerate(blame, 1)), "line_no long, line string").mapInPandas(counted, "line_no long, line string")
    got = sorted(tuple(r) for r in history.parse_blame(lines, 10).select("line_number", "commit_hash", "author", "content").collect())
    assert got == [(i, f"{i % 7:040x}", f"a{i % 7}", f"line {i}") for i in range(40)]
    assert made.value == len(blame)


def test_history_queries_take_all_orders(spark):
    from sparkloom.plans import catalogue

    sf, q = "/root/testdata/sf0.01", catalogue.queries()
    assert q["parse_log_group"](spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count() > 400
    assert q["blame_forward_fill"](spark, sf).count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_commit_edges_of_all_orders(spark):
    from sparkloom.plans import catalogue

    sf = "/root/testdata/sf0.001"
    edges = catalogue.queries()["graph_commit_edges"](spark, sf).agg(F.sum("edges")).first()[0]
    assert edges == spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_all_pages_import(spark):
    from sparkloom.plans import catalogue

    sf = "/root/testdata/sf0.001"
    pages = {str(r[0]) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id").collect()}
    assert {r.src for r in catalogue.queries()["file_imports_external"](spark, sf).select("src").collect()} == pages


def test_whole_batch_and_index(spark):
    from sparkloom.plans import catalogue

    sf, q = "/root/testdata/sf0.001", catalogue.queries()
    asked = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert q["vector_topk_batch"](spark, sf).select("query_id").distinct().count() == asked > 20
    assert q["postings_terms"](spark, sf).select("term").distinct().count() == q["bm25_idf"](spark, sf).count() > 3


def test_scan_filter_keeps_long_texts(spark):
    from sparkloom.plans import catalogue

    rows = catalogue.queries()["scan_filter"](spark, "/root/testdata/sf0.01")
    assert rows.where("bytes > 4000").count() > 0
    few = spark.createDataFrame([("a.py", bytearray(b"x" * n)) for n in (1, 10, 11)], "path string, content binary")
    assert sorted(len(r.content) for r in files.as_files(few, most=10).collect()) == [1, 10]


def test_scan_tree(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("*.log.py\nbuild/\n!keep.log.py\n")
    for name, data in {"a.py": b"x", "b.log.py": b"x", "keep.log.py": b"x", "build/c.py": b"x", "n.py": b"a\0b", "u.py": b"\xff", "big.py": b"x" * 1_000_001, "d.exe": b"x", ".h/e.rs": b"x", "Makefile": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = sorted((r.path.removeprefix(f"{tmp_path}/"), r.language) for r in files.scan_tree(spark, str(tmp_path)).collect())
    assert got == [(".h/e.rs", "rust"), ("Makefile", None), ("a.py", "python"), ("keep.log.py", "python")]
    assert files.scan_single(spark, str(tmp_path / "a.py")).count() == 1
    assert files.scan_tree(spark, str(tmp_path), ["exe"]).count() == 2  # the extension and the name without one


def test_incremental_equals_rebuild(spark, tmp_path):
    schema = "path string, content string, language string"
    first = spark.createDataFrame([("a.py", PYTHON, "python"), ("b.rs", RUST, "rust"), ("c.py", "x = 1\n", "python")], schema)
    second = spark.createDataFrame([("a.py", PYTHON + "def more(x):\n    return x * 2 + len(str(x)) + 100\n", "python"), ("b.rs", RUST, "rust"), ("d.py", "", "python")], schema)
    one, two = (indexing.Store(spark, str(tmp_path), n) for n in ("one", "two"))
    assert indexing.index_files(one, first)["indexed"] == 3
    assert {k: v for k, v in indexing.index_files(one, second).items() if k in ("total_files", "indexed", "skipped")} == {"total_files": 3, "indexed": 2, "skipped": 1}
    indexing.index_files(two, second)
    for table in ("chunks", "idf", "postings"):
        a, b = (sorted(map(str, s.table(table).drop("indexed_at").collect())) for s in (one, two))
        assert a == b
    assert "c.py" not in {r.path for r in one.table("files").collect()}
    assert {r.name for r in indexing.stores(spark, str(tmp_path)).collect()} == {"one", "two"}
    one.clear()
    assert one.tables() == []


def test_tiers(spark):
    chunks = spark.createDataFrame([("some words",), (None,)], "content string")
    assert all(r.embedding == [] for r in indexing.embedded(chunks, indexing.IndexConfig("fast")).collect())
    full = indexing.embedded(chunks, indexing.IndexConfig()).collect()
    assert len(full[0].embedding) == 64

    class Broken:
        def embed(self, texts):
            raise OSError

    assert all(r.embedding == [] for r in indexing.embedded(chunks, indexing.IndexConfig(provider=Broken)).collect())
    assert indexing.IndexConfig().batch == 50 and indexing.IndexConfig().incremental


def test_settings():
    s = indexing.Settings()
    s.set("api_key", "abcdefghijkl")
    assert s.shown()["api_key"] == "abcd..." and indexing.Settings.loads(s.dumps()) == s
    with pytest.raises(ValueError):
        s.set("provider", "c2")


def test_ignore_rules(tmp_path):
    (tmp_path / "src" / "deep" / "doc").mkdir(parents=True)
    (tmp_path / "doc" / "x").mkdir(parents=True)
    (tmp_path / ".gitignore").write_text("/*.py\ndoc/*.txt\n**/skip.md\nsrc/**/gone.rs\n\\!odd.go\n[ab].c\nkeep?.h\n#no\n")
    ignored = files.Ignore(str(tmp_path))
    gone = ["a.py", "doc/a.txt", "x/skip.md", "skip.md", "src/gone.rs", "src/deep/gone.rs", "!odd.go", "x/a.c", "keep1.h"]
    stays = ["src/a.py", "doc/x/a.txt", "src/deep/doc/a.txt", "x/noskip.md", "odd.go", "x/c.c", "keep.h", "keep12.h"]
    assert [p for p in gone if not ignored(p, False)] == [] and [p for p in stays if ignored(p, False)] == []


def test_ann_query_recall(spark):
    """The registered query, in its own settings, against the exact search."""
    from sparkloom.plans import search_queries

    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        found = {(r.query_id, r.vec_id) for r in search_queries.ann_found(spark, sf).collect()}
        rows = spark.read.parquet(f"{sf}/embeddings.parquet")
        asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
        exact = {(r.query_id, r.vec_id) for r in search.vector_topk(rows, asked, 10).collect()}
        assert len(found & exact) >= 0.9 * len(exact)


def test_ann_lifecycle(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=8)]) for i in range(300)] + [(900, None)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), "embedding")
    index = search.IvfIndex(cells=4, threshold=0, copies=2, block_rows=50)
    table = index.build(rows)
    exact = {tuple(r) for r in search.vector_topk(rows.where("embedding IS NOT NULL"), asked, 3).select("query_id", "vec_id", "rank").collect()}
    got = lambda t, i=index: {tuple(r) for r in i.search(t, asked, 3, probes=4).select("query_id", "vec_id", "rank").collect()}
    assert got(table) == exact
    index.save(table, str(tmp_path / "ann"))
    again, stored = search.IvfIndex.load(spark, str(tmp_path / "ann"))
    assert got(stored, again) == exact and again.size(stored) == 301
    less = again.removed(stored, spark.range(10).select(F.col("id").alias("vec_id")))
    assert again.size(less) == 291 and all(v >= 10 for _, v, _ in got(less, again))
    more = less.unionByName(again.add(rows.where("vec_id < 10")))
    assert got(more, again) == exact
    search.IvfIndex.clear(spark, str(tmp_path / "ann"))
    assert not (tmp_path / "ann").exists()


def test_queries_in_blocks(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, [float(v) for v in rng.integers(-2, 3, size=3)]) for i in range(200)] + [(500, None), (501, [1.0])], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id < 30 OR vec_id > 400").select(F.col("vec_id").alias("query_id"), "embedding")
    whole, parts = ({tuple(r) for r in search.vector_topk(rows, asked, 4, block=b).collect()} for b in (4096, 7))
    assert whole == parts and len(whole) == 32 * 4
    docs = rows.select((F.col("vec_id") % 9).alias("doc_id"), F.col("embedding").alias("token"))
    tokens = asked.select((F.col("query_id") % 2).alias("query_id"), F.col("embedding").alias("token"))
    rounded = lambda df: {(r.query_id, r.doc_id, round(r.late_score, 9)) for r in df.collect()}
    assert rounded(search.late_interaction(tokens, docs)) == rounded(search.late_interaction(tokens, docs, block=5))


def test_blend_with_late_scores_and_candidates(spark):
    chunks = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", [0.0, 1.0]), (3, "x x", [0.6, 0.8])], "chunk_id long, content string, embedding array<double>")
    late = spark.createDataFrame([(2, 1.0)], "chunk_id long, late_score double")
    near = spark.createDataFrame([(1,), (2,)], "chunk_id long")
    rows = search.hybrid(chunks, "q", [1.0, 0.0], 5, late=late, near=near, weights=(0.2, 0.5, 0.3)).collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in rows] == [(2, 0.65), (1, 0.35)]


def test_ranked(spark):
    from sparkloom.operators.ranking import ranked

    rows = spark.range(1000).selectExpr("(id * 37) % 1000 AS k")
    assert all(r["rank"] == 1000 - r.k for r in ranked(rows, F.desc("k")).collect())


def test_providers():
    from sparkloom.operators import providers as P

    seen = []

    def post(url, body, headers):
        seen.append((url, headers))
        if url.endswith("/rerank"):
            return {"results": [{"index": 1, "score": 0.9}, {"index": 0, "score": 0.1}]}
        if url.endswith("/health"):
            return {"status": "ok"}
        if url.endswith("embeddings") and "model" not in body:
            return {"embeddings": [[float(len(t))] for t in body["input"]]}
        return {"data": [{"index": i, "embedding": [float(i)]} for i in reversed(range(len(body["input"])))]}

    assert P.EndpointProvider("u", "m", "k", post).embed(["a", "b"]) == [[0.0], [1.0]] and seen[-1][1] == {"Authorization": "Bearer k"}
    server = P.LocalServer("http://x/", post)
    assert server.embed(["ab"]) == [[2.0]] and server.scores("q", ["a", "b"]) == [0.1, 0.9] and server.up()
    counted = []

    class Inner:
        def embed(self, texts):
            counted.extend(texts)
            return [[float(len(t))] for t in texts]

    cached = P.CachedProvider(Inner(), 2)
    assert cached.embed(["a", "bb", "a"]) == [[1.0], [2.0], [1.0]] and counted == ["a", "bb"]
    cached.embed(["ccc"]), cached.embed(["bb"])
    assert counted == ["a", "bb", "ccc", "bb"]  # the least recently used went
    pooled = P.local_provider("balanced", P.HashingProvider)
    assert len(pooled.embed(["a b"])[0]) == 768 and pooled.embed([""]) == [[]]
    assert P.query_vector(pooled, "a") == pooled.embed([P.QUERY_PREFIX + "a"])[0]
    assert P.PooledProvider(P.HashingProvider(8), 1).embed(["a b"]) == P.PooledProvider(P.HashingProvider(8)).embed(["a"])
    with pytest.raises(ValueError):
        P.provider("other")


def test_store_lifecycle(spark, tmp_path):
    schema = "path string, content string, language string"
    code = spark.createDataFrame([("a.py", PYTHON, "python"), ("b.rs", RUST, "rust"), ("c.md", "no code here", None)], schema)
    store = indexing.Store(spark, str(tmp_path))
    assert indexing.ensure_indexed(store, lambda: code) and not indexing.ensure_indexed(store, lambda: code)
    assert all(r.embedding == [] for r in store.table("chunks").collect())
    metrics = indexing.upgrade(store, lambda: code)
    assert metrics["indexed"] == 3 and metrics["duration_ms"] > 0 and all(len(r.embedding) == 64 for r in store.table("chunks").collect())
    store.save_code_map(code)
    assert {r.path for r in store.table("summaries").collect()} == {"a.py", "b.rs"}
    store.save_graph(graph.file_edges(spark.createDataFrame([("f", "r")], "id string, repo_id string")))
    assert store.counts()["edges"] == 2 and store.file("a.py").count() == 1
    store.export_json(str(tmp_path / "json"))
    other = indexing.Store(spark, str(tmp_path), "copy")
    other.import_json(str(tmp_path / "json"), {"symbols": symbols.SYMBOL_SCHEMA})
    assert sorted(map(str, other.table("symbols").collect())) == sorted(map(str, store.table("symbols").collect()))
    (tmp_path / "json").rename(tmp_path.parent / "json-away")
    assert indexing.clear_all(spark, str(tmp_path)) == 2 and store.tables() == [] and other.tables() == []


def test_tiers_differ(spark):
    chunks = spark.createDataFrame([("some words",)], "content string")
    assert [len(indexing.embedded(chunks, indexing.IndexConfig(t)).first().embedding) for t in ("fast", "balanced", "quality")] == [0, 64, 768]


def test_log_of_one_file_and_changes_since(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    for i, name in enumerate(("a.py", "b.py")):
        (tmp_path / name).write_text(f"x = {i}\n" * 9)
        run("add", "."), run("commit", "-qm", f"c{i}")
    (tmp_path / "a.py").rename(tmp_path / "c.py")
    run("add", "-A"), run("commit", "-qm", "c2")
    assert sorted(r.message for r in history.log(spark, str(tmp_path), 10, "c.py").collect()) == ["c0", "c2"]
    assert {r.path for r in history.changed_since(spark, str(tmp_path), "HEAD~1").collect()} >= {"c.py"}
    first = history.in_repo(history.log(spark, str(tmp_path), 10), "r").where("message = 'c1'").first()
    assert first.files_modified == [f"{first.repo_id}:b.py"] and len(first.repo_id) == 16


def test_syntax_chunks_of_brace_languages():
    c = chunking.SyntaxChunker(least=5)
    kinds = lambda text, language: [(x[3], x[4], x[1], x[2]) for x in c.chunk(text, language)]
    assert kinds("#include <a.h>\nint add(int a, int b) {\n  return a + b;\n}\nstruct P {\n  int x;\n};\n", "c") == [("import", None, 1, 1), ("function", "add", 2, 4), ("class", "P", 5, 7)]
    assert kinds("namespace n {\nint f(int a) {\n  return a;\n}\n}\n", "cpp") == [("class", "n", 1, 5)]
    assert kinds("export function A(p) {\n  return 1;\n}\n", "tsx") == [("function", "A", 1, 3)]


def test_braces_in_strings_and_comments_do_not_count():
    c = chunking.SyntaxChunker(least=5)
    kinds = lambda text, language: [(x[3], x[4], x[1], x[2]) for x in c.chunk(text, language)]
    two = [("function", "one", 1, 4), ("function", "two", 6, 8)]
    bodies = {
        "go": ['a := "{"', "a := `{ \" {`", "a := '{'", "// {", "/* { \" */"],
        "rust": ['let a = "{ \\" {";', 'let a = r#"{ " {"#;', "let a = '{';", "let a: &'a str = b; // {", "let a = b'{';"],
        "typescript": ['const a = "{";', "const a = `{ ${b} {`;", "const a = '{ \\' {';", "// {", "/* { */"],
        "c": ['char *a = "{";', "char a = '{';", "// {", "/* { */"],
        "cpp": ['auto a = R"x({ ")x";', "auto a = '{';"],
    }
    heads = {"go": "func {}() {{", "rust": "fn {}() {{", "typescript": "function {}() {{", "c": "int {}(void) {{", "cpp": "int {}() {{"}
    for language, inside in bodies.items():
        for line in inside:
            text = f"{heads[language].format('one')}\n  {line}\n  b();\n}}\n\n{heads[language].format('two')}\n  c();\n}}\n"
            assert kinds(text, language) == two, (language, line)
    assert chunking.only_code('a /* x\ny */ "b" c', "go").split("\n") == ["a     ", "         c"] and chunking.only_code("'{'", None) == "'{'"
    assert kinds("/*\nfunc no() {\n*/\nfunc one() {\n  a()\n}\n", "go") == [("function", "one", 4, 6)]


def test_toolbox(spark, tmp_path):
    import json

    from sparkloom import tools

    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text(PYTHON)
    (src / "b.rs").write_text(RUST)
    box = tools.Toolbox(spark, str(tmp_path / "root"))
    ask = lambda method, **params: json.loads(box.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))
    assert ask("initialize")["result"]["protocolVersion"] == "2024-11-05" and ask("ping")["result"] == {}
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == list(tools.ARGUMENTS)
    assert json.loads(box.answer("{"))["error"]["code"] == -32700 and ask("other")["error"]["code"] == -32601
    assert json.loads(box.answer('{"id": 2, "method": "tools/call"}'))["error"]["code"] == -32602

    def call(tool, **arguments):
        found = ask("tools/call", name=tool, arguments=arguments)["result"]
        return found["content"][0]["text"], found["isError"]

    assert call("none")[1] and call("semantic_search")[1] and call("semantic_search", query="x") == ("Nothing indexed yet: call index_directory first", True)
    assert json.loads(call("index_directory", path=str(src))[0])["total_files"] == 2
    assert "chunks fit" in call("semantic_search", query="adds two numbers")[0]
    assert f"1. {src}/a.py" in call("semantic_search", query="adds two numbers sum")[0]
    assert "top" in call("get_codebase_map")[0] and "long_name" in call("get_codebase_map", minimal=True)[0]
    assert f"id {src}/a.py:top" in call("search_symbols", query="TOP")[0]
    text, failed = call("expand_symbol", symbol_id=f"{src}/a.py:top", include_code=True)
    assert not failed and "   4 | def top(a, b):" in text
    assert call("expand_symbol", symbol_id="x")[1]
    assert "a.py" in call("find_similar_code", file=f"{src}/a.py")[0] and call("find_similar_code")[1]
    assert "Question: how?" in call("ask_codebase", question="how?")[0]
    assert "Symbols: 2" in call("get_file_context", file_path=f"{src}/a.py")[0] and call("get_file_context", file_path="x")[1]
    assert "  b.rs" in call("list_indexed_files", pattern="*.rs")[0] and "a.py" not in call("list_indexed_files", pattern="*.rs")[0]


def test_toolbox_folders_and_bad_requests(spark, tmp_path):
    import io
    import json

    from sparkloom import tools

    for name, text in (("a", PYTHON), ("b", RUST)):
        (tmp_path / name / "sub").mkdir(parents=True)
        (tmp_path / name / "sub" / f"{name}.{'py' if name == 'a' else 'rs'}").write_text(text)
    box, a, b = tools.Toolbox(spark, str(tmp_path / "root")), str(tmp_path / "a"), str(tmp_path / "b")
    requests = [
        {"id": 1, "method": "tools/call", "params": {"name": "index_directory", "arguments": {"path": a, "mode": "fast"}}},
        {"method": "notifications/initialized"},
        {"id": 2, "method": "tools/call", "params": {"name": "index_directory", "arguments": {"path": b, "mode": "fast"}}},
        {"id": 3, "method": "tools/call", "params": {"name": "semantic_search", "arguments": {"query": "numbers", "path": f"{a}/sub"}}},
        {"id": 4, "method": "tools/call", "params": {"name": "search_symbols", "arguments": {"query": "top", "path": b}}},
        {"id": 5, "method": "tools/call", "params": {"name": "semantic_search", "arguments": {"query": "x", "max_results": "3"}}},
        [],
        {"id": 6},
        {"id": 7, "method": "tools/call", "params": {"name": "semantic_search", "arguments": {"query": "x", "max_results": True}}},
        {"id": 8, "method": "tools/call", "params": {"name": "semantic_search", "arguments": {"query": "x", "max_results": 0}}},
        {"id": 9, "method": "tools/call", "params": {"name": "semantic_search", "arguments": [1]}},
        {"id": 10, "method": "tools/call", "params": {"name": "index_directory", "arguments": {"path": 5}}},
        {"id": 11, "method": "tools/call", "params": {"name": "semantic_search", "arguments": {"query": "x", "path": str(tmp_path / "c")}}},
        {"id": 12, "method": "tools/call", "params": {"name": "list_indexed_files", "arguments": {}}},
        {"id": 13, "method": "ping"},
    ]
    out = io.StringIO()
    assert box.serve([*(json.dumps(r) + "\n" for r in requests), "\n", "{\n"], out) == len(requests)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    by = {r["id"]: r for r in answers if r["id"] is not None}
    said = lambda n: by[n]["result"]["content"][0]["text"]
    assert "a.py" in said(3) and "b.rs" not in said(3) and "a.py" not in said(4)
    assert [by[n]["error"]["code"] for n in (5, 6, 7, 8, 9, 10)] == [-32602, -32600, -32602, -32602, -32602, -32602]
    assert sorted(r["error"]["code"] for r in answers if r["id"] is None) == [-32700, -32600]
    assert by[11]["result"]["isError"] and "b.rs" in said(12) and "a.py" not in said(12) and by[13]["result"] == {}
    again = tools.Toolbox(spark, str(tmp_path / "root"))
    again.scan = lambda *x: 1 / 0
    assert again.call("index_directory", {"path": a}) == ("index_directory failed: ZeroDivisionError: division by zero", True)


def test_rerankers():
    from sparkloom.operators import providers as P

    post = lambda url, body, headers: {"results": [{"index": 0, "relevance_score": len(headers["Authorization"])}]}
    assert P.reranker({}) is None and P.reranker({"cohere": "abc"}, post)("q", ["a", "b"]) == [10.0, 0.0]


def test_command_line(spark, tmp_path):
    from sparkloom import cli

    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text(PYTHON)
    (src / "b.rs").write_text(RUST)
    call = lambda *a: cli.run(spark, ["--root", str(tmp_path / "root"), *a])[0]
    assert call("status")["files"] == 0
    assert call("index", str(src))["indexed"] == 2 and call("i", str(src))["indexed"] == 0
    assert call("status")["files"] == 2 and len(call("st")["per_file"]) == 2
    found = call("search", "adds two numbers sum", "--content")
    assert found[0]["path"].endswith("a.py") and found[0]["rank"] == 1 and "def top" in found[0]["content"]
    assert {r["path"][-3:] for r in call("s", "x", "-t", "rs")} == {".rs"}
    assert "Question: why?" in call("ask", "why?")[0]["prompt"]
    assert call("compile", str(src))["symbols"] == 4 and call("symbols", "top")[0]["name"] == "top"
    store = indexing.Store(spark, str(tmp_path / "root"))
    own = graph.file_edges(spark.createDataFrame([(f"r:{src}/{n}", "r") for n in ("a.py", "b.rs")], "id string, repo_id string"))
    store.save_graph(graph.all_edges(own, graph.import_edges(spark.createDataFrame([(f"r:{src}/a.py", f"r:{src}/b.rs")], "src string, dst string"))))
    assert call("graph") == [{"file": f"r:{src}/a.py", "imports": 1}]
    assert {"section": "import", "name": f"{src}/b.rs"} in call("graph", "a.py")
    assert len(call("search", "adds two numbers sum", "-t", "py", "--related", "1")) > len(call("search", "adds two numbers sum", "-t", "py"))
    index = search.IvfIndex(cells=2, threshold=0)
    rows = store.table("chunks").select(F.monotonically_increasing_id().alias("vec_id"), "embedding")
    store.save_index(index, index.build(rows))
    again, table = store.load_index()
    assert again.size(table) == rows.count()
    assert indexing.sync(store, lambda: files.scan_tree(spark, str(src)))["indexed"] == 0
    assert call("clean", "--all")["removed"] == 1 and call("status")["files"] == 0


def test_definitions_of_java_and_typescript(spark):
    java = """class K {
    List<String> a(int x) throws E {
        if (x > 0) {
            return g("}");
        } else if (h(x)) {
            new Foo(x) { };
        }
        int y = k(x);
    }
    K() { this.x = '{'; }
    abstract void q();
    static <T> T one(T t) { return t; }
}
enum Z { P }
"""
    got = chunking.SyntaxChunker().definitions(java, "java")
    assert got == [(1, 13, "class", "K", None), (2, 9, "method", "a", "K"), (10, 10, "method", "K", "K"), (12, 12, "method", "one", "K"), (14, 14, "class", "Z", None)]
    typescript = """export class K {
  constructor(private a: X) {
    super(a);
    if (a) {
      foo(a, () => {
      });
    }
  }
  get v(): number { return 1; }
  sig(): void;
  x = bar(`}`);
  private static async *w<T>(
    a: T,
  ) {
    return a;
  }
}
"""
    got = chunking.SyntaxChunker().definitions(typescript, "typescript")
    assert got == [(1, 17, "class", "K", None), (2, 8, "method", "constructor", "K"), (9, 9, "method", "v", "K"), (12, 16, "method", "w", "K")]
    files = spark.createDataFrame([("a", None, "java"), ("b", "", "go"), ("c", "x = 1", None), (None, "func (t T) m() {\n}", "go")], "path string, content string, language string")
    assert [tuple(r) for r in chunking.definitions(files).collect()] == [(None, 1, 2, "method", "m", "T")]
