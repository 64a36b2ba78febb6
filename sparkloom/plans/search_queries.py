"""Retrieval queries over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import scores as S
from sparkloom.functions import vectors as V
from sparkloom.functions.text import tokens
from sparkloom.operators import indexing, keyword, search
from sparkloom.operators.graph_index import GraphIndex
from sparkloom.plans import tables as T
from sparkloom.plans.catalogue import register
from sparkloom.session import scratch_path, written

TOKENS = "list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> '')"
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
COSINE = f"coalesce({DOT} / nullif(sqrt({DOT.format('{0}', '{0}')}) * sqrt({DOT.format('{1}', '{1}')}), 0), 0)"
BASE = f"""
WITH c AS (SELECT doc_id AS chunk_id, text, strlen(text) len FROM documents),
tot AS (SELECT count(*) n, sum(len)::DOUBLE / count(*) av FROM c),
tok AS (SELECT chunk_id, len, unnest({TOKENS.format('text')}) term FROM c),
tf AS (SELECT term, chunk_id, any_value(len) len, count(*) tf FROM tok GROUP BY term, chunk_id),
idf AS (SELECT term, count(*) df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) idf FROM tf, tot GROUP BY term)"""
BM25 = "idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))"


def _hybrid(extra: str = "", where: str = "") -> str:
    return (
        BASE
        + f""",
q AS (SELECT unnest({TOKENS.format("'" + T.QUERY + "'")}) term),
b AS (SELECT chunk_id, sum({BM25}) bm FROM q JOIN tf USING (term) JOIN idf USING (term), tot GROUP BY chunk_id),
v AS (SELECT d.doc_id AS chunk_id, d.text, d.lang, coalesce({COSINE.format("e.embedding", "(SELECT embedding FROM embeddings WHERE vec_id = " + str(T.QUERY_VECTOR) + ")")}, 0) vs
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id {where}),
s AS (SELECT chunk_id, text, lang, vs vector_score, 1 / (1 + exp(-0.1 * coalesce(bm, 0))) bm25_score, 0.7 * vs + 0.3 / (1 + exp(-0.1 * coalesce(bm, 0))) score FROM v LEFT JOIN b USING (chunk_id))"""
        + extra
    )


TOP = "SELECT chunk_id, round(score, 4) score, round(bm25_score, 4) bm25_score, round(vector_score, 4) vector_score, rank FROM (SELECT *, row_number() OVER (ORDER BY {0} DESC, chunk_id) AS rank FROM s) WHERE rank <= 10"


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 4) for n in names})


def _found(spark, sf, limit, **options):
    """Hybrid search of the fixed query; texts are read without a join with the vectors."""
    texts = T.texts(spark, sf)
    index = keyword.postings(texts, "chunk_id", "content", keyword.query_terms(spark, T.QUERY))
    return search.hybrid(T.chunks(spark, sf), T.QUERY, T.vector(spark, sf), limit, index=index, total=keyword.corpus(texts, "content"), **options)


@register("hybrid_search_top10", _hybrid() + TOP.format("score"))
def hybrid_search_top10(spark, sf):
    found = _found(spark, sf, 10)
    return rounded(found, "score", "bm25_score", "vector_score")


@register("filter_ext_search", _hybrid(where="WHERE lower(d.lang) IN ('de', 'fr')") + TOP.format("score"))
def filter_ext_search(spark, sf):
    found = _found(spark, sf, 10, path="path", types=["DE", ".fr"])
    return rounded(found, "score", "bm25_score", "vector_score")


@register("vector_topk", f"SELECT vec_id, round(vs, 4) vector_score, rank FROM (SELECT vec_id, vs, row_number() OVER (ORDER BY vs DESC, vec_id) AS rank FROM (SELECT vec_id, {COSINE.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 7)')} vs FROM embeddings)) WHERE rank <= 10")
def vector_topk(spark, sf):
    rows = search.with_cosine(T.read(spark, sf, "embeddings"), F.col("embedding"), T.vector(spark, sf)).select("vec_id", "vector_score")
    return rounded(search.best(rows, "vector_score", 10, "vec_id"), "vector_score")


_PAIRS = f"""SELECT query_id, vec_id, round(vs, 4) vector_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(vs, 9) DESC, vec_id) AS rank FROM (
SELECT a.vec_id query_id, b.vec_id, {COSINE.format('a.embedding', 'b.embedding')} vs FROM embeddings a, embeddings b WHERE {{}})) WHERE rank <= 5"""


@register("vector_topk_batch", _PAIRS.format("a.vec_id % 20 = 0"))
def vector_topk_batch(spark, sf):
    """Every vector whose id is divisible by 20 against all."""
    rows = T.read(spark, sf, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(search.vector_topk(rows, asked, 5), "vector_score")


@register("find_similar_code", _PAIRS.format("a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id"))
def find_similar_code(spark, sf):
    """Every vector whose id is divisible by 20 against all; itself is dropped."""
    rows = T.read(spark, sf, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = search.vector_topk(rows, asked, 6).where("query_id <> vec_id").drop("rank")
    return rounded(search.best(found, "vector_score", 5, "vec_id", "query_id"), "vector_score")


def ann_found(spark, sf):
    """Inverted-file search of every vector whose id is divisible by 20 against all rows; its recall is tested."""
    rows = T.read(spark, sf, "embeddings").select("vec_id", "embedding")
    index = search.IvfIndex(cells=16, threshold=0, copies=2)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return index.search(index.build(rows), asked, 10, probes=8)


@register("ann_ivf_topk")
def ann_ivf_topk(spark, sf):
    return rounded(ann_found(spark, sf), "vector_score")


def graph_index(spark, sf):
    """A graph index of all rows, and the queries: every vector whose id is divisible by 20. Recall and the part of the
    rows that is scored are tested."""
    rows = T.read(spark, sf, "embeddings").select("vec_id", "embedding")
    index = GraphIndex(search=16)
    return index, index.build(rows), rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@register("ann_graph_topk")
def ann_graph_topk(spark, sf):
    index, table, asked = graph_index(spark, sf)
    return rounded(index.search(table, asked, 10), "vector_score")


_KEPT = BASE.replace("FROM documents)", "FROM documents WHERE source IS DISTINCT FROM 'src3')", 1)


@register("bm25_incremental", _KEPT + " SELECT term, df, round(idf, 4) idf FROM idf")
def bm25_incremental(spark, sf):
    """Document frequencies that three commits have kept up: all documents, a third of them with other texts; the right
    texts of that third; the removal of one source."""
    docs = T.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source")
    store, third = indexing.Store(spark, scratch_path(spark, "kept-up")), F.col("id") % 3 == 0
    other = F.when(third, F.concat(F.lit("an older text "), F.substring("content", 1, 50))).otherwise(F.col("content"))
    step = store.begin()
    first = step.restart("chunks", docs.withColumn("content", other), "id", order=("id",))
    indexing.start_statistics(step, first)
    step.commit()
    for new, old in ((third, third), (F.lit(False), F.col("source") == "src3")):
        step, had = store.begin(), store.table("chunks")
        lost = written(had.where(old).select("id", "content"), "lost")
        stored = step.change("chunks", docs.where(new), lost.select("id"), "id", ("id",))
        indexing.change_statistics(step, stored, lost)
        step.commit()
    return rounded(store.table("idf"), "idf")


@register("bm25_idf", BASE + " SELECT term, df, round(idf, 4) idf FROM idf")
def bm25_idf(spark, sf):
    chunks = T.texts(spark, sf)
    return rounded(keyword.document_frequencies(keyword.postings(chunks, "chunk_id", "content"), keyword.corpus(chunks, "content")), "idf")


@register("bm25_top_terms", BASE + " SELECT term, df, round(idf, 4) idf FROM idf ORDER BY df DESC, term LIMIT 20")
def bm25_top_terms(spark, sf):
    return bm25_idf(spark, sf).orderBy(F.desc("df"), "term").limit(20)


@register("bm25_topk", BASE + f", q AS (SELECT unnest({TOKENS.format(chr(39) + T.QUERY + chr(39)) }) term), s AS (SELECT chunk_id, sum({BM25}) bm FROM q JOIN tf USING (term) JOIN idf USING (term), tot GROUP BY chunk_id) SELECT chunk_id, round(bm, 4) bm25, rank FROM (SELECT *, row_number() OVER (ORDER BY round(bm, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= 10")
def bm25_topk(spark, sf):
    chunks = T.texts(spark, sf)
    asked = spark.createDataFrame([(0, T.QUERY)], "query_id long, query string")
    index = keyword.postings(chunks, "chunk_id", "content", keyword.query_terms(spark, T.QUERY))
    found = keyword.scores(index, keyword.corpus(chunks, "content"), asked, "chunk_id")
    return rounded(search.best(found.select("chunk_id", F.round("bm25", 9).alias("bm25")), "bm25", 10, "chunk_id"), "bm25")


@register("bm25_batch", BASE + f", q AS (SELECT item_id query_id, unnest({TOKENS.format('text')}) term FROM benchmark), s AS (SELECT query_id, chunk_id, sum({BM25}) bm FROM q JOIN tf USING (term) JOIN idf USING (term), tot GROUP BY query_id, chunk_id) SELECT query_id, chunk_id, round(round(bm, 6), 4) bm25, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm, 6) DESC, chunk_id) AS rank FROM s) WHERE rank <= 5")
def bm25_batch(spark, sf):
    chunks = T.texts(spark, sf)
    found = keyword.scores(keyword.postings(chunks, "chunk_id", "content"), keyword.corpus(chunks, "content"), T.queries(spark, sf), "chunk_id")
    return rounded(search.best(found.withColumn("bm25", F.round("bm25", 6)), "bm25", 5, "chunk_id", "query_id"), "bm25")


@register("bm25_normalized_zero_match", "SELECT doc_id chunk_id, 0.5::DOUBLE bm25_score FROM documents WHERE NOT list_contains(" + TOKENS.format("text") + ", 'the')")
def bm25_normalized_zero_match(spark, sf):
    chunks = T.texts(spark, sf)
    asked = spark.createDataFrame([(0, "the")], "query_id long, query string")
    found = keyword.scores(keyword.postings(chunks, "chunk_id", "content"), keyword.corpus(chunks, "content"), asked, "chunk_id")
    return chunks.join(found, "chunk_id", "left").where("bm25 IS NULL").select("chunk_id", S.bm25_normalised(F.coalesce("bm25", F.lit(0.0))).alias("bm25_score"))


@register("postings_terms", BASE + " SELECT term, chunk_id, tf, len::DOUBLE length FROM tf")
def postings_terms(spark, sf):
    """The whole inverted index."""
    return keyword.postings(T.texts(spark, sf), "chunk_id", "content")


_RERANK = ", k AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS r0 FROM s), s2 AS (SELECT chunk_id, score + 0.05 * len(list_filter(list_distinct(" + TOKENS.format("'" + T.QUERY + "'") + "), lambda t: contains(lower(text), t))) score FROM k WHERE r0 <= 30) SELECT chunk_id, round(score, 4) score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM s2"


@register("keyword_rerank", _hybrid(_RERANK))
def keyword_rerank(spark, sf):
    found = F.broadcast(_found(spark, sf, 10 * search.OVERFETCH))
    found = T.texts(spark, sf).select("chunk_id", "content").join(found, "chunk_id")
    return rounded(search.keyword_rerank(found, T.QUERY, "chunk_id").select("chunk_id", "score", "rank"), "score")


@register("rerank_passthrough", _hybrid() + "SELECT chunk_id, round(score, 4) score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 7")
def rerank_passthrough(spark, sf):
    found = _found(spark, sf, 21)
    return rounded(search.rerank(found, None, T.QUERY, 7, "chunk_id").select("chunk_id", "score", "rank"), "score")


_LATE = f"""
WITH qt AS (SELECT vec_id n, embedding e FROM embeddings WHERE vec_id < 4), dt AS (SELECT label doc_id, embedding e FROM embeddings WHERE label IS NOT NULL AND vec_id >= 4),
m AS (SELECT doc_id, n, max({COSINE.format('qt.e', 'dt.e')}) mx FROM qt, dt GROUP BY doc_id, n), l AS (SELECT doc_id, avg(mx) late FROM m GROUP BY doc_id)"""


def _late(spark, sf):
    rows = T.read(spark, sf, "embeddings")
    asked = rows.where("vec_id < 4").select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("token"))
    return search.late_interaction(asked, rows.where("vec_id >= 4").select(F.col("label").alias("doc_id"), F.col("embedding").alias("token")))


@register("colbert_maxsim", _LATE + " SELECT doc_id, round(late, 4) late_score FROM l")
def colbert_maxsim(spark, sf):
    return rounded(_late(spark, sf).select("doc_id", "late_score"), "late_score")


@register("hybrid_colbert_blend", _LATE + f", v AS (SELECT label doc_id, max({COSINE.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 7)')}) vs FROM embeddings WHERE vec_id >= 4 GROUP BY label) SELECT doc_id, round(0.35 * vs + 0.35 * late + 0.3 * 0.5, 4) score FROM l JOIN v USING (doc_id)")
def hybrid_colbert_blend(spark, sf):
    rows = search.with_cosine(T.read(spark, sf, "embeddings").where("vec_id >= 4"), F.col("embedding"), T.vector(spark, sf))
    per = rows.groupBy(F.col("label").alias("doc_id")).agg(F.max("vector_score").alias("v"))
    return _late(spark, sf).join(per, "doc_id").select("doc_id", F.round(S.blended(F.col("v"), F.lit(0.5), F.col("late_score")), 4).alias("score"))


@register("l2_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) / nullif(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 0), 4) length, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) total FROM embeddings")
def l2_normalize(spark, sf):
    n = T.read(spark, sf, "embeddings").select("vec_id", V.normalised(F.col("embedding")).alias("v"))
    return n.select("vec_id", F.round(V.norm(F.col("v")), 4).alias("length"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


_FUSE = {
    "weighted": "0.4 * p[1]::DOUBLE + 0.6 * p[2]::DOUBLE",
    "max": "greatest(p[1]::DOUBLE, p[2]::DOUBLE)",
    "mean": "(p[1]::DOUBLE + p[2]::DOUBLE) / 2",
    "adaptive": "(abs(p[1]::DOUBLE) * p[1]::DOUBLE + abs(p[2]::DOUBLE) * p[2]::DOUBLE) / (abs(p[1]::DOUBLE) + abs(p[2]::DOUBLE) + 1e-8)",
}


def _fusion(how: str):
    def run(spark, sf):
        e = T.read(spark, sf, "embeddings").select("vec_id", "embedding")
        nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
        f = e.join(nxt, "vec_id").select("vec_id", V.fused(F.col("embedding"), F.col("other"), how).alias("v"))
        return f.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.round(F.element_at("v", 1), 4).alias("first"))

    return run


for _how, _rule in _FUSE.items():
    register(
        f"fusion_{_how}",
        f"WITH f AS (SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda p: {_rule}) v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) l FROM f) SELECT vec_id, round(list_sum(v) / l, 4) total, round(v[1] / l, 4) AS first FROM n",
    )(_fusion(_how))


@register("ask_context", _hybrid(", t AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT string_agg('--- File: ' || source || '/' || doc_id || '.' || d.lang || ' (lines 1-1) ---' || chr(10) || d.text || chr(10), chr(10) ORDER BY rank) AS context FROM t JOIN documents d ON d.doc_id = t.chunk_id WHERE rank <= 5"))
def ask_context(spark, sf):
    found = T.texts(spark, sf).join(F.broadcast(_found(spark, sf, 5)), "chunk_id")
    return search.answer_context(found.withColumns({"start_line": F.lit(1), "end_line": F.lit(1)}))


@register("blend_weights", _hybrid() + "SELECT chunk_id, round(0.5 * vector_score + 0.5 * bm25_score, 4) score, rank FROM (SELECT *, row_number() OVER (ORDER BY 0.5 * vector_score + 0.5 * bm25_score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10")
def blend_weights(spark, sf):
    found = _found(spark, sf, 10, weights=(0.5, 0.5))
    return rounded(found.select("chunk_id", "score", "rank"), "score")


@register("score_percent_bands", _hybrid() + "SELECT chunk_id, floor(greatest(round(score, 6) * 100, 0))::BIGINT score_pct, CASE WHEN round(score, 6) >= 0.7 THEN 'high' WHEN round(score, 6) >= 0.4 THEN 'medium' ELSE 'low' END score_band FROM s ORDER BY score DESC, chunk_id LIMIT 50")
def score_percent_bands(spark, sf):
    found = _found(spark, sf, 50).withColumn("score", F.round("score", 6))
    return found.select("chunk_id", S.percent(F.col("score")).alias("score_pct"), S.band(F.col("score")).alias("score_band"))


@register("query_tokens", f"SELECT item_id query_id, len({TOKENS.format('text')})::BIGINT n_tokens, len(list_distinct({TOKENS.format('text')}))::BIGINT n_distinct FROM benchmark")
def query_tokens(spark, sf):
    t = tokens(F.col("query"))
    return T.queries(spark, sf).select("query_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))
