"""The opN_ queries: each applies one operator to its whole table and derives the digest columns from the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import (
    chat,
    decontaminate,
    hard_negatives,
    jaccard_join,
    line_dedup,
    pii,
    quality_model,
    quality_rules,
    sentencepieces,
    suffix_dedup,
    token_files,
    url_filter,
    whitening,
)
from sparkloom.session import scratch_path

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, coalesce('h' || source, '') AS host FROM documents),
w AS (SELECT doc_id, t, host, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) i, ws FROM w WHERE len(ws) >= 3),
win2 AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] g FROM win),
rep AS (SELECT doc_id, i FROM win2 QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
cov AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) p FROM rep) GROUP BY doc_id),
norm AS (SELECT doc_id, host, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(regexp_replace(
      translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') ls FROM d),
lines AS (SELECT doc_id, host, t AS doc, unnest(ls) line FROM norm),
often AS (SELECT host, line FROM lines GROUP BY host, line HAVING count(DISTINCT doc) > 10),
gone AS (SELECT doc_id, sum(len(line) - len(replace(line, ' ', '')) + 1) n FROM lines JOIN often USING (host, line) GROUP BY doc_id),
base AS (SELECT w.doc_id, len(ws)::BIGINT n_words, len(array_to_string(ws, ''))::BIGINT word_chars,
      (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines,
      coalesce(cov.n, 0)::BIGINT n_repeat_words, coalesce(gone.n, 0) removed
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id))
"""


@register(
    "op6_quality_rules",
    QUALITY_SQL
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (100 * (n_words - removed) < 20 * n_words) kept FROM base""",
)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return quality_rules.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: (host, path, action)
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@register(
    "op10_url_filter",
    """
WITH r(rh, rp, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT page_id, url, coalesce(position('://' IN url), 0) AS cut FROM pages),
h AS (SELECT page_id, CASE WHEN cut > 0 THEN regexp_extract(url[cut + 3:], '^[^/?#]*') ELSE '' END AS raw, CASE WHEN cut > 0 THEN url[cut + 3:] ELSE '' END AS rest FROM p),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest[len(raw) + 1:], '^[^?#]*') AS path FROM h),
listed AS (SELECT DISTINCT host || path AS address FROM (SELECT u.*, p.url FROM u JOIN p USING (page_id)) WHERE regexp_matches(url, '[?&]ref=')),
b AS (SELECT page_id, host, path, (SELECT max(struct_pack(n := len(rh || rp), rule := rh || rp, action := action)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best FROM u)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, CASE WHEN host || path IN (SELECT address FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM b""",
)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: the canonical form of every url of pages that has a ref parameter (bought links)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = pages.where(F.col("url").rlike("[?&]ref=")).select("url")
    found = url_filter.filter_urls(pages, url_filter.rules_table(spark, URL_RULES), listed)
    return found.select("page_id", "host", "path", "rule", "verdict")


def _byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    manifest = token_files.write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path, _byte_bpe())
    return token_files.read(spark, path, manifest)


CHAT_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations UNION ALL
  SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, replace(replace(replace(replace(replace(t, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), '</s>', '<' || chr(92) || '/s>'), '<s>', '<' || chr(92) || 's>'),
  '[INST]', '[' || chr(92) || 'INST]') AS e0 FROM c),
f AS (SELECT *, replace(e0, '[/INST]', '[' || chr(92) || '/INST]') AS esc FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  coalesce(sum(len(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(12 + len(r) + 1 + len(esc) + 11)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""


@register("op8_chat_format", CHAT_SQL)
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], rows.schema)
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


DECONTAMINATION_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(g, ' ') g, len(g) n FROM (SELECT item_id, ws[i:i + 9] g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) i FROM iw WHERE len(ws) > 0))),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i FROM dw, sizes WHERE len(ws) >= n)),
occ AS (SELECT DISTINCT doc_id, i, n, item_id FROM dg JOIN win USING (g, n)),
hit AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM occ) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item FROM occ) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""


@register("op4_decontamination", DECONTAMINATION_SQL)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate.judged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@register("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@register("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), piece_model())


@register("op7_quality_model")
def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality_model.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.scored(docs, model)


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2]) END) g FROM w),
e AS (SELECT doc_id, len(g) n, unnest(g) x FROM s),
c AS (SELECT a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * b.n >= 90 * a.n AND 100 * a.n >= 90 * b.n GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * i >= 90 * (na + nb - i)),
d AS (SELECT a x, b y FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT x AS node, x AS reach FROM (SELECT DISTINCT x FROM d) UNION SELECT r.node, d.y FROM r JOIN d ON r.reach = d.x)
SELECT s.doc_id, len(g)::BIGINT n_shingles, coalesce((SELECT min(reach) FROM r WHERE node = s.doc_id), s.doc_id)::BIGINT component_id,
  (SELECT count(*) FROM d WHERE x = s.doc_id)::BIGINT n_links FROM s"""


@register("op2_jaccard_join", JACCARD_SQL)
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_join.join(docs, words=3, percent=90)


@register("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=400, keep=False)


NEGATIVES_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


@register("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0, "vec_id", "label", "embedding")


@register("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "embedding")
    model = whitening.fit(rows, "embedding")
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.variances]).cast("array<double>")
    found = whitening.whiten(rows, "embedding", model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


LINES_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS txt, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(txt, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT doc_id, txt, pos, f.key IS NOT NULL AND doc_id <> top AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(txt, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""


@register("op13_line_dedup", LINES_SQL)
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
