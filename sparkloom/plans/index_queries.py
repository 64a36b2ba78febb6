"""Queries of scanning, chunking, indexing, catalog, symbols, graph, history and change feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import chunking, graph, imports, indexing, keyword, symbols
from sparkloom.plans import tables as T
from sparkloom.plans.catalogue import register
from sparkloom.plans.search_queries import TOKENS
from sparkloom.sources import files as scan
from sparkloom.sources import history
from sparkloom.streaming import changes

PATH = "source || '/' || doc_id || '.' || lang"
LINES = "CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END"


def _files(spark, sf):
    return T.read(spark, sf, "documents").select(T.path().alias("path"), F.col("text").alias("content"), F.lit(None).cast("string").alias("language"), "doc_id", "source", "lang")


@register("file_hash", f"SELECT {PATH} path, sha256(text) hash FROM documents")
def file_hash(spark, sf):
    return _files(spark, sf).select("path", X.file_hash(F.col("content")).alias("hash"))


@register("chunk_id", f"SELECT doc_id, substr(sha256({PATH} || ':1:' || doc_id), 1, 16) id FROM documents")
def chunk_id(spark, sf):
    return _files(spark, sf).select("doc_id", X.chunk_id(F.col("path"), F.lit(1), F.col("doc_id")).alias("id"))


@register("repo_and_file_id", "SELECT s_suppkey, substr(sha256(s_name), 1, 16) repo_id, substr(sha256(s_name), 1, 16) || ':' || s_name file_id FROM supplier")
def repo_and_file_id(spark, sf):
    r = X.repo_id(F.col("s_name"))
    return T.read(spark, sf, "supplier").select("s_suppkey", r.alias("repo_id"), X.file_id(r, F.col("s_name")).alias("file_id"))


_NEW = "SELECT {p} path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) hash FROM documents WHERE doc_id % 11 <> 3".format(p=PATH)
_OLD = f"SELECT {PATH} path, sha256(text) hash FROM documents WHERE doc_id % 5 <> 1"


def _now(spark, sf):
    f = _files(spark, sf).where("doc_id % 11 <> 3")
    return f.withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).select("path", X.file_hash(F.col("content")).alias("hash"))


def _before(spark, sf):
    return _files(spark, sf).where("doc_id % 5 <> 1").select("path", X.file_hash(F.col("content")).alias("hash"))


@register("incremental_changed", f"WITH n AS ({_NEW}), o AS ({_OLD}) SELECT path, hash FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = n.path AND o.hash = n.hash)")
def incremental_changed(spark, sf):
    return indexing.changed(_now(spark, sf), _before(spark, sf))


@register("incremental_upsert", f"WITH n AS ({_NEW}), o AS ({_OLD}) SELECT path, hash FROM n UNION ALL SELECT path, hash FROM o WHERE path NOT IN (SELECT path FROM n)")
def incremental_upsert(spark, sf):
    return indexing.upsert(_before(spark, sf), _now(spark, sf), "path")


@register("remove_file", f"SELECT {PATH} path, doc_id FROM documents WHERE source <> 'src3'")
def remove_file(spark, sf):
    f = _files(spark, sf)
    return indexing.removed(f.select("path", "doc_id"), f.where("source = 'src3'"), "path")


_ODD = "source || '/' || CASE doc_id % 6 WHEN 0 THEN doc_id || '.RS' WHEN 1 THEN 'Makefile' WHEN 2 THEN '.hidden' WHEN 3 THEN doc_id || '.exe' WHEN 4 THEN 'a.b/' || doc_id || '.h' ELSE doc_id || '.tar.py' END"


def _odd(spark, sf):
    name = (
        F.when(F.col("doc_id") % 6 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(".RS")))
        .when(F.col("doc_id") % 6 == 1, F.lit("Makefile"))
        .when(F.col("doc_id") % 6 == 2, F.lit(".hidden"))
        .when(F.col("doc_id") % 6 == 3, F.concat(F.col("doc_id").cast("string"), F.lit(".exe")))
        .when(F.col("doc_id") % 6 == 4, F.concat(F.lit("a.b/"), F.col("doc_id").cast("string"), F.lit(".h")))
        .otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".tar.py")))
    )
    return T.read(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), name).alias("path"), F.col("text").cast("binary").alias("content"))


@register("scan_filter", f"SELECT {_ODD} path, strlen(text)::BIGINT bytes FROM documents WHERE doc_id % 6 IN (0, 1, 4, 5) AND strlen(text) <= 1000000")
def scan_filter(spark, sf):
    return scan.as_files(_odd(spark, sf)).select("path", F.octet_length("content").cast("long").alias("bytes"))


@register("detect_language", f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'rust' WHEN 4 THEN 'c' WHEN 5 THEN 'python' END language, CASE doc_id % 6 WHEN 0 THEN 'rust' WHEN 4 THEN 'c' WHEN 5 THEN 'python' END chunk_language, CASE doc_id % 6 WHEN 0 THEN 'rust' WHEN 4 THEN 'cpp' WHEN 5 THEN 'python' ELSE 'unknown' END symbol_language FROM documents")
def detect_language(spark, sf):
    p = F.col("path")
    return _odd(spark, sf).select("doc_id", X.language(p, X.FILE_LANGUAGES).alias("language"), X.language(p, X.CHUNK_LANGUAGES).alias("chunk_language"), X.language(p, X.SYMBOL_LANGUAGES, "unknown").alias("symbol_language"))


@register("list_files_glob", f"SELECT {PATH} path FROM documents WHERE starts_with({PATH}, 'src1') AND ends_with({PATH}, '.en')")
def list_files_glob(spark, sf):
    return _files(spark, sf).where(X.glob_match(F.col("path"), "src1*.en")).select("path")


@register("files_by_dir", f"SELECT source dir, count(*) files, string_agg(doc_id || '.' || lang, ',' ORDER BY doc_id || '.' || lang) names FROM documents GROUP BY source")
def files_by_dir(spark, sf):
    f = _files(spark, sf).select(X.directory(F.col("path")).alias("dir"), X.file_name(F.col("path")).alias("name"))
    return f.groupBy("dir").agg(F.count("*").alias("files"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


@register("index_status", f"SELECT (SELECT count(DISTINCT source) FROM documents) files, (SELECT count(*) FROM documents) chunks, (SELECT count(DISTINCT t) FROM (SELECT unnest({TOKENS.format('text')}) t FROM documents)) vocabulary, (SELECT count(*) FROM documents) * 256.0::DOUBLE / 1048576 megabytes")
def index_status(spark, sf):
    c = T.texts(spark, sf)
    idf = keyword.document_frequencies(keyword.postings(c, "chunk_id", "content"), keyword.corpus(c, "content"))
    return indexing.status(T.read(spark, sf, "documents").select("source").distinct(), c, idf, 64)


@register("chunks_per_file", "SELECT source AS path, count(*) chunks FROM documents GROUP BY source")
def chunks_per_file(spark, sf):
    return T.read(spark, sf, "documents").groupBy(F.col("source").alias("path")).agg(F.count("*").alias("chunks"))


@register("chunks_for_file", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents WHERE source = 'src2'")
def chunks_for_file(spark, sf):
    docs = T.read(spark, sf, "documents").select("doc_id", "source")
    lists = docs.groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("chunk_ids")).where("source = 'src2'")
    return lists.select(F.posexplode("chunk_ids").alias("position", "doc_id")).join(docs.select("doc_id"), "doc_id").select("doc_id", F.col("position").cast("long").alias("position"))


@register("token_estimate", "SELECT doc_id, (strlen(text) // 4)::BIGINT tokens FROM documents")
def token_estimate(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@register("human_size", "SELECT doc_id, CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' B' ELSE printf('%.1f KB', strlen(text) / 1024.0::DOUBLE) END size FROM documents")
def human_size(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", X.human_size(F.octet_length("text")).alias("size"))


@register("json_output", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def json_output(spark, sf):
    return indexing.as_json(T.read(spark, sf, "nation").select("n_nationkey", "n_name"))


@register("line_counts", f"SELECT doc_id, len({LINES})::BIGINT n_lines FROM documents")
def line_counts(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", F.size(X.lines(F.col("text"))).cast("long").alias("n_lines"))


_FOLD = f"""
WITH RECURSIVE l AS (SELECT {PATH} path, {LINES} ls FROM documents), x AS (SELECT path, ls FROM l WHERE len(ls) > 0),
s AS (SELECT path, ls, 1 i, 1 st, 0::BIGINT sz, 0 cs, 0 ce, 0 made FROM x UNION ALL
  SELECT path, ls, i + 1, CASE WHEN sz + strlen(ls[i]) + 1 >= 1500 THEN greatest(i - 2, 1) ELSE st END, CASE WHEN sz + strlen(ls[i]) + 1 >= 1500 THEN 0 ELSE sz + strlen(ls[i]) + 1 END,
    CASE WHEN sz + strlen(ls[i]) + 1 >= 1500 THEN st ELSE 0 END, CASE WHEN sz + strlen(ls[i]) + 1 >= 1500 THEN i ELSE 0 END, made + (sz + strlen(ls[i]) + 1 >= 1500)::INT FROM s WHERE i <= len(ls)),
e AS (SELECT path, cs a, ce b FROM s WHERE ce > 0 UNION ALL SELECT path, st, len(ls) FROM s WHERE i = len(ls) + 1 AND (made = 0 OR strlen(array_to_string(ls[st:], chr(10))) >= 100))
SELECT path, a::BIGINT start_line, b::BIGINT end_line FROM e"""


@register("simple_chunk", _FOLD)
def simple_chunk(spark, sf):
    """Chunks by size alone: a language whose patterns match no line here."""
    f = _files(spark, sf).withColumn("language", F.lit("go"))
    return chunking.chunk_files(f).select("path", "start_line", "end_line")


def _code(spark, sf):
    """A source file of each part, in four languages by its key: an import, a function, a class with a method, and a
    function of 60 lines, which is over 1,500 bytes."""
    p = T.spread(T.read(spark, sf, "part").select("p_partkey"))
    n, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    pad = F.repeat(F.lit("w"), 90)

    def text(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    row = lambda x: F.repeat(F.concat(F.lit(x), F.repeat(F.lit("v"), 30), F.lit("\n")), 60)
    python = text("import os\n\ndef f", n, "(a):\n    return '", pad, "'\n\nclass C", n, ":\n    def m(self):\n        return '", pad, "'\n\ndef g(a):\n", row("    a = "))
    rust = text("use a::b;\n\nfn f", n, "(a: u8) {\n    // ", pad, "\n}\n\nimpl C", n, " {\n    fn m(&self) {\n        // ", pad, "\n    }\n}\n\nfn g() {\n", row("    b = "), "}\n")
    go = text("import x\n\nfunc f", n, "(a int) {\n    // ", pad, "\n}\n\ntype C", n, " struct {\n    // ", pad, "\n}\n\nfunc g() {\n", row("    b = "), "}\n")
    typescript = text("import x from 'y'\n\nfunction f", n, "(a) {\n    // ", pad, "\n}\n\nclass C", n, " {\n    // ", pad, "\n}\n\nfunction g() {\n", row("    b = "), "}\n")
    content = F.when(k == 0, python).when(k == 1, rust).when(k == 2, go).otherwise(typescript)
    language = F.element_at(F.array(*map(F.lit, ("python", "rust", "go", "typescript"))), (k + 1).cast("int"))
    return p.select(F.concat(F.lit("p/"), n).alias("path"), content.alias("content"), language.alias("language"))


# of each language: type, name ({} stands for the part), parent, first and last line
_BLOCKS = {
    0: [("function", "f{}", None, 3, 4), ("class", "C{}", None, 6, 8), ("function", "g", None, 10, 48), ("function", "g", None, 49, 70)],
    1: [("function", "f{}", None, 3, 5), ("class", "C{}", None, 7, 11), ("function", "g", None, 13, 51), ("function", "g", None, 52, 74)],
    2: [("function", "f{}", None, 3, 5), ("class", "C{}", None, 7, 9), ("function", "g", None, 11, 49), ("function", "g", None, 50, 72)],
    3: [("function", "f{}", None, 3, 5), ("class", "C{}", None, 7, 9), ("function", "g", None, 11, 49), ("function", "g", None, 50, 72)],
}
_VALUES = ", ".join(f"({k}, '{t}', '{n}', {a}, {b})" for k, rows in _BLOCKS.items() for t, n, _, a, b in rows)


@register("chunk_code", f"SELECT 'p/' || p_partkey path, a::BIGINT start_line, b::BIGINT end_line, t chunk_type, replace(n, '{{}}', p_partkey::VARCHAR) AS name FROM part JOIN (VALUES {_VALUES}) v(k, t, n, a, b) ON p_partkey % 4 = k")
def chunk_code(spark, sf):
    """Syntax chunks of a source file of each part; the methods lie in their classes and go, oversize functions are cut."""
    return chunking.chunk_files(_code(spark, sf), syntax=True).select("path", "start_line", "end_line", "chunk_type", "name")


# Sources with braces and definitions in strings, comments, raw and template literals; {} stands for the part.
_OUTLINED = {
    "python": '''import os

class A{}:
    x = "def no(): {{"
    class B:
        def m(self):
            return """
def ghost():
"""
    def n(self):
        # class Gone:
        return 1

def f{}(a):
    return "class No:"
''',
    "rust": '''use a::b;

impl A{} {
    const S: &str = r#"fn no() { "} "#;
    fn m(&self) -> char {
        '{'
    }
    /* fn ghost() {
    } */
    fn n(&self) {
        let s = "}";
    }
}

fn f{}() {
    // }
}
''',
    "typescript": '''import x from 'y'

class A{} {
    s = `class no { ${ "}" } `;
    async m(a) {
        return "}";
    }
    /* function ghost() {
    } */
    n(a) {
        return '{';
    }
}

function f{}() {
    // }
}
''',
    "go": '''import x

type A{} struct {
    s string
}

func (a *A{}) m() rune {
    return '{'
}

/* func ghost() {
} */
func (A{}) n() string {
    return `
func no() { `
}

func f{}() {
    // }
}
''',
    "java": '''import a.b;

public class A{} {
    String s = "}";
    public class B {
        public int m() {
            return '{';
        }
    }
    /* public int ghost() {
    } */
    public int n() {
        // }
        return 1;
    }
}
''',
}
# of each language: type, name, parent, first and last line
_OUTLINES = {
    "python": [
        ("import", None, None, 1, 1),
        ("class", "A{}", None, 3, 12),
        ("class", "B", "A{}", 5, 9),
        ("method", "m", "B", 6, 9),
        ("method", "n", "A{}", 10, 12),
        ("function", "f{}", None, 14, 15),
    ],
    "rust": [
        ("import", None, None, 1, 1),
        ("class", "A{}", None, 3, 13),
        ("method", "m", "A{}", 5, 7),
        ("method", "n", "A{}", 10, 12),
        ("function", "f{}", None, 15, 17),
    ],
    "typescript": [
        ("import", None, None, 1, 1),
        ("class", "A{}", None, 3, 13),
        ("method", "m", "A{}", 5, 7),
        ("method", "n", "A{}", 10, 12),
        ("function", "f{}", None, 15, 17),
    ],
    "go": [
        ("import", None, None, 1, 1),
        ("class", "A{}", None, 3, 5),
        ("method", "m", "A{}", 7, 9),
        ("method", "n", "A{}", 13, 16),
        ("function", "f{}", None, 18, 20),
    ],
    "java": [
        ("import", None, None, 1, 1),
        ("class", "A{}", None, 3, 16),
        ("class", "B", "A{}", 5, 9),
        ("method", "m", "B", 6, 8),
        ("method", "n", "A{}", 12, 15),
    ],
}
_OUTLINE_VALUES = ", ".join(
    f"({k}, '{t}', {repr(n) if n else 'NULL'}, {repr(p) if p else 'NULL'}, {a}, {b})" for k, rows in enumerate(_OUTLINES.values()) for t, n, p, a, b in rows
)


@register(
    "code_definitions",
    f"""SELECT 'p/' || p_partkey path, a::BIGINT start_line, b::BIGINT end_line, t chunk_type, replace(n, '{{}}', p_partkey::VARCHAR) AS name, replace(p, '{{}}', p_partkey::VARCHAR) parent_name
FROM part JOIN (VALUES {_OUTLINE_VALUES}) v(k, t, n, p, a, b) ON p_partkey % 5 = k""",
)
def code_definitions(spark, sf):
    """The outline of a source file of each part, in five languages by its key: definitions inside of others with their
    parents, methods by receiver, and none in strings and comments."""
    n, k = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 5 + 1).cast("int")
    content = F.replace(F.element_at(F.array(*map(F.lit, _OUTLINED.values())), k), F.lit("{}"), n)
    files = T.spread(T.read(spark, sf, "part").select("p_partkey")).select(F.concat(F.lit("p/"), n).alias("path"), content.alias("content"), F.element_at(F.array(*map(F.lit, _OUTLINED)), k).alias("language"))
    return chunking.definitions(files)


# the same files by the chunker that goes line by line: blocks under 100 bytes go, pieces overlap by two lines
_LINE_BLOCKS = {
    0: [("function", 3, 5), ("class", 6, 9), ("function", 10, 48), ("function", 47, 70)],
    1: [("function", 3, 5), ("class", 7, 11), ("function", 13, 51), ("function", 50, 74)],
    2: [("function", 3, 5), ("class", 7, 9), ("function", 11, 49), ("function", 48, 72)],
    3: [("function", 3, 5), ("class", 7, 9), ("function", 11, 49), ("function", 48, 72)],
}
_LINE_VALUES = ", ".join(f"({k}, '{t}', {a}, {b})" for k, rows in _LINE_BLOCKS.items() for t, a, b in rows)


@register("chunk_lines", f"SELECT 'p/' || p_partkey path, a::BIGINT start_line, b::BIGINT end_line, t chunk_type FROM part JOIN (VALUES {_LINE_VALUES}) v(k, t, a, b) ON p_partkey % 4 = k")
def chunk_lines(spark, sf):
    return chunking.chunk_files(_code(spark, sf)).select("path", "start_line", "end_line", "chunk_type")


@register(
    "dedup_contained",
    "WITH s AS (SELECT DISTINCT l_suppkey g, l_partkey % 97 AS a, l_partkey % 97 + l_quantity::BIGINT AS b FROM lineitem) SELECT g, a, b FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.g = s.g AND o.a <= s.a AND o.b >= s.b AND (o.a < s.a OR o.b > s.b))",
)
def dedup_contained(spark, sf):
    s = T.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_partkey") % 97).alias("a"), (F.col("l_partkey") % 97 + F.col("l_quantity").cast("long")).alias("b"))
    return chunking.drop_contained(s, "g", "a", "b")


@register("hierarchy_path", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_name ELSE p_brand || '::' || p_name END path FROM part")
def hierarchy_path(spark, sf):
    name = F.when(F.col("p_size") % 3 != 0, F.col("p_name"))
    return T.read(spark, sf, "part").select("p_partkey", X.hierarchy(F.when(F.col("p_size") % 3 == 2, F.col("p_brand")), name).alias("path"))


# ---- symbols: part names


def _symbols(spark, sf):
    p = T.read(spark, sf, "part")
    kind = F.element_at(F.array(*map(F.lit, ("function", "struct", "method", "class", "trait"))), (F.col("p_size") % 5 + 1).cast("int"))
    return p.select(
        F.concat("p_brand", F.lit(":"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_size").cast("long").alias("line"),
        kind.alias("kind"), F.concat(F.lit("fn "), "p_name").alias("signature"), F.col("p_type").alias("summary"),
    )


_SYM = "WITH s AS (SELECT p_brand || ':' || p_partkey id, p_name AS name, p_brand AS file, CASE p_size % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'struct' WHEN 2 THEN 'method' WHEN 3 THEN 'class' ELSE 'trait' END kind, 'fn ' || p_name signature, p_type summary FROM part)"


@register("symbol_search", _SYM + " SELECT id, name, lower(name) = 'red widget' AS exact, row_number() OVER (ORDER BY lower(name) = 'red widget' DESC, id) AS rank FROM s WHERE contains(lower(name), 'red widget') OR contains(lower(signature), 'red widget') OR contains(lower(summary), 'red widget')")
def symbol_search(spark, sf):
    return symbols.search(_symbols(spark, sf), "Red Widget").select("id", "name", "exact", "rank")


@register("symbol_stats", _SYM + " SELECT count(*) symbols, count(*) FILTER (kind IN ('function', 'method')) functions, count(*) FILTER (kind IN ('struct', 'class')) structs, count(*) FILTER (kind NOT IN ('function', 'method', 'struct', 'class')) other FROM s")
def symbol_stats(spark, sf):
    return symbols.stats(_symbols(spark, sf))


@register("symbol_expand", _SYM + ", e AS (SELECT DISTINCT a.p_brand || ':' || a.p_partkey src, b.p_brand || ':' || b.p_partkey dst FROM part a JOIN part b ON b.p_partkey = a.p_partkey % 50 + 1) SELECT 'depended_by' direction, s.id, s.name FROM e JOIN s ON s.id = e.src WHERE e.dst = (SELECT p_brand || ':' || p_partkey FROM part WHERE p_partkey = 7) UNION ALL SELECT 'depends_on', s.id, s.name FROM e JOIN s ON s.id = e.dst WHERE e.src = (SELECT p_brand || ':' || p_partkey FROM part WHERE p_partkey = 7)")
def symbol_expand(spark, sf):
    p = T.read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat("p_brand", F.lit(":"), "p_partkey").alias("id"))
    e = p.select(F.col("id").alias("src"), (F.col("k") % 50 + 1).alias("k")).join(p.withColumnRenamed("id", "dst"), "k").select("src", "dst")
    seven = p.where("k = 7").first()["id"]
    return symbols.expand(_symbols(spark, sf), e, seven).select("direction", "id", "name")


@register("overview_minimal", _SYM + " SELECT file, file || ': ' || coalesce(string_agg(name, ', ' ORDER BY id) FILTER (kind IN ('function', 'method')), '') overview FROM s GROUP BY file")
def overview_minimal(spark, sf):
    return symbols.minimal_overview(_symbols(spark, sf))


@register("overview_compact", _SYM + " SELECT file, '## ' || file || chr(10) || string_agg('  ' || kind || ' ' || signature || ' // ' || summary, chr(10) ORDER BY id) || chr(10) overview FROM s GROUP BY file")
def overview_compact(spark, sf):
    return symbols.compact_overview(_symbols(spark, sf))


@register("symbol_upsert", "SELECT p_brand id, max(p_partkey) line FROM part GROUP BY p_brand")
def symbol_upsert(spark, sf):
    return symbols.latest(T.read(spark, sf, "part").select(F.col("p_brand").alias("id"), F.col("p_partkey").alias("line")), "id", "line")


@register("simplify_params", "WITH p AS (SELECT p_partkey, trim(p_name || ',' || p_type || ', ' || p_brand || ',' || p_name || ' ' || p_type) x FROM part) SELECT p_partkey, CASE WHEN strlen(x) > 50 AND len(string_split(x, ',')) > 3 THEN len(string_split(x, ',')) || '...' ELSE x END params FROM p")
def simplify_params(spark, sf):
    x = F.concat("p_name", F.lit(","), "p_type", F.lit(", "), "p_brand", F.lit(","), "p_name", F.lit(" "), "p_type")
    return T.read(spark, sf, "part").select("p_partkey", X.simplified_params(x).alias("params"))


@register("snippet", f"WITH l AS (SELECT doc_id, {LINES} ls FROM documents) SELECT doc_id, array_to_string(list_concat(list_transform(range(2, least(len(ls), 31) + 1), lambda i: lpad(i::VARCHAR, 4, ' ') || ' | ' || ls[i]), CASE WHEN len(ls) > 31 THEN ['     | ...'] ELSE [] END), chr(10)) snippet FROM l")
def snippet(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", symbols.snippet(F.col("text"), F.lit(2)).alias("snippet"))


_PARSED = """WITH p AS (SELECT p_partkey k, 'p/' || p_partkey f, 'f' || p_partkey n FROM part)
SELECT f || ':' || n id, n AS name, f AS file, CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 2 END::BIGINT line, 'function' kind,
  CASE k % 4 WHEN 0 THEN n || '(a: u8) -> u8' WHEN 1 THEN 'def ' || n || '(a, b) -> None' WHEN 2 THEN 'func ' || n || '(a int) int' ELSE n || '(a): void' END signature FROM p
UNION ALL SELECT f || ':' || v, v, f, CASE k % 4 WHEN 2 THEN 5 ELSE 4 + (k % 4 = 0)::INT END::BIGINT, CASE k % 4 WHEN 0 THEN 'struct' WHEN 2 THEN 'struct' ELSE 'class' END,
  CASE k % 4 WHEN 0 THEN 'struct S' WHEN 1 THEN 'class C(B)' WHEN 2 THEN 'type T struct' ELSE 'class K extends L' END FROM (SELECT *, CASE k % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'C' WHEN 2 THEN 'T' ELSE 'K' END v FROM p)"""


@register("parse_symbols", _PARSED)
def parse_symbols(spark, sf):
    """Symbols of a source file made of each part: name and line in four languages."""
    return symbols.symbols_of(_sources(spark, sf)).drop("summary")


def _sources(spark, sf):
    p = T.spread(T.read(spark, sf, "part").select("p_partkey"))
    name = F.concat(F.lit("f"), "p_partkey")
    body = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("use a::b;\n\npub fn "), name, F.lit("(a: u8) -> u8 {\n}\nstruct S;\n")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("import os\ndef "), name, F.lit("(a, b):\n    pass\nclass C(B):\n    pass\n")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("package p\n\nfunc "), name, F.lit("(a int) int {\n}\ntype T struct {\n}\n")))
        .otherwise(F.concat(F.lit("import x from 'y'\nexport function "), name, F.lit("(a): void {\n}\nclass K extends L {\n}\n")))
    )
    language = F.element_at(F.array(*map(F.lit, ("rust", "python", "go", "typescript"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select(F.concat(F.lit("p/"), "p_partkey").alias("path"), body.alias("content"), language.alias("language"))


@register("file_context_imports", f"WITH l AS (SELECT doc_id, list_transform({LINES}, lambda x: trim(x)) ls FROM documents) SELECT doc_id, len(ls)::BIGINT n_lines, len(list_filter(ls, lambda x: starts_with(x, 'use ') OR starts_with(x, 'import ') OR starts_with(x, 'from ') OR starts_with(x, 'require(') OR starts_with(x, '#include')))::BIGINT imports FROM l")
def file_context_imports(spark, sf):
    t = F.col("text")
    return T.read(spark, sf, "documents").select("doc_id", F.size(X.lines(t)).cast("long").alias("n_lines"), F.size(symbols.import_lines(t, 1 << 30)).cast("long").alias("imports"))


@register("extract_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) link FROM pages")
def extract_links(spark, sf):
    return T.read(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))


# ---- graph: commits are orders, files are parts, repositories suppliers; pages import pages

_LINKS = "(SELECT page_id src, unnest([page_id * 7 % 97, page_id * 3 % 89 + 5, page_id + 1000000]) dst FROM pages)"
_L = f"l AS (SELECT src, dst FROM {_LINKS} WHERE src <> dst)"


@register("graph_edges", "SELECT kind, count(*) edges FROM (SELECT 'Modifies' kind FROM lineitem UNION ALL SELECT 'ModifiedBy' FROM lineitem UNION ALL SELECT 'BelongsTo' FROM part UNION ALL SELECT 'Contains' FROM part UNION ALL SELECT 'DefinedIn' FROM part UNION ALL SELECT 'Defines' FROM part) GROUP BY kind")
def graph_edges(spark, sf):
    p = T.read(spark, sf, "part")
    e = graph.all_edges(
        T.modified(spark, sf),
        graph.file_edges(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("repo_id"))),
        graph.symbol_edges(p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("file_id"))),
    )
    return e.groupBy("kind").agg(F.count("*").alias("edges"))


@register("graph_commit_edges", "SELECT o_orderkey::VARCHAR src, l_partkey::VARCHAR dst, count(*) edges FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def graph_commit_edges(spark, sf):
    c = T.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("hash")).agg(F.collect_list("l_partkey").alias("files_modified"))
    return graph.commit_edges(c).where("kind = 'Modifies'").groupBy(F.col("src.id").alias("src"), F.col("dst.id").alias("dst")).agg(F.count("*").alias("edges"))


@register("graph_stats", "SELECT (SELECT count(*) FROM lineitem) * 2 edges, (SELECT count(*) FROM supplier) repos, (SELECT count(*) FROM part) files, (SELECT count(*) FROM orders) commits, (SELECT count(*) FROM part) symbols")
def graph_stats(spark, sf):
    return graph.stats(T.modified(spark, sf), repos=T.read(spark, sf, "supplier"), files=T.read(spark, sf, "part"), commits=T.read(spark, sf, "orders"), symbols=T.read(spark, sf, "part"))


@register("edges_from_to", "SELECT 'from' side, l_partkey::VARCHAR other, count(*) edges FROM lineitem WHERE l_orderkey = 7 GROUP BY ALL UNION ALL SELECT 'to', l_orderkey::VARCHAR, count(*) FROM lineitem WHERE l_partkey = 7 GROUP BY ALL")
def edges_from_to(spark, sf):
    e = T.modified(spark, sf).where("kind = 'Modifies'")
    a = graph.edges_from(e, "commit", 7).select(F.lit("from").alias("side"), F.col("dst.id").alias("other"))
    b = graph.edges_to(e, "file", 7).select(F.lit("to").alias("side"), F.col("src.id").alias("other"))
    return a.unionByName(b).groupBy("side", "other").agg(F.count("*").alias("edges"))


@register("most_connected", f"WITH {_L} SELECT src::VARCHAR AS file, count(DISTINCT dst) imports FROM l GROUP BY src ORDER BY imports DESC, file LIMIT 10")
def most_connected(spark, sf):
    return graph.most_connected(graph.import_edges(T.links(spark, sf)), 10)


@register("file_imports_external", f"WITH {_L} SELECT DISTINCT src::VARCHAR src, dst::VARCHAR target, coalesce(p.url, dst || ' (external)') AS name FROM l LEFT JOIN pages p ON p.page_id = l.dst")
def file_imports_external(spark, sf):
    pages = T.read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("path"))
    return graph.file_imports(graph.import_edges(T.links(spark, sf)), pages)


@register("direct_imports", f"WITH {_L} SELECT DISTINCT src::VARCHAR src, dst::VARCHAR id FROM l JOIN pages p ON p.page_id = l.dst")
def direct_imports(spark, sf):
    pages = T.read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"))
    return graph.imports_of(graph.import_edges(T.links(spark, sf)), pages).select("src", "id")


_REACH = f"WITH RECURSIVE {_L}, e AS (SELECT src a, dst b FROM l UNION SELECT dst, src FROM l), r AS (SELECT 3 AS id, 0 AS step UNION SELECT e.b, r.step + 1 FROM r JOIN e ON e.a = r.id WHERE r.step < 2), n AS (SELECT DISTINCT id FROM r WHERE id <> 3)"


@register("related_files_depth2", _REACH + " SELECT id::BIGINT id FROM n")
def related_files_depth2(spark, sf):
    return graph.reachable(T.links(spark, sf), spark.range(3, 4), 2)


@register("related_expansion", _REACH + " SELECT page_id chunk_id, page_id::BIGINT AS path, 0.5::DOUBLE score, (1 + row_number() OVER (ORDER BY page_id))::BIGINT AS rank FROM pages WHERE page_id IN (SELECT id FROM n) UNION ALL SELECT 3, 3, 0.9::DOUBLE, 1 ORDER BY rank LIMIT 15")
def related_expansion(spark, sf):
    return _expanded(spark, sf, T.links(spark, sf))


def _expanded(spark, sf, links):
    from sparkloom.operators.search import related

    chunks = T.read(spark, sf, "pages").select(F.col("page_id").alias("chunk_id"), F.col("page_id").alias("path"))
    hit = spark.createDataFrame([(3, 3, 0.9, 0.5, 0.9, 1)], "chunk_id long, path long, score double, bm25_score double, vector_score double, rank long")
    return related(hit, chunks, links, 2, 15).select("chunk_id", "path", "score", "rank")


@register("file_history", "WITH h AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey = 7), r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey::VARCHAR) AS rank, count(*) OVER () total FROM h) SELECT o_orderkey::VARCHAR hash, substr(o_orderkey::VARCHAR, 1, 7) short_hash, o_custkey::VARCHAR author, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS date, o_orderpriority message, total, rank FROM r WHERE rank <= 10")
def file_history(spark, sf):
    return graph.history(T.commits(spark, sf), T.modified(spark, sf), "7", 10)


@register("commit_files", "SELECT DISTINCT p_partkey::VARCHAR id, p_brand || '/' || p_name path FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_orderkey = 7")
def commit_files(spark, sf):
    return graph.commit_files(T.modified(spark, sf), T.parts(spark, sf), "7")


@register("find_file", "SELECT p_partkey::VARCHAR id, p_brand || '/' || p_name path FROM part WHERE ends_with(p_brand || '/' || p_name, '1') OR ends_with(p_partkey::VARCHAR, '1') ORDER BY path, id LIMIT 1")
def find_file(spark, sf):
    return graph.find_file(T.parts(spark, sf), "1")


def _log(spark, sf):
    """Log lines made of orders and their parts, in order of key."""
    o = T.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.lit(0).cast("long").alias("n"),
        F.concat_ws("|", F.sha1(F.col("o_orderkey").cast("string")), F.concat(F.lit("c"), "o_custkey"), F.unix_timestamp("o_orderdate").cast("string"), "o_orderpriority", F.lit("")).alias("line"),
    )
    li = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), F.concat(F.lit("f"), "l_partkey").alias("line"))
    return history.numbered(o.unionByName(li), F.floor(F.col("k") / 4096), "k", "n", "line")


def _parsed_log(lines):
    return history.parse_log(lines).select("hash", "author", "timestamp", "message", F.array_join("files_modified", ",").alias("files"))


@register("parse_log_group", "SELECT sha1(o_orderkey::VARCHAR) hash, 'c' || o_custkey author, epoch(o_orderdate)::BIGINT AS timestamp, o_orderpriority message, coalesce(f, '') files FROM orders LEFT JOIN (SELECT l_orderkey, string_agg('f' || l_partkey, ',' ORDER BY l_linenumber, 'f' || l_partkey) f FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def parse_log_group(spark, sf):
    """The log of all orders."""
    return _parsed_log(_log(spark, sf))


@register("blame_forward_fill", "SELECT l_linenumber::BIGINT line_number, sha1(l_orderkey::VARCHAR) commit_hash, 'c' || o_custkey author, l_quantity::BIGINT::VARCHAR content FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def blame_forward_fill(spark, sf):
    """The blame lines of all of lineitem: three for each of its rows, which are numbered before they are joined and cut."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    li = history.numbered(T.read(spark, sf, "lineitem").select(*order), F.floor(F.col("l_orderkey") / 4096), *order)
    li = li.join(T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    h = F.sha1(F.col("l_orderkey").cast("string"))
    three = F.array(F.concat_ws(" ", h, F.lit("1"), F.col("l_linenumber").cast("string")), F.concat(F.lit("author c"), "o_custkey"), F.concat(F.lit("\t"), F.col("l_quantity").cast("long").cast("string")))
    rows = li.select("line_no", F.posexplode(three).alias("p", "line")).withColumn("line_no", 3 * F.col("line_no") - 2 + F.col("p"))
    return history.parse_blame(rows.select("line_no", "line")).select("line_number", "commit_hash", "author", "content")


@register("diff_name_status", "SELECT CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D' ELSE 'R' END status, CASE WHEN p_size % 4 = 3 THEN 'new' || p_partkey ELSE 'f' || p_partkey END path, CASE WHEN p_size % 4 = 3 THEN 'f' || p_partkey END old_path FROM part")
def diff_name_status(spark, sf):
    s = F.element_at(F.array(*map(F.lit, ("A", "M", "D", "R100"))), (F.col("p_size") % 4 + 1).cast("int"))
    line = F.concat_ws("\t", s, F.concat(F.lit("f"), "p_partkey"), F.when(F.col("p_size") % 4 == 3, F.concat(F.lit("new"), "p_partkey")))
    return history.parse_name_status(T.read(spark, sf, "part").select(line.alias("line")))


# ---- change feed


@register("debounce_sessions", "WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS fresh FROM events), n AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) s FROM g) SELECT user_id, epoch_us(min(ts))::BIGINT start_us, count(*) events FROM n GROUP BY user_id, s")
def debounce_sessions(spark, sf):
    s = changes.sessions(T.read(spark, sf, "events"), "user_id", "ts", "30 minutes")
    return s.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "events")


@register("session_numbers", "WITH g AS (SELECT user_id, event_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS fresh FROM events) SELECT user_id, max(s)::BIGINT sessions FROM (SELECT user_id, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) s FROM g) GROUP BY user_id")
def session_numbers(spark, sf):
    n = changes.gap_number(T.read(spark, sf, "events"), "user_id", "ts", 1800)
    return n.groupBy("user_id").agg(F.max("session").cast("long").alias("sessions"))


_GAPS = "g AS (SELECT user_id, event_id, ts, coalesce(epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) >= 3600000, true) AS fresh FROM events), n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) s FROM g)"
_FLUSH = "SELECT user_id::VARCHAR AS key, epoch_us(ts) // 1000 ms, event_id FROM events"


@register("debounce_flush", "WITH e AS (" + _FLUSH + """), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, event_id::VARCHAR) - 1 i FROM e),
g AS (SELECT key, i // 3 g, count(*) paths, min(ms) a, max(ms) b FROM r GROUP BY key, i // 3)
SELECT key, CASE WHEN paths = 3 THEN b ELSE least(b + 400000000000, a + 500000000000) END::BIGINT flushed_ms, paths, CASE WHEN paths = 3 THEN 'paths' ELSE CASE WHEN b + 400000000000 <= a + 500000000000 THEN 'quiet' ELSE 'longest' END END reason FROM g""")
def debounce_flush(spark, sf):
    """Flushes of each user's events by the number of different paths, an event being a path; the rest waits for the quiet time."""
    e = T.read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").cast("string").alias("path"), "ts")
    return _flushed(changes.flushes(e, changes.Debounce(400_000_000_000, 500_000_000_000, 3)))


@register("debounce_quiet", "WITH " + _GAPS + " SELECT user_id::VARCHAR AS key, (epoch_us(max(ts)) // 1000 + 3600000)::BIGINT flushed_ms, count(DISTINCT event_id % 4) paths, 'quiet' reason FROM n GROUP BY user_id, s")
def debounce_quiet(spark, sf):
    """Flushes of each user's events after an hour without one; four different paths."""
    e = T.read(spark, sf, "events").select(F.col("user_id").alias("key"), (F.col("event_id") % 4).cast("string").alias("path"), "ts")
    return _flushed(changes.flushes(e, changes.Debounce(3_600_000, 500_000_000_000, 100)))


_CHAIN = """WITH RECURSIVE e AS (SELECT user_id k, epoch_us(ts) // 1000 ms FROM events), f AS (SELECT k, min(ms) a FROM e GROUP BY k UNION ALL
SELECT k, n FROM (SELECT f.k, f.a, (SELECT min(e.ms) FROM e WHERE e.k = f.k AND e.ms >= f.a + 604800000) n FROM f) WHERE n IS NOT NULL)
SELECT k::VARCHAR AS key, (a + 604800000)::BIGINT flushed_ms, 1::BIGINT paths, 'longest' reason FROM f"""


@register("debounce_longest", _CHAIN)
def debounce_longest(spark, sf):
    """Flushes of each user's events a week after the first since the last flush, however many follow; one path."""
    e = T.read(spark, sf, "events").select(F.col("user_id").alias("key"), F.lit("p").alias("path"), "ts")
    return _flushed(changes.flushes(e, changes.Debounce(500_000_000_000, 604_800_000, 100)))


def _flushed(rows):
    return rows.select("key", F.unix_millis("flushed_at").alias("flushed_ms"), "paths", "reason")


@register("hidden_paths", f"SELECT count(*) events FROM documents WHERE NOT contains(CASE WHEN doc_id % 3 = 0 THEN '/r/.x/' ELSE '/r/' END || {PATH}, '/.')")
def hidden_paths(spark, sf):
    p = F.concat(F.when(F.col("doc_id") % 3 == 0, "/r/.x/").otherwise("/r/"), T.path())
    return changes.visible(T.read(spark, sf, "documents").select(p.alias("path"))).agg(F.count("*").alias("events"))


# ---- views and text functions


@register("file_view", """WITH """ + _L + """, near AS (SELECT DISTINCT p.page_id FROM l a JOIN l b ON b.src = 3 OR b.dst = 3 JOIN pages p ON p.page_id IN (a.src, a.dst) WHERE p.page_id <> 3
  AND ((a.src = 3 OR a.dst = 3) OR (CASE WHEN b.src = 3 THEN b.dst ELSE b.src END IN (a.src, a.dst))))
SELECT 'symbol' section, 's' || page_id AS name FROM pages WHERE page_id = 3
UNION ALL SELECT 'import', coalesce(p.url, l.dst || ' (external)') FROM (SELECT DISTINCT dst FROM l WHERE src = 3) l LEFT JOIN pages p ON p.page_id = l.dst
UNION ALL SELECT 'importer', p.url FROM (SELECT DISTINCT src FROM l WHERE dst = 3) l JOIN pages p ON p.page_id = l.src
UNION ALL SELECT 'related', name FROM (SELECT p.url AS name FROM near JOIN pages p USING (page_id) ORDER BY p.url LIMIT 20)""")
def file_view(spark, sf):
    pages = T.read(spark, sf, "pages")
    files = pages.select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("path"))
    own = graph.symbol_edges(pages.select(F.concat(F.lit("s"), "page_id").alias("name"), F.col("page_id").alias("file_id")))
    return graph.file_view(graph.all_edges(graph.import_edges(T.links(spark, sf)), own), files, "3", 2)


@register("direct_importers", f"WITH {_L} SELECT DISTINCT dst::VARCHAR dst, src::VARCHAR id FROM l JOIN pages p ON p.page_id = l.src")
def direct_importers(spark, sf):
    pages = T.read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"))
    return graph.importers_of(graph.import_edges(T.links(spark, sf)), pages).select("dst", "id")


@register("text_functions", f"WITH l AS (SELECT doc_id, text, {LINES} ls FROM documents) SELECT doc_id, substr(text, strpos(text, ':') + 1) after_colon, (len(text) - len(replace(text, chr(10), '')))::BIGINT newlines, len(regexp_extract(text, '^[ \\t\\n\\r]*', 0))::BIGINT indent, array_to_string(ls[1:6], chr(10)) || CASE WHEN len(ls) > 6 THEN chr(10) || '...' ELSE '' END preview FROM l")
def text_functions(spark, sf):
    t = F.col("text")
    return T.read(spark, sf, "documents").select("doc_id", X.after_colon(t).alias("after_colon"), X.occurrences(t, "\n").alias("newlines"), X.indentation(t).alias("indent"), X.preview(t).alias("preview"))


@register("file_context", "WITH s AS (SELECT p_brand AS path, '[function] fn ' || p_name || ' (line ' || p_size || ')' s, p_size, p_brand || ':' || p_partkey id FROM part) SELECT b AS path, 2::BIGINT AS lines, 'unknown' AS extension, 1::BIGINT imports, (SELECT count(*) FROM s WHERE path = b) n_symbols, (SELECT string_agg(s, '; ' ORDER BY p_size, id) FROM (SELECT * FROM s WHERE path = b ORDER BY p_size, id LIMIT 20)) symbols FROM (SELECT DISTINCT p_brand b FROM part)")
def file_context(spark, sf):
    files = T.read(spark, sf, "part").select(F.col("p_brand").alias("path")).distinct().withColumn("content", F.lit("use a;\nfn b() {}\n"))
    own = _symbols(spark, sf).withColumn("kind", F.lit("function"))
    return symbols.file_context(files, own).withColumns({"imports": F.size("imports").cast("long"), "symbols": F.array_join("symbols", "; ")})


@register("code_map_summaries", "SELECT 'p/' || p_partkey path, CASE p_partkey % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'go' ELSE 'typescript' END AS language, 2::BIGINT symbols, CASE p_partkey % 4 WHEN 0 THEN 'a::b' WHEN 1 THEN 'os' WHEN 2 THEN '' ELSE 'y' END imports, CASE p_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 6 ELSE 5 END::BIGINT AS lines FROM part")
def code_map_summaries(spark, sf):
    return symbols.code_map(_sources(spark, sf))["summaries"].select("path", "language", F.size("symbols").cast("long").alias("symbols"), F.array_join("imports", ",").alias("imports"), "lines")


@register("repo_commits", "SELECT sha1(o_orderkey::VARCHAR) hash, substr(sha256('r'), 1, 16) repo_id, coalesce(f, '') files FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(substr(sha256('r'), 1, 16) || ':f' || l_partkey, ',' ORDER BY l_linenumber, 'f' || l_partkey) f FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def repo_commits(spark, sf):
    return history.in_repo(history.parse_log(_log(spark, sf)), "r").select("hash", "repo_id", F.array_join("files_modified", ",").alias("files"))


# what the files made of parts import, and the file it is: {k} is the part's key, {b} the next of its kind, {c} the next in its folder, {s} and {t} folders
_IMPORTED = {
    0: [(".m{c}", "w{s}/app/m{c}.py", 28), ("app.m{b}.f", "w{t}/app/m{b}.py", 4), ("os", None, 0)],
    1: [("../t{t}/m{b}.js", "r/t{t}/m{b}.ts", 4), ("./m{c}", "r/t{s}/m{c}.ts", 28), ("react", None, 0)],
    2: [("example.com/g/p{b}", "g/p{b}/a.go", 4), ("net/http", None, 0)],
    3: [("crate::m{c}::f", "c{s}/src/m{c}.rs", 28), ("std::fmt::Debug", None, 0)],
}
_FORMS = {"{k}": "p_partkey", "{b}": "p_partkey + 4", "{c}": "p_partkey + 28", "{s}": "p_partkey % 7", "{t}": "(p_partkey + 4) % 7"}
_PLACES = {0: "w{s}/app/m{k}.py", 1: "r/t{s}/m{k}.ts", 2: "g/p{k}/a.go", 3: "c{s}/src/m{k}.rs"}
_BODIES = {
    0: "from . import m{c}\nfrom app.m{b} import f\nimport os\n",
    1: "import {{ a }} from '../t{t}/m{b}.js'\nexport * from './m{c}'\nimport React from 'react'\n",
    2: 'package p\n\nimport (\n\tx "example.com/g/p{b}"\n\t"net/http"\n)\n',
    3: "use crate::m{c}::f;\nuse std::fmt::{{Debug}};\n",
}


def _filled(form: str) -> str:
    """A form as an SQL expression over part, for Spark and for DuckDB."""
    out = "'" + form.replace("'", "''") + "'"
    for name, value in _FORMS.items():
        out = f"replace({out}, '{name}', CAST({value} AS VARCHAR(20)))"
    return out


_TARGETS = " UNION ALL ".join(
    f"SELECT {_filled(_PLACES[k])} path, {_filled(spec)} spec, " + ("NULL" if target is None else f"CASE WHEN p_partkey + {back} <= (SELECT max(p_partkey) FROM part) THEN {_filled(target)} END") + f" target FROM part WHERE p_partkey % 4 = {k}"
    for k, rows in _IMPORTED.items()
    for spec, target, back in rows
)


@register("import_targets", _TARGETS)
def import_targets(spark, sf):
    """The imports of a source file made of each part, resolved to files: relative, by package, by the end of a path, by
    module and by crate; null where they are external."""
    which = F.expr("p_partkey % 4")
    of = lambda forms: F.coalesce(*(F.when(which == k, F.expr(_filled(f.replace("{{", "{").replace("}}", "}").replace("\n", "\\n").replace("\t", "\\t")))) for k, f in forms.items()))
    language = F.element_at(F.array(*map(F.lit, ("python", "typescript", "go", "rust"))), (which + 1).cast("int"))
    files = T.spread(T.read(spark, sf, "part").select("p_partkey")).select(of(_PLACES).alias("path"), of(_BODIES).alias("content"), language.alias("language"))
    return imports.resolved(imports.imports_of(files), files)
