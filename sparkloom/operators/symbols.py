"""Symbols of source files, their search and overviews."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ranking import ranked

SYMBOL_SCHEMA = "id string, name string, file string, line long, kind string, signature string, summary string"

# For each language the kind, the pattern and the form of the signature; m is the match.
_SYMBOLS = {
    "rust": [
        ("function", r"(?m)^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)(?:\s*->\s*([^\{]+))?\s*\{", "{0}({1}) -> {2}", "()"),
        ("struct", r"(?m)^\s*(?:pub\s+)?struct\s+(\w+)(?:<[^>]*>)?", "struct {0}", ""),
        ("enum", r"(?m)^\s*(?:pub\s+)?enum\s+(\w+)(?:<[^>]*>)?", "enum {0}", ""),
        ("trait", r"(?m)^\s*(?:pub\s+)?trait\s+(\w+)(?:<[^>]*>)?", "trait {0}", ""),
    ],
    "typescript": [
        ("function", r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)(?:\s*:\s*([^\{]+))?\s*\{", "{0}({1}): {2}", "void"),
        ("function", r"(?m)^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*(?::\s*[^=]+)?\s*=\s*(?:async\s+)?\([^)]*\)\s*(?::\s*[^=]+)?\s*=>", "{0} = () => ...", ""),
        ("class", r"(?m)^\s*(?:export\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([^{]+))?\s*\{", "class {0}| extends {1}", ""),
        ("interface", r"(?m)^\s*(?:export\s+)?interface\s+(\w+)(?:<[^>]*>)?(?:\s+extends\s+([^{]+))?\s*\{", "interface {0}", ""),
        ("type", r"(?m)^\s*(?:export\s+)?type\s+(\w+)(?:<[^>]*>)?\s*=", "type {0}", ""),
    ],
    "python": [
        ("function", r"(?m)^(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)(?:\s*->\s*([^:]+))?:", "def {0}({1}) -> {2}", "None"),
        ("class", r"(?m)^class\s+(\w+)(?:\(([^)]*)\))?:", "class {0}|({1})", ""),
    ],
    "go": [
        ("function", r"(?m)^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(([^)]*)\)(?:\s*\(([^)]+)\)|\s*(\w+))?\s*\{", "func {0}({1}) {2}", ""),
        ("struct", r"(?m)^type\s+(\w+)\s+struct\s*\{", "type {0} struct", ""),
        ("interface", r"(?m)^type\s+(\w+)\s+interface\s*\{", "type {0} interface", ""),
    ],
}
_IMPORTS = {
    "rust": r"(?m)^\s*use\s+([^;]+);",
    "typescript": r"""(?m)^\s*import\s+(?:\{[^}]+\}|[^;]+)\s+from\s+['"]([^'"]+)['"]""",
    "python": r"(?m)^(?:from\s+(\S+)\s+)?import\s+(.+)$",
}
_SAME = {"javascript": "typescript"}


def shortened(params: str) -> str:
    p = params.strip()
    n = p.count(",") + 1
    return f"{n}..." if len(p.encode()) > 50 and n > 3 else p


def parse(path: str, content: str, language: str) -> tuple[list[tuple], list[str]]:
    """(id, name, file, line, kind, signature, summary) of each symbol, and the imports."""
    language = _SAME.get(language, language)
    symbols = []
    for kind, pattern, form, default in _SYMBOLS.get(language, []):
        for m in re.finditer(pattern, content):
            name = m[1]
            groups = [g for g in m.groups()[2:] if g is not None]
            result = groups[0].strip() if groups else default
            optional = form.partition("|")
            form_now = optional[0] + (optional[2] if optional[1] and m[2] is not None else "")
            second = m[2] if m.re.groups > 1 and m[2] is not None else ""
            text = form_now.format(name, shortened(second) if kind == "function" else second, result)
            line = content.count("\n", 0, m.start()) + 1
            symbols.append((f"{path}:{name}", name, path, line, kind, text.rstrip() if language == "go" else text, ""))
    pattern = _IMPORTS.get(language)
    imports = [next(g for g in m.groups() if g is not None) for m in re.finditer(pattern, content)] if pattern else []
    return symbols, imports


def symbols_of(files: DataFrame) -> DataFrame:
    """files (path, content, language) as symbols; of equal ids the last in the file stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "name", "file", "line", "kind", "signature", "summary"]
        for batch in batches:
            rows = []
            for path, content, language in zip(batch["path"], batch["content"], batch["language"]):
                rows += {s[0]: s for s in parse(path, content or "", language)[0]}.values()
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content", "language").mapInPandas(run, SYMBOL_SCHEMA)


def file_summaries(files: DataFrame) -> DataFrame:
    """path, language, symbols, imports, exports, summary, lines of the files that have symbols."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, language in zip(batch["path"], batch["content"], batch["language"]):
                symbols, imports = parse(path, content or "", language)
                if symbols:
                    n = len((content or "").split("\n")) - (content or "").endswith("\n")
                    rows.append((path, language, list(dict.fromkeys(s[0] for s in symbols)), imports, [], "", n))
            yield pd.DataFrame(rows, columns=["path", "language", "symbols", "imports", "exports", "summary", "lines"])

    schema = "path string, language string, symbols array<string>, imports array<string>, exports array<string>, summary string, lines long"
    return files.select("path", "content", "language").mapInPandas(run, schema)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows of equal key the last by order."""
    kept = F.max_by(F.struct(*rows.columns), order).alias("row")
    return rows.groupBy(F.col(key).alias("_key")).agg(kept).select("row.*")


def search(symbols: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Symbols with the query in name, signature or summary, whatever its case; exact names first, then by id.

    With a limit the best are picked before they are ranked; without, ranks are counted by ranges of that order.
    """
    q = query.lower()
    found = [F.contains(F.lower(c), F.lit(q)) for c in ("name", "signature", "summary")]
    rows = symbols.where(found[0] | found[1] | found[2]).withColumn("exact", F.lower("name") == q)
    order = [F.desc("exact"), F.asc("id")]
    if limit is not None:
        return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return ranked(rows, *order)


def expand(symbols: DataFrame, edges: DataFrame, symbol_id: str) -> DataFrame:
    """direction ('depends_on' or 'depended_by') and the symbols at the other end of a symbol's edges (src, dst)."""
    out = edges.where(F.col("src") == symbol_id).select(F.lit("depends_on").alias("direction"), F.col("dst").alias("id"))
    back = edges.where(F.col("dst") == symbol_id).select(F.lit("depended_by").alias("direction"), F.col("src").alias("id"))
    return out.unionByName(back).join(symbols, "id")


def stats(symbols: DataFrame) -> DataFrame:
    """One row: symbols, functions, structs, other."""
    function, struct = F.col("kind").isin("function", "method"), F.col("kind").isin("struct", "class")
    return symbols.agg(
        F.count("*").alias("symbols"),
        F.count_if(function).alias("functions"),
        F.count_if(struct).alias("structs"),
        F.count_if(~(function | struct)).alias("other"),
    )


def _ordered(value: Column, order: str) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


def minimal_overview(symbols: DataFrame) -> DataFrame:
    """file, overview: the file's short name and its functions' names."""
    function = F.when(F.col("kind").isin("function", "method"), F.col("name"))
    return symbols.groupBy("file").agg(F.concat(F.substring_index(F.first("file"), "/", -1), F.lit(": "), F.array_join(F.filter(_ordered(function, "id"), lambda x: x.isNotNull()), ", ")).alias("overview"))


def compact_overview(symbols: DataFrame) -> DataFrame:
    """file, overview: a heading and a line of kind and signature for each symbol."""
    note = F.when(F.col("summary") == "", "").otherwise(F.concat(F.lit("// "), "summary"))
    line = F.concat(F.lit("  "), "kind", F.lit(" "), "signature", F.lit(" "), note)
    return symbols.groupBy("file").agg(F.concat(F.lit("## "), F.first("file"), F.lit("\n"), F.array_join(_ordered(line, "id"), "\n"), F.lit("\n")).alias("overview"))


def snippet(content: Column, line: Column, around: int = 30) -> Column:
    """The lines from `line` on, numbered in a column of four; where the file goes on, a row of dots."""
    from sparkloom.functions.text import lines

    every = lines(content)
    part = F.transform(F.slice(every, line.cast("int"), around), lambda x, i: F.concat(F.lpad((line + i).cast("string"), 4, " "), F.lit(" | "), x))
    more = F.when(F.size(every) >= line + around, F.array(F.lit("     | ..."))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(part, more), "\n")


def import_lines(content: Column, first: int = 20) -> Column:
    """The first lines that look like imports."""
    from sparkloom.functions.text import lines, trimmed

    looks = lambda x: x.startswith("use ") | x.startswith("import ") | x.startswith("from ") | x.startswith("require(") | x.startswith("#include")
    return F.slice(F.filter(F.transform(lines(content), trimmed), looks), 1, first)


def file_context(files: DataFrame, symbols: DataFrame, first: int = 20) -> DataFrame:
    """files (path, content) with lines, extension, imports (the first), n_symbols and symbols (the first, by line)."""
    from sparkloom.functions.text import extension, lines

    shown = F.concat(F.lit("["), "kind", F.lit("] "), "signature", F.lit(" (line "), F.col("line").cast("string"), F.lit(")"))
    own = symbols.groupBy(F.col("file").alias("path")).agg(F.sort_array(F.collect_list(F.struct("line", "id", shown.alias("s")))).alias("s"))
    return files.join(own, "path", "left").select(
        "path",
        F.size(lines(F.col("content"))).cast("long").alias("lines"),
        F.coalesce(extension(F.col("path")), F.lit("unknown")).alias("extension"),
        import_lines(F.col("content"), first).alias("imports"),
        F.when(F.col("s").isNull(), 0).otherwise(F.size("s")).cast("long").alias("n_symbols"),
        F.coalesce(F.transform(F.slice("s", 1, first), lambda x: x["s"]), F.array().cast("array<string>")).alias("symbols"),
    )


def code_map(files: DataFrame) -> dict[str, DataFrame]:
    """The tables of a code map, to be saved in a store: symbols, and summaries of the files that have any."""
    return {"symbols": symbols_of(files), "summaries": file_summaries(files)}
