"""Imports of source files, resolved to the files they name.

An import is looked up by exact keys only. Each file has one module key (its path without what its language leaves out of
an import; for Go its folder), and each import a list of keys in order of preference: those its language's rule gives
(relative to its file, or below each folder above it, the nearest first), and then, for keys of two parts or more, the
end of a module key anywhere, of which the shallowest file stands for all. So rows grow with imports and with the depth of
paths, and no two files meet because they are called alike.

Of files with one key (a.py and a/__init__.py; all files of a Go package) the one of shortest path stands for the key, then
the first by path. An import that nothing fits is external: its target is null. Null contents and languages without a rule
have no imports. Limits: Rust's nested braces are cut at the inner brace, and aliases of build files are not read but
for '@/' and '~/', which stand for a folder above.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import file_id, repo_id
from sparkloom.operators import graph
from sparkloom.operators.symbols import symbols_of

FAMILIES = {"python": "python", "typescript": "js", "javascript": "js", "rust": "rust", "go": "go", "java": "java", "c": "c", "cpp": "c"}
SCHEMA = "path string, family string, spec string, keys array<string>, ends array<string>"

#: What a language leaves out of an import: the end of a path that its module key lacks.
_LEFT_OUT = {
    "python": r"((^|/)__init__)?\.pyi?$",
    "js": r"((^|/)index)?(\.d)?\.[cm]?[jt]sx?$",
    "rust": r"((^|/)mod)?\.rs$",
    "java": r"\.java$",
    "go": r"(^|/)[^/]*$",
    "c": r"^$",
}
_PY_FROM = re.compile(r"^[ \t]*from[ \t]+(\.*)([\w.]*)[ \t]+import[ \t]+(\([^)]*\)|[^\n#;]+)", re.M)
_PY_IMPORT = re.compile(r"^[ \t]*import[ \t]+([^\n#;]+)", re.M)
_JS = re.compile(r"""(?:^[ \t]*(?:import|export)\b[^;'"]*?(?:\bfrom\b)?[ \t]*|\brequire[ \t]*\([ \t]*)['"]([^'"\n]+)['"]""", re.M)
_RUST_USE = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use[ \t]+([^;]+);", re.M)
_RUST_MOD = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?mod[ \t]+(\w+)[ \t]*;", re.M)
_GO = re.compile(r'^[ \t]*import[ \t]+(?:\(([^)]*)\)|(?:[\w.]+[ \t]+)?"([^"\n]+)")', re.M)
_JAVA = re.compile(r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;", re.M)
_C = re.compile(r'^[ \t]*#[ \t]*include[ \t]*["<]([^">\n]+)[">]', re.M)

Found = Iterator[tuple[str, list[str], list[str]]]  # what is imported, its keys, and the ends of keys that do as well


def _below(folder: str, key: str) -> str:
    return posixpath.normpath(posixpath.join(folder, key)) if folder else posixpath.normpath(key)


def _above(folder: str) -> list[str]:
    """The folder and those above it, the nearest first; the last is the root."""
    out = [folder] if folder else []
    while posixpath.dirname(folder) != folder:
        folder = posixpath.dirname(folder)
        out.append(folder)
    return out or [""]


def _anywhere(folder: str, *keys: str) -> tuple[list[str], list[str]]:
    return [_below(f, k) for k in keys for f in _above(folder)], [k for k in keys if "/" in k]


def _python(folder: str, content: str) -> Found:
    for m in _PY_FROM.finditer(content):
        dots, module, names = m[1], m[2].replace(".", "/"), m[3].strip("() \t")
        for name in (n.split()[0] for n in re.sub(r"#[^\n]*", "", names).split(",") if n.strip()):
            spec = f"{m[1]}{m[2]}" + ("" if not m[2] else ".") + name
            inner = module if name == "*" else posixpath.join(module, name)
            if dots:
                base = _below(folder, "../" * (len(dots) - 1) or ".")
                yield spec, list(dict.fromkeys(_below(base, k) for k in (inner, module or "."))), []
            else:
                yield spec, *_anywhere(folder, *dict.fromkeys((inner, module)))
    for m in _PY_IMPORT.finditer(content):
        for name in (n.split()[0] for n in m[1].split(",") if n.strip()):
            yield name, *_anywhere(folder, name.replace(".", "/"))


def _js(folder: str, content: str) -> Found:
    for m in _JS.finditer(content):
        key = re.sub(_LEFT_OUT["js"], "", m[1]) or "."
        if m[1].startswith("."):
            yield m[1], [_below(folder, key)], []
        else:
            yield m[1], *_anywhere(folder, re.sub("^[@~]/", "", key))


def _used(tree: str) -> list[str]:
    """The paths of a use declaration: one for each name in its braces."""
    head, brace, rest = tree.partition("{")
    names = re.sub(r"\w+::\{[^}]*\}", lambda m: m[0].split("{")[0].rstrip(":"), rest.rpartition("}")[0]).split(",") if brace else [""]
    return [re.sub(r"\s+as\s+\w+|\s", "", head + n).removesuffix("::self").removesuffix("::*").strip(":") for n in names if n.strip() or not brace]


def _rust(path: str, content: str) -> Found:
    folder, name = posixpath.split(path)
    own = folder if name in ("mod.rs", "lib.rs", "main.rs") else posixpath.join(folder, name.removesuffix(".rs"))
    source = [f for f in _above(folder) if posixpath.basename(f) == "src"][:1]
    for m in _RUST_MOD.finditer(content):
        yield f"mod {m[1]}", [_below(own, m[1])], []
    for m in _RUST_USE.finditer(content):
        for spec in _used(m[1]):
            parts = spec.split("::")
            bases = source or _above(folder) if parts[0] == "crate" else [own]
            while parts and parts[0] in ("crate", "self", "super"):
                if parts.pop(0) == "super":
                    bases = [posixpath.dirname(b) for b in bases]
            keys = ["/".join(parts[:n]) for n in range(len(parts), 0, -1)]
            yield spec, [_below(b, k) for k in keys for b in bases], []


def _go(folder: str, content: str) -> Found:
    for m in _GO.finditer(content):
        for spec in [m[2]] if m[2] else re.findall(r'^[^\n"]*"([^"\n]+)"', m[1] or "", re.M):
            host, _, rest = spec.partition("/")
            parts = rest.split("/") if "." in host and rest else []
            yield spec, *_anywhere(folder, spec, *("/".join(parts[i:]) for i in range(len(parts))))


def _java(folder: str, content: str) -> Found:
    for m in _JAVA.finditer(content):
        key = m[1].replace(".", "/")
        yield m[1], *_anywhere(folder, *(k for k in (key, posixpath.dirname(key)) if k))


def _c(folder: str, content: str) -> Found:
    for m in _C.finditer(content):
        yield m[1], *_anywhere(folder, m[1])


_RULES = {"python": _python, "js": _js, "go": _go, "java": _java, "c": _c}


def specs(path: str, content: str, family: str) -> dict[str, tuple[list[str], list[str]]]:
    """What a file imports, each once, with its keys in order of preference and the ends that do as well."""
    found = _rust(path, content) if family == "rust" else _RULES[family](posixpath.dirname(path), content)
    return {spec: (keys, ends) for spec, keys, ends in found}


def _family(language: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair]), F.coalesce(language, F.lit("")))


def imports_of(files: DataFrame) -> DataFrame:
    """files (path, content, language) as path, family, spec, keys, ends: a row for each file and import."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, family in zip(batch["path"], batch["content"], batch["family"]):
                rows += [(path, family, spec, *lists) for spec, lists in specs(path, content, family).items()]
            yield pd.DataFrame(rows, columns=["path", "family", "spec", "keys", "ends"])

    known = files.select("path", "content", _family(F.col("language")).alias("family"))
    return known.where("path is not null and content is not null and family is not null").mapInPandas(run, SCHEMA)


def module_keys(files: DataFrame) -> DataFrame:
    """files (path, language) as path, family, key, whole: the key of each file and, not whole, its ends of two parts or more."""
    rows = files.select("path", _family(F.col("language")).alias("family")).where("path is not null and family is not null")
    key = F.lit(None).cast("string")
    for family, pattern in _LEFT_OUT.items():
        key = F.when(F.col("family") == family, F.regexp_replace(F.regexp_replace("path", "/+", "/"), pattern, "")).otherwise(key)
    parts = F.split("_key", "/")
    ends = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("key"), F.lit(False).alias("whole"))))
    whole = F.array(F.struct(F.when(F.col("_key") == "", ".").otherwise(F.col("_key")).alias("key"), F.lit(True).alias("whole")))
    rows = rows.withColumn("_key", key)
    return rows.select("path", "family", F.explode(F.concat(whole, F.coalesce(ends, F.filter(whole, lambda x: ~x["whole"])))).alias("_k")).select("path", "family", "_k.*")


def _wanted(imports: DataFrame) -> DataFrame:
    """A row for each key of an import: path, family, spec, place, key, whole."""
    take = lambda name, whole: F.transform(name, lambda k: F.struct(k.alias("key"), F.lit(whole).alias("whole")))
    return imports.select("path", "family", "spec", F.posexplode(F.concat(take("keys", True), take("ends", False))).alias("place", "_k")).select("path", "family", "spec", "place", "_k.*")


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports_of()'s rows as path, spec, target: of the files (path, language) that a key fits the first by preference.

    The join is a merge join at every size: paths pack so well in a file that Spark's estimate has it broadcast an index
    many times its limit, which each executor then holds. A key that many files import is skewed on the side of the imports alone; adaptive joins split that.
    """
    parts = F.size(F.split("path", "/"))
    index = module_keys(files).groupBy("family", "key", "whole").agg(F.min(F.struct(parts.alias("n"), F.length("path").alias("l"), "path"))["path"].alias("target"))
    found = F.when(F.col("target").isNotNull(), F.struct("place", "target"))
    rows = _wanted(imports).join(index.hint("merge"), ["family", "key", "whole"], "left")
    return rows.groupBy("path", "spec").agg(F.min(found)["target"].alias("target"))


def affected(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The paths whose imports may be resolved otherwise once files (path, language) come or go: those that ask for a key
    of theirs."""
    keys = module_keys(files).select("family", "key", "whole").distinct()
    return _wanted(imports).join(keys, ["family", "key", "whole"], "left_semi").select("path").distinct()


def edges_of(files: DataFrame, links: DataFrame, repo: str = "") -> DataFrame:
    """The graph of files (path, content, language) and their links (path, spec, target), with the owner of each edge: to
    the repository, to symbols, and to imported files. What is external has an id of its own."""
    repo_key = repo_id(F.lit(repo))
    key = lambda c: file_id(repo_key, F.col(c))
    target = F.coalesce(key("target"), F.concat(F.lit("external:"), "spec"))
    rows = files.where("path is not null")
    parts = [
        (rows.select("path"), graph.node("file", key("path")), graph.node("repo", repo_key), "BelongsTo"),
        (symbols_of(rows.where("language is not null")).select(F.col("file").alias("path"), "name"), graph.node("symbol", F.col("name")), graph.node("file", key("path")), "DefinedIn"),
        (links, graph.node("file", key("path")), graph.node("file", target), "Imports"),
    ]
    return graph.all_edges(*(graph.both_ways(r, src, dst, kind, "path") for r, src, dst, kind in parts))
