"""Scanning source trees into a table of files."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import BARE_NAMES, EXTENSIONS, FILE_LANGUAGES, extension, file_name, language

MOST_BYTES = 1_000_000


def wanted(path: Column, extensions: list[str] | None = None) -> Column:
    """Whether a path has an indexed extension, or is one of the names without one."""
    ext = extension(path)
    return F.coalesce(ext.isin(extensions or EXTENSIONS), F.lit(False)) | (ext.isNull() & F.lower(file_name(path)).isin(BARE_NAMES))


def readable(content: Column, most: int = MOST_BYTES) -> Column:
    """Whether bytes are text to index: not over `most`, no NUL, valid UTF-8."""
    return (F.octet_length(content) <= most) & F.is_valid_utf8(content.cast("string")) & (F.instr(content.cast("string"), F.lit("\0")) == 0)


def as_files(rows: DataFrame, extensions: list[str] | None = None, most: int = MOST_BYTES) -> DataFrame:
    """rows (path, content as bytes) as files (path, content, language); what is not to be indexed goes silently."""
    kept = rows.where(wanted(F.col("path"), extensions)).where(readable(F.col("content"), most))
    return kept.select("path", F.col("content").cast("string").alias("content"), language(F.col("path"), FILE_LANGUAGES).alias("language"))


def ignore_pattern(pattern: str) -> re.Pattern:
    """A pattern of ignore rules as a regular expression over a path: * and ? stay inside a name, ** spans folders."""
    out, i = [], 0
    while i < len(pattern):
        rest = pattern[i:]
        if rest.startswith("**/") and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif rest == "**" and (i == 0 or pattern[i - 1] == "/"):
            out.append(".*")
            i += 2
        elif rest[0] == "*":
            out.append("[^/]*")
            i += 1
        elif rest[0] == "?":
            out.append("[^/]")
            i += 1
        elif rest[0] == "[" and (m := re.match(r"\[(!|\^)?(\]?[^\]]*)\]", rest)):
            out.append(f"(?!/)[{'^' if m[1] else ''}{m[2].replace(chr(92), chr(92) * 2).replace('[', chr(92) + '[')}]")
            i += m.end()
        else:
            step = 1 if rest[0] == "\\" and len(rest) > 1 else 0
            out.append(re.escape(rest[step]))
            i += 1 + step
    return re.compile("".join(out) + r"\Z", re.DOTALL)


class Ignore:
    """Version-control ignore rules of a tree: the last pattern that matches decides, ! takes back, / anchors, a last /
    means folders only, a backslash takes the next character as it is."""

    def __init__(self, root: str):
        self.rules: list[tuple[str, re.Pattern, bool, bool, bool]] = []
        for folder, names, files in os.walk(root):
            names[:] = [n for n in names if n != ".git"]
            if ".gitignore" in files:
                base = os.path.relpath(folder, root).replace("\\", "/")
                for line in Path(folder, ".gitignore").read_text(errors="replace").splitlines():
                    line = re.sub(r"(?<!\\)[ \t]+$", "", line)
                    if line and not line.startswith("#"):
                        back, line = line.startswith("!"), line.removeprefix("!")
                        only_dirs, line = line.endswith("/"), line.rstrip("/")
                        anchored, line = "/" in line, line.removeprefix("/")
                        self.rules.append(("" if base == "." else base + "/", ignore_pattern(line), anchored, only_dirs, back))

    def __call__(self, path: str, is_dir: bool) -> bool:
        out = False
        for base, pattern, anchored, only_dirs, back in self.rules:
            if path.startswith(base) and (is_dir or not only_dirs):
                rest = path[len(base) :]
                if pattern.match(rest if anchored else rest.rpartition("/")[2]):
                    out = not back
        return out


def tree_paths(root: str) -> list[str]:
    """Paths of a local tree that its ignore rules leave, hidden ones included."""
    ignored, out = Ignore(root), []
    for folder, names, files in os.walk(root):
        base = os.path.relpath(folder, root).replace("\\", "/")
        rel = lambda n: n if base == "." else f"{base}/{n}"  # noqa: E731, B023
        names[:] = sorted(n for n in names if n != ".git" and not ignored(rel(n), True))
        out += [os.path.join(folder, n) for n in sorted(files) if not ignored(rel(n), False)]
    return out


def scan_tree(spark: SparkSession, root: str, extensions: list[str] | None = None, most: int = MOST_BYTES) -> DataFrame:
    """A local source tree as files; the driver lists paths and evaluates ignore rules, executors read."""
    paths = tree_paths(root)
    if not paths:
        return spark.createDataFrame([], "path string, content string, language string")
    rows = spark.read.format("binaryFile").load([f"file://{p}" for p in paths])
    return as_files(rows.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content"), extensions, most)


def scan_folder(spark: SparkSession, path: str, extensions: list[str] | None = None, most: int = MOST_BYTES) -> DataFrame:
    """All files below a folder of any store that Spark reads; no ignore rules. Oversize files are not even opened."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= most)
    return as_files(rows.select("path", "content"), extensions, most)


def scan_single(spark: SparkSession, path: str) -> DataFrame:
    return scan_tree_paths(spark, [path])


def scan_tree_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = spark.read.format("binaryFile").load([f"file://{os.path.abspath(p)}" for p in paths])
    return as_files(rows.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content"))
