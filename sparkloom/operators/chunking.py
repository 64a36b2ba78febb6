"""Cutting files into chunks."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFINITION_SCHEMA = "path string, start_line long, end_line long, chunk_type string, name string, parent_name string"
CHUNK_SCHEMA = "path string, content string, start_line long, end_line long, chunk_type string, name string, parent_name string"

# The line patterns of each language, in the order they are tried.
LINE_PATTERNS = {
    "python": (r"^\s*(async\s+)?def\s+\w+", r"^\s*class\s+\w+", r"^\s*(import|from)\s+", r"""^\s*(\"\"\"|''')"""),
    "rust": (r"^\s*(pub\s+)?(async\s+)?fn\s+\w+", r"^\s*(pub\s+)?(struct|enum|trait|impl)\s+", r"^\s*use\s+", r"^\s*///"),
    "go": (r"^\s*func\s+", r"^\s*type\s+\w+\s+(struct|interface)", r"^\s*import\s+", r"^\s*//"),
    "typescript": (
        r"^\s*(export\s+)?(async\s+)?function\s+\w+|^\s*(const|let|var)\s+\w+\s*=\s*(async\s+)?\(",
        r"^\s*(export\s+)?class\s+\w+",
        r"^\s*import\s+",
        r"^\s*/\*\*",
    ),
    "java": (r"^\s*(public|private|protected)?\s*(static\s+)?\w+\s+\w+\s*\(", r"^\s*(public\s+)?(abstract\s+)?class\s+\w+", r"^\s*import\s+", r"^\s*/\*\*"),
    None: (
        r"^\s*(pub\s+)?(async\s+)?(fn|function|def|func)\s+\w+",
        r"^\s*(pub\s+)?(class|struct|type|interface)\s+\w+",
        r"^\s*(import|use|from|require)\s+",
        r'^\s*(///|/\*\*|#|""")',
    ),
}
SAME_PATTERNS = {"javascript": "typescript", "tsx": "typescript", "kotlin": "java"}
GUARD_LINES = 500
HELD = 1 << 21  # characters of chunks that a task holds before it passes them on
KINDS = ("function", "class", "import", "comment")
# Definitions of two more languages for syntax chunks: function, class, import.
_C = (r"^[A-Za-z_][\w:<>,*&~\s]*\([^;]*$", r"^\s*(template\s*<[^>]*>\s*)?(typedef\s+)?(class|struct|enum|union|namespace)\s+\w+[^;]*$", r"^\s*#\s*include\b")
_JAVA_WORDS = r"(?:(?:public|private|protected|internal|static|final|abstract|synchronized|native|default|override|open|inline|suspend|sealed|data|inner)\s+)*"
_JAVA = (
    rf"^\s*(?!(?:return|new|else|throw|case|do|assert|yield)\b){_JAVA_WORDS}(?:<[^>]*>\s*)?[\w<>\[\],.?]+\s+\w+\s*\([^;{{]*(?:\{{|$)",
    rf"^\s*{_JAVA_WORDS}(?:class|interface|enum|record|object)\s+\w+",
    r"^\s*import\s+",
)
SYNTAX_PATTERNS = LINE_PATTERNS | {"c": _C, "cpp": _C, "java": _JAVA}
# A method without a keyword, directly in a class's braces; and the receiver and name of a method that stands outside.
CLASS_METHODS = {
    "typescript": re.compile(r"^\s*(?:(?:public|private|protected|static|async|override|abstract|get|set)\s+)*[*#]?(?P<name>[\w$]+)\s*(?:<[^>]*>)?\(.*(?<!;)$"),
    "java": re.compile(r"^\s*(?P<name>[A-Z]\w*)\s*\([^;{]*\{"),
}
_RECEIVER = re.compile(r"^\s*func\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)[^)]*\)\s*(\w+)")


_STRING = r'"(?:\\.|[^"\\\n])*"'
_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_BACKTICK = r"`(?:\\.|[^`\\])*`"
#: What is not code in each language: comments, strings, raw and template literals, characters (but no lifetimes).
NOT_CODE = {
    "rust": rf"""{_COMMENT}|b?r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|b?'(?:\\[^\n]|[^'\\\n])'""",
    "go": rf"""{_COMMENT}|{_STRING}|`[^`]*`|'(?:\\.|[^'\\\n])+'""",
    "typescript": rf"""{_COMMENT}|{_STRING}|{_BACKTICK}|'(?:\\.|[^'\\\n])*'""",
    "c": rf"""{_COMMENT}|{_STRING}|'(?:\\.|[^'\\\n])+'""",
    "java": rf"""{_COMMENT}|\"{{3}}.*?(?:\"{{3}}|\Z)|{_STRING}|'(?:\\.|[^'\\\n])+'""",
    "cpp": rf"""{_COMMENT}|R"([^()\\ ]*)\(.*?\)\1"|{_STRING}|'(?:\\.|[^'\\\n])+'""",
}


def only_code(content: str, language: str | None) -> str:
    """content with spaces in place of what is no code in its language; lines stay."""
    pattern = NOT_CODE.get(SAME_PATTERNS.get(language, language))
    if pattern is None:
        return content
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), content, flags=re.DOTALL)


def split_lines(text: str) -> list[str]:
    out = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
    return out[:-1] if out[-1] == "" else out


def _size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


class Shape:
    """What decides where blocks end, as arrays over the lines of a file: bytes, braces, indentation, blank lines."""

    def __init__(self, lines: list[str]):
        self.lines, n = lines, len(lines)
        self.stripped = [x.strip() for x in lines]
        self.bytes = np.concatenate([[0], np.cumsum([_size(x) + 1 for x in lines])])  # with the line feed
        opened = np.array([x.count("{") for x in lines], np.int64)
        closed = np.array([x.count("}") for x in lines], np.int64)
        self.depth = np.concatenate([[0], np.cumsum(opened - closed)])  # before each line, and after the last
        self.opens = np.flatnonzero(opened)
        self.blank = np.array([not x for x in self.stripped], bool)
        self.indent = np.array([len(x) - len(x.lstrip()) for x in lines], np.int64)
        self.last = n - 1

    def _first(self, hit: np.ndarray, start: int) -> int | None:
        found = np.flatnonzero(hit[start:])
        return start + int(found[0]) if len(found) else None

    def brace_end(self, start: int) -> int:
        """The line on which the braces opened from start on are closed again; GUARD_LINES on at the latest."""
        guard = min(start + GUARD_LINES + 1, self.last)
        at = np.searchsorted(self.opens, start)
        if at == len(self.opens) or self.opens[at] > guard:
            return guard
        found = self._first(self.depth[1 : guard + 2] == self.depth[start], int(self.opens[at]))
        return guard if found is None else found

    def indent_end(self, start: int) -> int:
        """The line before the first later one, the next excepted, that is not indented deeper than start."""
        guard = min(start + GUARD_LINES + 1, self.last)
        found = self._first((~self.blank & (self.indent <= self.indent[start]))[: guard + 1], start + 2)
        return guard if found is None else found - 1

    def run_end(self, start: int, inside: np.ndarray, ignored: np.ndarray) -> int:
        """The last line inside of the run from start on; ignored lines neither end nor prolong it."""
        end = self._first(~inside & ~ignored, start)
        return start + int(np.flatnonzero(inside[start:end])[-1]) if inside[start] else start

    def text(self, first: int, last: int) -> str:
        return "\n".join(self.lines[first : last + 1])

    def size(self, first: int, last: int) -> int:
        return int(self.bytes[last + 1] - self.bytes[first]) - 1

    def filled(self, start: int, most: int) -> int:
        """The first line at which the bytes from start on reach `most`; beyond the last if none does."""
        return int(np.searchsorted(self.bytes, self.bytes[start] + most)) - 1


class LineChunker:
    """Blocks found line by line: functions, classes, runs of imports and comments; by size where there are none."""

    def __init__(self, most: int = 1500, least: int = 100, overlap: int = 100):
        self.most, self.least, self.back = most, least, overlap // 50

    def chunk(self, content: str, language: str | None) -> list[tuple[str, int, int, str]]:
        """(content, first line, last line, type)."""
        lines = split_lines(content)
        if not lines:
            return []
        shape = Shape(lines)
        patterns = [re.compile(p) for p in LINE_PATTERNS.get(SAME_PATTERNS.get(language, language), LINE_PATTERNS[None])]
        function, class_, import_, comment = (np.array([bool(p.search(x)) for x in shape.stripped], bool) for p in patterns)
        kinds = np.select([function, class_, import_, comment], [1, 2, 3, 4])
        remark = comment | np.array([x.startswith(("//", "#")) for x in shape.stripped], bool)
        never = np.zeros(len(lines), bool)
        out, free = [], 0
        for i in np.flatnonzero(kinds).tolist():
            if i < free:
                continue
            kind = KINDS[kinds[i] - 1]
            if kind == "import":
                end = shape.run_end(i, import_ | shape.blank, never)
            elif kind == "comment":
                closed = next((j for j in range(i, len(lines)) if "*/" in lines[j]), None) if shape.stripped[i].startswith("/*") else None
                end = shape.run_end(i, remark, shape.blank) if closed is None else closed
            else:
                end = shape.indent_end(i) if language == "python" else shape.brace_end(i)
            if shape.size(i, end) > self.most:
                out += [(shape.text(a, b), a + 1, b + 1, kind) for a, b in self._pieces(shape, i, end)]
            elif shape.size(i, end) >= self.least:
                out.append((shape.text(i, end), i + 1, end + 1, kind))
            free = end + 1
        return out or self.by_size(shape)

    def _pieces(self, shape: Shape, first: int, last: int) -> Iterator[tuple[int, int]]:
        """An oversize block in pieces: the line that fills one up begins the next, with `back` lines of overlap."""
        start, low = first, first + 1
        while (full := max(low, shape.filled(start, self.most))) <= last:
            if shape.size(start, full - 1) >= self.least:
                yield start, full - 1
            start, low = max(first, full - self.back), full + 1
        if shape.size(start, last) >= self.least:
            yield start, last

    def by_size(self, shape: Shape) -> list[tuple[str, int, int, str]]:
        """Pieces that end with the line that fills them up; each begins with the last three lines of the one
        before, which are not counted again."""
        spans, start, counted = [], 0, 0
        while counted <= shape.last and (full := shape.filled(counted, self.most)) <= shape.last:
            spans.append((start, full))
            start, counted = max(0, full - 2), full + 1
        if not spans or shape.size(start, shape.last) >= self.least:
            spans.append((start, shape.last))
        return [(shape.text(a, b), a + 1, b + 1, "code") for a, b in spans]


def without_contained(spans: list[tuple]) -> list[tuple]:
    """Spans (start, end, ...) that no other contains; of equal ones the first."""
    out, reach = [], -1
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if s[1] > reach:
            out.append(s)
            reach = s[1]
    return out


class SyntaxChunker:
    """Whole definitions with their names and parents: Python by its own parser, other languages by braces.

    An approximation of a grammar for the brace languages: a definition is a line that matches a pattern, up to its
    closing brace, where strings and comments do not count; a definition inside a class has it as parent, and a method
    that stands outside has its receiver's type.
    """

    def __init__(self, most: int = 1500, least: int = 50):
        self.most, self.least, self.lines = most, least, LineChunker(most, least)

    def chunk(self, content: str, language: str | None) -> list[tuple[str, int, int, str, str | None, str | None]]:
        """(content, first line, last line, type, name, parent name)."""
        lines = split_lines(content)
        if not lines:
            return []
        out = []
        for first, last, kind, name, parent in without_contained(self.definitions(content, language)):
            body = "\n".join(lines[first - 1 : last])
            if _size(body) > self.most:
                out += self._cut(lines[first - 1 : last], first, kind, name, parent)
            elif _size(body) >= self.least:
                out.append((body, first, last, kind, name, parent))
        return out or [(*c, None, None) for c in self.lines.by_size(Shape(lines))]

    def definitions(self, content: str, language: str | None) -> list[tuple[int, int, str, str | None, str | None]]:
        """(first line, last line, type, name, parent name) of all definitions and imports, with those inside of others."""
        if language == "python":
            return self._python(content)
        return self._braces(split_lines(content), split_lines(only_code(content, language)), language)

    def _python(self, content: str) -> list[tuple]:
        try:
            tree = ast.parse(content)
        except (SyntaxError, ValueError, RecursionError, MemoryError):  # the parser's stack counts as memory
            return []
        out = []

        def walk(node: ast.AST, parent: str | None) -> None:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    kind = "class" if isinstance(child, ast.ClassDef) else "method" if parent else "function"
                    out.append((child.lineno, child.end_lineno, kind, child.name, parent))
                    walk(child, child.name)
                elif isinstance(child, (ast.Import, ast.ImportFrom)):
                    out.append((child.lineno, child.end_lineno, "import", None, parent))
                else:
                    walk(child, parent)

        walk(tree, None)
        return out

    def _braces(self, lines: list[str], code: list[str], language: str | None) -> list[tuple]:
        """code: the lines without strings and comments, whose braces and words do not count."""
        family = SAME_PATTERNS.get(language, language)
        patterns = [re.compile(p) for p in SYNTAX_PATTERNS.get(family, LINE_PATTERNS[None])[:3]]
        method = CLASS_METHODS.get(family)
        shape = Shape(code)
        word = re.compile(r"\b(?:fn|function|def|func|class|struct|enum|union|namespace|trait|impl|type|interface|const|let|var)\s+(\w+)|(\w+)\s*\(")
        out: list[tuple] = []
        open_classes: list[tuple[int, str | None, int]] = []  # last line, name, depth of what is directly inside
        for i, line in enumerate(lines):
            open_classes = [c for c in open_classes if c[0] > i]
            kind = next((k for k, p in zip(("function", "class", "import"), patterns) if p.search(line.strip())), None)
            own = method.search(code[i].rstrip()) if kind is None and method and open_classes and shape.depth[i] == open_classes[-1][2] else None
            if own:
                kind = "function"
            if kind is None or not code[i].strip():  # none, or inside of a comment or string
                continue
            end = i if kind == "import" else shape.brace_end(i)
            name = (m[1] or m[2] if (m := word.search(line)) else None) if kind != "import" else None
            parent = open_classes[-1][1] if open_classes else None
            if language == "go" and (m := _RECEIVER.search(line)):
                parent, name = m[1], m[2]
            elif own:
                name = own["name"]
            out.append((i + 1, end + 1, "method" if kind == "function" and parent else kind, name, parent))
            if kind == "class":
                open_classes.append((end, name, int(shape.depth[i]) + 1))
        return out

    def _cut(self, lines: list[str], first: int, kind: str, name: str | None, parent: str | None) -> list[tuple]:
        out, held, at = [], [], first
        for i, x in enumerate(lines):
            if held and _size("\n".join(held)) + _size(x) + 1 > self.most:
                out.append(("\n".join(held), at, first + i - 1, kind, name, parent))
                held, at = [], first + i
            held.append(x)
        if _size("\n".join(held)) >= self.least:
            out.append(("\n".join(held), at, first + len(lines) - 1, kind, name, parent))
        return out


def chunk_files(files: DataFrame, syntax: bool = False, most: int = 1500) -> DataFrame:
    """files (path, content, language) as chunks; a file is a row, so nothing is shuffled. Null content has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = SyntaxChunker(most) if syntax else LineChunker(most)
        columns = ["path", "content", "start_line", "end_line", "chunk_type", "name", "parent_name"]
        for batch in batches:
            rows, held = [], 0
            for path, content, language in zip(batch["path"], batch["content"], batch["language"]):
                for c in own.chunk(content or "", language):
                    rows.append((path, *c) if syntax else (path, *c, None, None))
                    held += len(c[0])
                if held >= HELD:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content", "language").mapInPandas(run, CHUNK_SCHEMA)


def definitions(files: DataFrame) -> DataFrame:
    """A row for each definition and import of files (path, content, language), with those inside of others and the class
    that holds each: the outline from which syntax chunks are taken. Null and empty content has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = SyntaxChunker()
        for batch in batches:
            rows = [(path, *d) for path, content, language in zip(batch["path"], batch["content"], batch["language"]) for d in own.definitions(content or "", language)]
            yield pd.DataFrame(rows, columns=["path", "start_line", "end_line", "chunk_type", "name", "parent_name"])

    return files.select("path", "content", "language").mapInPandas(run, DEFINITION_SCHEMA)


def drop_contained(spans: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Rows whose span lies in no other's of the group: one window, no self-join. Of equal spans one stays."""
    order = Window.partitionBy(group).orderBy(F.asc(start), F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(order)
    return spans.withColumn("_reach", reach).where(F.col("_reach").isNull() | (F.col("_reach") < F.col(end))).drop("_reach")
