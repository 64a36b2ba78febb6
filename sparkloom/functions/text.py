"""Column functions for text, paths, identity and languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Indexed extensions, extensionless names, and the languages of extensions in three uses.
EXTENSIONS = [
    "rs", "ts", "tsx", "js", "jsx", "py", "go", "java", "c", "cpp", "h", "hpp", "cs", "rb", "php", "swift", "kt",
    "scala", "clj", "ex", "exs", "erl", "hs", "ml", "fs", "vue", "svelte", "html", "css", "scss", "sass", "less",
    "json", "yaml", "yml", "toml", "xml", "md", "txt", "sh", "bash", "zsh", "fish", "ps1", "sql", "graphql", "proto",
    "dockerfile", "makefile", "cmake", "gradle", "cargo",
]
BARE_NAMES = ["dockerfile", "makefile", "cargo"]
FILE_LANGUAGES = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go",
    "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "cs": "csharp", "rb": "ruby",
    "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "clj": "clojure", "ex": "elixir", "exs": "elixir",
    "erl": "erlang", "hs": "haskell", "ml": "ocaml", "fs": "fsharp", "vue": "vue", "svelte": "svelte", "html": "html", "css": "css",
    "scss": "scss", "sass": "scss", "less": "less", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml",
    "md": "markdown", "sh": "shell", "bash": "shell", "zsh": "shell", "sql": "sql", "graphql": "graphql", "proto": "protobuf",
}
CHUNK_LANGUAGES = {
    "rs": "rust", "py": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript",
    "mts": "typescript", "cts": "typescript", "tsx": "tsx", "jsx": "javascript", "go": "go", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
}
SYMBOL_LANGUAGES = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python",
    "go": "go", "java": "java", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "cpp", "c": "c", "rb": "ruby", "php": "php",
    "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "zig": "zig",
}


def tokens(text: Column) -> Column:
    """Lower-cased runs of other than Unicode white space."""
    return F.array_remove(F.split(F.lower(text), "(?U)\\s+"), "")


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty one does not count."""
    every = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(F.endswith(text, F.lit("\n")) | (text == ""), F.slice(every, 1, F.size(every) - 1)).otherwise(every)


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The parent; empty for a bare name."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, lower-cased; null where there is none or it leads the name."""
    found = F.lower(F.regexp_extract(file_name(path), "^.+\\.([^.]*)$", 1))
    return F.when(file_name(path).rlike("^.+\\."), found)


def language(path: Column, table: dict[str, str], default: str | None = None) -> Column:
    """The language of a path's extension by one of the tables."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.element_at(F.create_map(*pairs), extension(path))
    return found if default is None else F.coalesce(found, F.lit(default))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of path:start:end."""
    return F.substring(F.sha2(F.concat_ws(":", path, start.cast("string"), end.cast("string")), 256), 1, 16)


def repo_id(root: Column) -> Column:
    return F.substring(F.sha2(root, 256), 1, 16)


def file_id(repo: Column, path: Column) -> Column:
    return F.concat(repo, F.lit(":"), path)


def hierarchy(parent: Column, name: Column) -> Column:
    """parent::name, the one that is there, or null."""
    both = F.concat_ws("::", parent, name)
    return F.when(name.isNotNull(), both)


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def glob_match(path: Column, pattern: str) -> Column:
    """With one *: prefix and suffix; with several: the rest as a substring; with none: a substring."""
    parts = pattern.split("*")
    if len(parts) == 2:
        return path.startswith(parts[0]) & path.endswith(parts[1])
    return path.contains(pattern.replace("*", ""))


def human_size(n: Column) -> Column:
    """Bytes with a unit; ties round to even."""
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024**2, F.format_string("%.1f KB", F.bround(n / 1024, 1)))
        .when(n < 1024**3, F.format_string("%.1f MB", F.bround(n / 1024**2, 1)))
        .otherwise(F.format_string("%.2f GB", F.bround(n / 1024**3, 2)))
    )


def shortened_path(path: Column, limit: int) -> Column:
    """At most limit characters: the end of a longer path after three dots."""
    return F.when(F.length(path) <= limit, path).otherwise(F.concat(F.lit("..."), F.substring(path, -(limit - 3), limit - 3)))


def simplified_params(params: Column) -> Column:
    """Of a list of over 50 bytes and 3 parts only the number of parts."""
    p = trimmed(params)
    n = F.size(F.split(p, ","))
    return F.when((F.octet_length(p) > 50) & (n > 3), F.concat(n.cast("string"), F.lit("..."))).otherwise(p)


def after_colon(x: Column) -> Column:
    """What follows the first colon; all of a text without one."""
    return F.substr(x, F.instr(x, ":") + 1)


def occurrences(text: Column, part: str) -> Column:
    """How often a part occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def indentation(line: Column) -> Column:
    """The number of leading white-space characters."""
    return F.length(F.regexp_extract(line, "(?U)^\\s*", 0)).cast("long")


def preview(text: Column, first: int = 6) -> Column:
    """The first lines, and a line of three dots where there are more."""
    every = lines(text)
    return F.concat(F.array_join(F.slice(every, 1, first), "\n"), F.when(F.size(every) > first, "\n...").otherwise(""))
