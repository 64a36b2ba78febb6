"""The tools of the engine for a language model's client: nine names with their arguments, and JSON-RPC around them.

A toolbox serves the stores under one root. Each tool runs the same operators as the rest of the engine on a store's
tables; its answer is text. Errors of a call are answers too, marked as such; errors of the protocol have the codes of
JSON-RPC.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import scores as S
from sparkloom.functions import text as X
from sparkloom.operators import search, symbols
from sparkloom.operators.indexing import IndexConfig, Store, index_files, nearest
from sparkloom.operators.providers import EmbeddingProvider, HashingProvider, query_vector
from sparkloom.operators.snapshots import Files
from sparkloom.sources.files import scan_tree

PROTOCOL = "2024-11-05"
MOST_RESULTS = 50

# The tools' names and the names, types and defaults of their arguments; ! marks a required one.
ARGUMENTS = {
    "semantic_search": {"query!": "string", "path": "string", "max_results": 10, "mode": "balanced", "include_content": True},
    "index_directory": {"path!": "string", "mode": "balanced"},
    "get_codebase_map": {"path": "string", "minimal": False},
    "search_symbols": {"query!": "string", "path": "string", "max_results": 20},
    "expand_symbol": {"symbol_id!": "string", "path": "string", "include_code": False},
    "find_similar_code": {"code": "string", "file": "string", "max_results": 10},
    "ask_codebase": {"question!": "string", "max_context": 5},
    "get_file_context": {"file_path!": "string", "include_content": False},
    "list_indexed_files": {"pattern": "string"},
}
KINDS = {str: "string", int: "integer", bool: "boolean"}
ABOUT = {
    "semantic_search": "Chunks that fit a question best, by meaning and words.",
    "index_directory": "Index a folder, or bring its index up to date, with its code map.",
    "get_codebase_map": "All symbols of the indexed files, by file.",
    "search_symbols": "Symbols by a part of their name, signature or summary.",
    "expand_symbol": "A symbol with what it depends on and what depends on it.",
    "find_similar_code": "Chunks like a piece of code or a file.",
    "ask_codebase": "The chunks that answer a question, and a prompt made of them.",
    "get_file_context": "Lines, imports and symbols of an indexed file.",
    "list_indexed_files": "Indexed files by folder, all or those of a pattern.",
}


class ToolError(Exception):
    """What a call answers when it cannot be served."""


class BadArguments(Exception):
    """Arguments of other types than the tool's schema has."""


def definitions() -> list[dict]:
    """The tools with JSON schemas of their arguments."""
    out = []
    for name, own in ARGUMENTS.items():
        properties = {}
        for key, value in own.items():
            plain = key.rstrip("!")
            properties[plain] = {"type": "string"} if value == "string" else {"type": KINDS[type(value)], "default": value}
        required = [k[:-1] for k in own if k.endswith("!")]
        out.append({"name": name, "description": ABOUT[name], "inputSchema": {"type": "object", "properties": properties, "required": required}})
    return out


class Toolbox:
    """The tools over the stores under root, one for each indexed folder. A call's path is that folder or one below it (or
    a store's name); without one, the folder that was indexed last is taken."""

    def __init__(self, spark: SparkSession, root: str, provider: Callable[[], EmbeddingProvider] = HashingProvider, scan: Callable[..., DataFrame] = scan_tree):
        self.spark, self.root, self.make, self.scan = spark, root, provider, scan
        self.provider = provider()
        self.last: str | None = None

    # ---- protocol

    def answer(self, line: str) -> str:
        """The response to one request, both as a line of JSON."""
        try:
            request = json.loads(line)
        except ValueError as e:
            return json.dumps(self._error(None, -32700, f"Parse error: {e}"))
        return json.dumps(self.handle(request))

    def serve(self, lines: Iterable[str], out: TextIO) -> int:
        """Answers requests, a line each, until lines end; how many were answered. Blank lines and notifications (without
        an id) get no answer."""
        answered = 0
        for line in lines:
            if not line.strip():
                continue
            try:
                request = json.loads(line)
            except ValueError:
                request = None
            if isinstance(request, dict) and "id" not in request and isinstance(request.get("method"), str):
                continue
            out.write(self.answer(line) + "\n")
            out.flush()
            answered += 1
        return answered

    def handle(self, request) -> dict:
        if not isinstance(request, dict) or not isinstance(request.get("method"), str):
            return self._error(request.get("id") if isinstance(request, dict) else None, -32600, "Invalid Request")
        key, method = request.get("id"), request["method"]
        if method == "initialize":
            server = {"name": "sparkloom", "version": "0.1"}
            return self._result(key, {"protocolVersion": PROTOCOL, "capabilities": {"tools": {"listChanged": False}}, "serverInfo": server})
        if method in ("initialized", "ping"):
            return self._result(key, {})
        if method == "tools/list":
            return self._result(key, {"tools": definitions()})
        if method == "tools/call":
            params = request.get("params")
            if not isinstance(params, dict) or not isinstance(params.get("name"), str):
                return self._error(key, -32602, "Missing params" if params is None else "Invalid params")
            if not isinstance(params.get("arguments") or {}, dict):
                return self._error(key, -32602, "Invalid params: arguments must be an object")
            try:
                text, failed = self.call(params["name"], params.get("arguments"))
            except BadArguments as e:
                return self._error(key, -32602, f"Invalid params: {e}")
            return self._result(key, {"content": [{"type": "text", "text": text}], "isError": failed})
        return self._error(key, -32601, f"Method not found: {method}")

    @staticmethod
    def _result(key, result: dict) -> dict:
        return {"jsonrpc": "2.0", "id": key, "result": result}

    @staticmethod
    def _error(key, code: int, message: str) -> dict:
        return {"jsonrpc": "2.0", "id": key, "error": {"code": code, "message": message}}

    def call(self, name: str, arguments: dict | None) -> tuple[str, bool]:
        """(text, whether it is an error) of one call."""
        if name not in ARGUMENTS:
            return f"Unknown tool: {name}", True
        own, given = ARGUMENTS[name], arguments or {}
        values = {}
        for key, kind in own.items():
            plain = key.rstrip("!")
            value = given.get(plain)
            if value is None:
                if key.endswith("!"):
                    return f"The argument '{plain}' is needed", True
                value = None if kind == "string" else kind
            elif not isinstance(value, str if kind == "string" else type(kind)) or isinstance(value, bool) and not isinstance(kind, bool):
                raise BadArguments(f"{plain} must be of type {KINDS[str if kind == 'string' else type(kind)]}")
            elif isinstance(value, int) and not isinstance(value, bool) and value < 1:
                raise BadArguments(f"{plain} must be at least 1")
            values[plain] = value
        try:
            return getattr(self, name)(**values), False
        except ToolError as e:
            return str(e), True
        except Exception as e:  # a tool that breaks must not end the server
            return f"{name} failed: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", True

    # ---- tables

    @staticmethod
    def _name(folder: str) -> str:
        """The store of a folder."""
        folder = os.path.abspath(folder)
        return f"{os.path.basename(folder) or 'root'}-{hashlib.sha256(folder.encode()).hexdigest()[:12]}"

    def _store(self, path: str | None) -> Store:
        known = Files(self.spark).list(self.root)
        if path is None:
            return Store(self.spark, self.root, self.last or max(known, key=known.get, default="default"))
        folder = os.path.abspath(path)
        while self._name(folder) not in known and os.path.dirname(folder) != folder:
            folder = os.path.dirname(folder)
        name = self._name(folder)
        return Store(self.spark, self.root, name if name in known else path if path in known else self._name(path))

    def _table(self, path: str | None, name: str) -> DataFrame:
        own = self._store(path).snapshot()
        if name not in own.tables():
            raise ToolError(f"Nothing indexed {'yet' if path is None else f'for {path}'}: call index_directory first")
        return own.table(name)

    def _found(self, path: str | None, query: str, limit: int) -> DataFrame:
        chunks, index, total = (self._table(path, n) for n in ("chunks", "postings", "corpus"))
        vector = query_vector(self.provider, query)
        found = search.hybrid(chunks, query, vector, limit, "id", index=index, total=total, near=nearest(self._store(path), vector, search.OVERFETCH * limit))
        return found.join(chunks.select("id", "file_path", "start_line", "end_line", "content"), "id")

    @staticmethod
    def _shown(found: DataFrame, lines: int) -> list[str]:
        place = F.concat("file_path", F.lit(" ("), S.percent(F.col("score")).cast("string"), F.lit("% match), lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
        body = F.concat(F.lit("\n"), X.preview(F.col("content"), lines)) if lines else F.lit("")
        return [f"{r.rank}. {r.s}" for r in found.orderBy("rank").select("rank", F.concat(place, body).alias("s")).collect()]

    # ---- tools

    def semantic_search(self, query: str, path: str | None, max_results: int, mode: str, include_content: bool) -> str:
        """mode is a name for the provider's model; the one of this toolbox serves all."""
        rows = self._shown(self._found(path, query, min(max_results, MOST_RESULTS)), 15 if include_content else 0)
        return "\n\n".join([f"{len(rows)} chunks fit '{query}' best:", *rows]) if rows else f"Nothing fits '{query}'"

    def index_directory(self, path: str, mode: str) -> str:
        store = Store(self.spark, self.root, self._name(path))
        files = self.scan(self.spark, path)
        metrics = index_files(store, files, IndexConfig("fast" if mode == "fast" else "balanced", provider=self.make))
        store.save_code_map(files)
        self.last = self._name(path)
        return json.dumps(metrics)

    def get_codebase_map(self, path: str | None, minimal: bool) -> str:
        own = self._table(path, "symbols")
        shown = (symbols.minimal_overview if minimal else symbols.compact_overview)(own)
        return "\n".join(r.overview for r in shown.orderBy("file").collect())

    def search_symbols(self, query: str, path: str | None, max_results: int) -> str:
        found = symbols.search(self._table(path, "symbols"), query, max_results)
        rows = [f"[{r.kind}] {r.signature} ({r.file}:{r.line}) id {r.id}" for r in found.orderBy("rank").collect()]
        return "\n".join(rows) or f"No symbols found for: '{query}'"

    def expand_symbol(self, symbol_id: str, path: str | None, include_code: bool) -> str:
        own = self._table(path, "symbols")
        head = own.where(F.col("id") == symbol_id).first()
        if head is None:
            raise ToolError(f"Symbol not found: {symbol_id}")
        out = [f"[{head.kind}] {head.signature} ({head.file}:{head.line})"]
        store = self._store(path)
        if "symbol_edges" in store.tables():
            near = symbols.expand(own, store.table("symbol_edges"), symbol_id)
            out += [f"{r.direction}: {r['name']} ({r.file})" for r in near.orderBy("direction", "id").collect()]
        if include_code:
            part = self._table(path, "contents").where(F.col("path") == head.file).select(symbols.snippet(F.col("content"), F.lit(head.line)).alias("s")).first()
            out += [part.s] if part else []
        return "\n".join(out)

    def find_similar_code(self, code: str | None, file: str | None, max_results: int) -> str:
        if code is None and file is None:
            raise ToolError("Either 'code' or 'file' is required")
        if code is None:
            row = self._table(None, "contents").where(F.col("path") == file).first()
            if row is None:
                raise ToolError(f"File not found: {file}")
            code = row.content
        return "\n\n".join(self._shown(self._found(None, code, min(max_results, MOST_RESULTS)), 6)) or "No similar code found"

    def ask_codebase(self, question: str, max_context: int) -> str:
        found = self._found(None, question, max_context)
        context = search.answer_context(found, "file_path", first=max_context)
        return search.prompt(context, question).first().prompt

    def get_file_context(self, file_path: str, include_content: bool) -> str:
        files = self._table(None, "contents").where(F.col("path") == file_path)
        row = symbols.file_context(files, self._table(None, "symbols")).first()
        if row is None:
            raise ToolError(f"File not found: {file_path}")
        out = [f"File: {file_path}", f"Lines: {row.lines}", f"Extension: .{row.extension}", f"Symbols: {row.n_symbols}", *row.symbols]
        out += ["Imports:", *row.imports] if row.imports else []
        return "\n".join(out + ([files.first().content] if include_content else []))

    def list_indexed_files(self, pattern: str | None) -> str:
        files = self._table(None, "files")
        if pattern:
            files = files.where(X.glob_match(F.col("path"), pattern))
        rows = files.groupBy(X.directory(F.col("path")).alias("dir")).agg(F.sort_array(F.collect_list(X.file_name(F.col("path")))).alias("names"))
        return "\n".join(f"{r.dir or '.'}/\n" + "\n".join(f"  {n}" for n in r.names) for r in rows.orderBy("dir").collect()) or "No files indexed"
