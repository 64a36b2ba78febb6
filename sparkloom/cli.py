"""Command line: python -m sparkloom.cli COMMAND. Each command runs one operator over a store or a folder.

Output is text, or with --json one JSON value. A store is named by --store under --root.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import scores as S
from sparkloom.functions import text as X
from sparkloom.operators import graph, indexing, search, symbols
from sparkloom.operators.providers import HashingProvider, query_vector
from sparkloom.sources import files, history
from sparkloom.streaming import changes


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom")
    p.add_argument("--root", default=os.path.expanduser("~/.sparkloom"))
    p.add_argument("--store", default="default")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *aliases: sub.add_parser(name, aliases=aliases)
    c = add("index", "i")
    c.add_argument("path")
    c.add_argument("--tier", choices=("fast", "balanced", "quality"), default="balanced")
    c.add_argument("--full", action="store_true")
    c = add("search", "s")
    c.add_argument("pattern")
    c.add_argument("-m", "--max-count", type=int, default=10)
    c.add_argument("-t", "--type", action="append")
    c.add_argument("--content", action="store_true")
    c.add_argument("--related", type=int, default=0)
    c = add("ask", "a")
    c.add_argument("question")
    add("status", "st")
    c = add("clean")
    c.add_argument("--all", action="store_true")
    c = add("compile")
    c.add_argument("path")
    c = add("symbols")
    c.add_argument("query")
    c = add("graph", "g")
    c.add_argument("file", nargs="?")
    c.add_argument("--depth", type=int, default=2)
    c = add("watch", "w")
    c.add_argument("path")
    c.add_argument("--tier", choices=("fast", "balanced", "quality"), default="balanced")
    c.add_argument("--once", action="store_true")
    c = add("daemon")
    c.add_argument("path")
    c.add_argument("--tier", choices=("fast", "balanced", "quality"), default="balanced")
    c.add_argument("--once", action="store_true")
    add("serve")
    c = add("history", "h")
    c.add_argument("repo")
    c.add_argument("file", nargs="?")
    c.add_argument("--limit", type=int, default=10)
    return p


def run(spark: SparkSession, arguments: list[str]):
    """What a command gives: a dict or a list of rows; and whether to show it as JSON."""
    a = parser().parse_args(arguments)
    store = indexing.Store(spark, a.root, a.store)
    return _COMMANDS[a.command](spark, store, a), a.json


def _index(spark, store, a):
    config = indexing.IndexConfig(a.tier, incremental=not a.full)
    return indexing.index_files(store, files.scan_tree(spark, a.path), config)


def _found(store, query: str, limit: int, types: list[str] | None = None) -> DataFrame:
    chunks = store.table("chunks")
    vector = query_vector(HashingProvider(), query)
    near = indexing.nearest(store, vector, search.OVERFETCH * limit)
    found = search.hybrid(chunks, query, vector, limit, "id", path="file_path", types=types, index=store.table("postings"), total=store.table("corpus"), near=near)
    return found.join(chunks.select("id", "file_path", "start_line", "end_line", "content"), "id")


def _search(spark, store, a):
    found = _found(store, a.pattern, a.max_count, a.type)
    if a.related and "edges" in store.tables():
        links = store.table("edges").where("kind = 'Imports'").select(X.after_colon(F.col("src.id")).alias("src"), X.after_colon(F.col("dst.id")).alias("dst"))
        chunks = store.table("chunks")
        found = search.related(found, chunks, links, a.related, a.max_count, "file_path", "id").join(chunks.select("id", "start_line", "end_line", "content"), "id")
    shown = ["rank", F.col("file_path").alias("path"), "start_line", "end_line", S.percent(F.col("score")).alias("score_pct"), S.band(F.col("score")).alias("score_band")]
    return _rows(found.orderBy("rank").select(*shown, *([X.preview(F.col("content")).alias("content")] if a.content else [])))


def _ask(spark, store, a):
    found = _found(store, a.question, 5)
    return _rows(search.prompt(search.answer_context(found, "file_path"), a.question))


def _status(spark, store, a):
    if "files" not in store.tables():
        return {"files": 0, "chunks": 0, "vocabulary": 0, "megabytes": 0.0, "per_file": []}
    chunks = store.table("chunks")
    out = _rows(indexing.status(store.table("files"), chunks, store.table("idf"), HashingProvider().dimensions))[0]
    per = chunks.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("chunks")).orderBy("path")
    return out | {"per_file": _rows(per)}


def _clean(spark, store, a):
    sizes = _rows(indexing.stores(spark, a.root).withColumn("size", X.human_size(F.col("bytes"))).orderBy("name"))
    if a.all:
        return {"removed": indexing.clear_all(spark, a.root), "stores": sizes}
    store.clear()
    return {"removed": int(any(s["name"] == a.store for s in sizes)), "stores": sizes}


def _compile(spark, store, a):
    store.save_code_map(files.scan_tree(spark, a.path))
    return _rows(symbols.stats(store.table("symbols")))[0]


def _symbols(spark, store, a):
    return _rows(symbols.search(store.table("symbols"), a.query, 20).orderBy("rank"))


def _graph(spark, store, a):
    edges = store.table("edges")
    if a.file is None:
        return _rows(graph.most_connected(edges, 10))
    known = edges.where("kind = 'BelongsTo'").select(F.col("src.id").alias("id"), X.after_colon(F.col("src.id")).alias("path")).distinct()
    hit = graph.find_file(known, a.file).first()
    return [] if hit is None else _rows(graph.file_view(edges, known, hit.id, a.depth))


def _history(spark, store, a):
    commits = history.log(spark, a.repo, a.limit, a.file)
    date = F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm").alias("date")
    return _rows(commits.orderBy(F.desc("timestamp"), "hash").select(F.substring("hash", 1, 7).alias("hash"), "author", date, "message", "files_modified"))


def _watched(spark, store, a, rule):
    """Until it is stopped, or with --once until it has caught up. The stream's checkpoint lies beside the stores, so the
    next run goes on where this one ends."""
    name = hashlib.sha256(os.path.abspath(a.path).encode()).hexdigest()[:12]
    checkpoint = os.path.join(os.path.dirname(a.root.rstrip("/")) or ".", f".{os.path.basename(a.root.rstrip('/'))}-streams", a.store, f"{name}-{'flushed' if rule else 'direct'}")
    query = changes.watch_tree(store, os.path.abspath(a.path), checkpoint, None if a.once else "1 second", indexing.IndexConfig(a.tier), rule)
    query.awaitTermination()
    return {"version": store.version(), "files": store.table("files").count() if "files" in store.tables() else 0}


def _watch(spark, store, a):
    return _watched(spark, store, a, None)


def _daemon(spark, store, a):
    return _watched(spark, store, a, None if a.once else changes.Debounce())


def _serve(spark, store, a):
    import sys

    from sparkloom.tools import Toolbox

    return {"answered": Toolbox(spark, a.root).serve(sys.stdin, sys.stdout)}


_COMMANDS = {
    **dict.fromkeys(("watch", "w"), _watch),
    "daemon": _daemon,
    "serve": _serve,
    **dict.fromkeys(("index", "i"), _index),
    **dict.fromkeys(("search", "s"), _search),
    **dict.fromkeys(("ask", "a"), _ask),
    **dict.fromkeys(("status", "st"), _status),
    "clean": _clean,
    "compile": _compile,
    "symbols": _symbols,
    **dict.fromkeys(("graph", "g"), _graph),
    **dict.fromkeys(("history", "h"), _history),
}


def main() -> None:
    import sys

    from sparkloom.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    found, as_json = run(spark, sys.argv[1:])
    if as_json:
        print(json.dumps(found, default=str))
    else:
        for row in found if isinstance(found, list) else [found]:
            print("  ".join(f"{k}: {v}" for k, v in row.items()))
    spark.stop()


if __name__ == "__main__":
    main()
