"""The typed property graph: edge builders, traversal, views. Vertices are struct(kind, id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import written

# The kinds of edges, each with its reverse.
EDGE_KINDS = {
    "Imports": "ImportedBy",
    "References": "ReferencedBy",
    "Modifies": "ModifiedBy",
    "BelongsTo": "Contains",
    "ContainsChunk": "ChunkOf",
    "DefinedIn": "Defines",
    "DependsOn": "DependedBy",
}


def node(kind: str, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("id"))


def both_ways(rows: DataFrame, src: Column, dst: Column, kind: str, owner: str | None = None) -> DataFrame:
    """Edges of a kind from rows, and their reverses: one pass over rows. owner: a column to keep as the edges' owner."""
    meta = F.lit(None).cast("map<string,string>")
    pair = F.array(
        F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), meta.alias("metadata")),
        F.struct(dst.alias("src"), src.alias("dst"), F.lit(EDGE_KINDS[kind]).alias("kind"), meta.alias("metadata")),
    )
    kept = [] if owner is None else [F.col(owner).alias("owner")]
    return rows.select(*kept, F.explode(pair).alias("e")).select("e.*", *(["owner"] if kept else []))


def file_edges(files: DataFrame) -> DataFrame:
    """files (id, repo_id): BelongsTo the repository and Contains."""
    return both_ways(files, node("file", F.col("id")), node("repo", F.col("repo_id")), "BelongsTo")


def commit_edges(commits: DataFrame) -> DataFrame:
    """commits (hash, files_modified): Modifies each file and ModifiedBy."""
    rows = commits.select("hash", F.explode("files_modified").alias("file"))
    return both_ways(rows, node("commit", F.col("hash")), node("file", F.col("file")), "Modifies")


def symbol_edges(symbols: DataFrame) -> DataFrame:
    """symbols (name, file_id): DefinedIn the file and Defines."""
    return both_ways(symbols, node("symbol", F.col("name")), node("file", F.col("file_id")), "DefinedIn")


def import_edges(imports: DataFrame) -> DataFrame:
    """imports (src, dst): Imports and ImportedBy; repeated imports stay repeated edges."""
    return both_ways(imports, node("file", F.col("src")), node("file", F.col("dst")), "Imports")


def all_edges(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def edges_from(edges: DataFrame, kind: str, key: str) -> DataFrame:
    return edges.where((F.col("src.kind") == kind) & (F.col("src.id") == str(key)))


def edges_to(edges: DataFrame, kind: str, key: str) -> DataFrame:
    return edges.where((F.col("dst.kind") == kind) & (F.col("dst.id") == str(key)))


def imports_of(edges: DataFrame, files: DataFrame, key: str = "id") -> DataFrame:
    """src, and the files it imports; ids without a file go."""
    pairs = edges.where("kind = 'Imports'").select(F.col("src.id").alias("src"), F.col("dst.id").alias(key)).distinct()
    return pairs.join(files, key)


def importers_of(edges: DataFrame, files: DataFrame, key: str = "id") -> DataFrame:
    """dst, and the files that import it; ids without a file go."""
    pairs = edges.where("kind = 'ImportedBy'").select(F.col("src.id").alias("dst"), F.col("dst.id").alias(key)).distinct()
    return pairs.join(files, key)


def file_view(edges: DataFrame, files: DataFrame, file: str, depth: int = 2, most_related: int = 20, imports: bool = True, importers: bool = True) -> DataFrame:
    """section, name of one file: its imports (an unknown target by what follows the first colon of its id, with
    ' (external)'), importers, symbols, and, for a depth over 1, the first of the files within that depth."""
    from sparkloom.functions.text import after_colon

    out = edges_to(edges, "file", file).where("kind = 'DefinedIn'").select(F.lit("symbol").alias("section"), F.col("src.id").alias("name"))
    known = files.select(F.col("id").alias("_id"), "path")
    if imports:
        ids = edges_from(edges, "file", file).where("kind = 'Imports'").select(F.col("dst.id").alias("_id")).distinct()
        name = F.coalesce("path", F.concat(after_colon(F.col("_id")), F.lit(" (external)")))
        out = out.unionByName(ids.join(known, "_id", "left").select(F.lit("import").alias("section"), name.alias("name")))
    if importers:
        ids = edges_to(edges, "file", file).where("kind = 'Imports'").select(F.col("src.id").alias("_id")).distinct()
        out = out.unionByName(ids.join(known, "_id").select(F.lit("importer").alias("section"), F.col("path").alias("name")))
    if depth > 1:
        links = edges.where("kind = 'Imports'").select(F.col("src.id").alias("src"), F.col("dst.id").alias("dst"))
        near = reachable(links, edges.sparkSession.createDataFrame([(file,)], "_id string"), depth, "_id")
        near = near.join(known, "_id").select(F.lit("related").alias("section"), F.col("path").alias("name")).orderBy("name").limit(most_related)
        out = out.unionByName(near)
    return out


def file_imports(edges: DataFrame, files: DataFrame, key: str = "id") -> DataFrame:
    """src, target, name: the target's path, or its id with ' (external)' where it is no known file."""
    pairs = edges.where("kind = 'Imports'").select(F.col("src.id").alias("src"), F.col("dst.id").alias("target")).distinct()
    known = files.select(F.col(key).alias("target"), F.col("path").alias("_path"))
    return pairs.join(known, "target", "left").select("src", "target", F.coalesce("_path", F.concat("target", F.lit(" (external)"))).alias("name"))


def reachable(edges: DataFrame, start: DataFrame, depth: int, key: str = "id") -> DataFrame:
    """The ids within depth steps of start along edges (src, dst) in either direction, start itself excluded.

    Breadth first: each step joins the frontier alone and drops what was seen. What was seen is written in the shared
    folder after each step, so lineage stays short.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    frontier = start.select(F.col(key).alias("id")).distinct()
    seen = frontier.withColumn("step", F.lit(0))
    for step in range(1, depth + 1):
        found = both.join(frontier, both.src == frontier.id, "left_semi").select(F.col("dst").alias("id")).distinct()
        fresh = found.join(seen, "id", "left_anti").withColumn("step", F.lit(step))
        seen = written(seen.unionByName(fresh), "reached")
        frontier = seen.where(F.col("step") == step).select("id")
    return seen.where("step > 0").select(F.col("id").alias(key))


def stats(edges: DataFrame, **vertices: DataFrame) -> DataFrame:
    """One row: edges, and the number of each kind of vertices given."""
    counts = edges.agg(F.count("*").alias("edges"))
    for name, df in vertices.items():
        counts = counts.join(F.broadcast(df.agg(F.count("*").alias(name))), how="inner")
    return counts


def most_connected(edges: DataFrame, k: int = 10) -> DataFrame:
    """The files with most imports: file, imports; ties by id."""
    n = edges.where("kind = 'Imports'").groupBy(F.col("src.id").alias("file")).agg(F.countDistinct("dst.id").alias("imports"))
    return n.orderBy(F.desc("imports"), "file").limit(k)


def find_file(files: DataFrame, query: str, path: str = "path", key: str = "id") -> DataFrame:
    """The first file whose path is the query, or whose path or id ends with it; an exact path first."""
    hit = (F.col(path) == query) | F.col(path).endswith(query) | F.col(key).endswith(query)
    return files.where(hit).orderBy(F.desc(F.col(path) == query), path, key).limit(1)


def history(commits: DataFrame, edges: DataFrame, file: str, limit: int) -> DataFrame:
    """The latest commits that modify a file: hash, short_hash, author, date, message, total, rank."""
    hashes = edges.where((F.col("kind") == "Modifies") & (F.col("dst.id") == file)).select(F.col("src.id").alias("hash")).distinct()
    rows = commits.join(hashes, "hash", "left_semi")
    order = [F.desc("timestamp"), F.asc("hash")]
    total = rows.agg(F.count("*").alias("total"))
    top = rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return top.join(F.broadcast(total), how="inner").select(
        "hash", F.substring("hash", 1, 7).alias("short_hash"), "author", F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm").alias("date"), "message", "total", "rank"
    )


def commit_files(edges: DataFrame, files: DataFrame, commit: str) -> DataFrame:
    """The known files a commit modifies."""
    ids = edges.where((F.col("kind") == "Modifies") & (F.col("src.id") == commit)).select(F.col("dst.id").alias("id")).distinct()
    return files.join(ids, "id", "left_semi")
