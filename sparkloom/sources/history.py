"""Version-control output as tables: log, name-status and blame lines."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sparkloom.functions.text import file_id, repo_id

LOG_FORMAT = "%H|%an|%at|%s|%P"
_HEADER = "^[0-9a-fA-F]{40}\\|"
_BLAMED = "^[0-9a-f]{40} \\d+ (\\d+)"
#: Lines of a block; the table of all blocks has a row for each.
BLOCK = 1 << 16


def git_lines(spark: SparkSession, repo: str, *args: str) -> DataFrame:
    """line_no, line of a git command run by the driver."""
    out = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True, errors="replace").stdout
    return spark.createDataFrame(list(enumerate(out.split("\n"), 1)), "line_no long, line string")


def log(spark: SparkSession, repo: str, limit: int, path: str | None = None) -> DataFrame:
    """The latest commits, or those of one file with its renames."""
    extra = ["--follow", "--", path] if path else []
    return parse_log(git_lines(spark, repo, "log", f"-{limit}", f"--format={LOG_FORMAT}", "--name-only", *extra))


def in_repo(commits: DataFrame, repo: str) -> DataFrame:
    """parse_log()'s commits with repo_id, and their files as ids of that repository's files."""
    key = repo_id(F.lit(repo))
    return commits.withColumn("repo_id", key).withColumn("files_modified", F.transform("files_modified", lambda x: file_id(F.col("repo_id"), x)))


def _earlier() -> WindowSpec:
    """All rows before one in a table of blocks, which is small enough for one task."""
    return Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, block: Column, *order: str) -> DataFrame:
    """rows with line_no, their place by block and order from 1 on; blocks are numbered apart and moved by the rows before."""
    rows = rows.withColumn("_block", block)
    blocks = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return rows.withColumn("line_no", place).join(blocks, "_block").withColumn("line_no", F.col("line_no") + F.col("_before")).drop("_block", "_before")


def parse_log(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """hash, author, timestamp, message, parent_hashes, files_modified. A '|' in author or subject shifts fields.

    The running number of headers groups the lines of a commit: it is counted within blocks of line numbers and
    carried from block to block.
    """
    header = F.col("line").rlike(_HEADER)
    lines = lines.withColumn("_block", F.floor(F.col("line_no") / block))
    blocks = lines.groupBy("_block").agg(F.sum(header.cast("int")).alias("_n"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)).alias("_before"))
    own = F.sum(header.cast("int")).over(Window.partitionBy("_block").orderBy("line_no"))
    grouped = lines.withColumn("commit", own).join(blocks, "_block").withColumn("commit", F.col("commit") + F.col("_before"))
    f = F.split(F.max(F.when(header, F.col("line"))), "\\|")
    part = lambda i: F.get(f, i)
    names = F.sort_array(F.collect_list(F.when(~header & (F.trim("line") != ""), F.struct("line_no", "line"))))
    return (
        grouped.where("commit > 0")
        .groupBy("commit")
        .agg(
            F.get(f, F.lit(0)).alias("hash"),
            part(1).alias("author"),
            F.coalesce(part(2).try_cast("long"), F.lit(0)).alias("timestamp"),
            F.coalesce(part(3), F.lit("")).alias("message"),
            F.array_remove(F.split(F.coalesce(part(4), F.lit("")), " "), "").alias("parent_hashes"),
            F.transform(names, lambda x: x["line"]).alias("files_modified"),
        )
        .drop("commit")
    )


def parse_name_status(lines: DataFrame) -> DataFrame:
    """status (A, M, D, R), path, old_path; a rename's path is the new one."""
    f = F.split("line", "\t")
    status = F.substring(F.get(f, F.lit(0)), 1, 1)
    renamed = status == "R"
    return lines.where(F.trim("line") != "").select(
        status.alias("status"),
        F.when(renamed, F.get(f, F.lit(2))).otherwise(F.get(f, F.lit(1))).alias("path"),
        F.when(renamed, F.get(f, F.lit(1))).alias("old_path"),
    )


def changed_since(spark: SparkSession, repo: str, ref: str) -> DataFrame:
    return parse_name_status(git_lines(spark, repo, "diff", "--name-status", ref)).select("path")


def parse_blame(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """line_number, commit_hash, author, timestamp, content of porcelain lines; headers fill forward within blocks of
    line numbers and from block to block, and a commit's author and time, which appear once, hold for its later lines.

    Lines are dealt by block once, for the last header of each block and for filling; of what is then dealt by commit, only
    lines with an author, a time or a content are left.
    """
    found = F.when(F.col("line").rlike(_BLAMED), F.struct(F.substring("line", 1, 40).alias("hash"), F.regexp_extract("line", _BLAMED, 1).cast("long").alias("number")))
    lines = lines.select("line_no", "line", F.floor(F.col("line_no") / block).alias("_block"))
    lines = lines.where("_block IS NOT NULL").repartition("_block").withColumn("_head", found)
    blocks = lines.groupBy("_block").agg(F.max_by("_head", F.when(F.col("_head").isNotNull(), F.col("line_no"))).alias("_head"))
    blocks = blocks.select("_block", F.last("_head", ignorenulls=True).over(_earlier()).alias("_before"))
    order = Window.partitionBy("_block").orderBy("line_no")
    lines = lines.withColumn("_head", F.last("_head", ignorenulls=True).over(order)).join(blocks, "_block").withColumn("_head", F.coalesce("_head", "_before"))
    value = lambda name: F.when(F.col("line").startswith(name + " "), F.substr("line", F.lit(len(name) + 2)))
    filled = lines.select(
        F.col("_head")["hash"].alias("commit_hash"),
        F.col("_head")["number"].alias("line_number"),
        value("author").alias("a"),
        value("author-time").alias("t"),
        F.when(F.col("line").startswith("\t"), F.substr("line", F.lit(2))).alias("content"),
    )
    per = Window.partitionBy("commit_hash")
    return (
        filled.where("a IS NOT NULL OR t IS NOT NULL OR content IS NOT NULL")
        .withColumns({"author": F.max("a").over(per), "timestamp": F.max("t").over(per).cast("long")})
        .where("content IS NOT NULL")
        .select("line_number", "commit_hash", "author", "timestamp", "content")
    )


def repo_info(repo: str) -> dict:
    """Root, branch, head, remote and number of tracked files; values are None where git has none."""

    def one(*args: str) -> str | None:
        out = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True)
        return out.stdout.strip() if out.returncode == 0 else None

    tracked = one("ls-files")
    return {
        "root": one("rev-parse", "--show-toplevel"),
        "branch": one("rev-parse", "--abbrev-ref", "HEAD"),
        "head": one("rev-parse", "HEAD"),
        "remote": one("remote", "get-url", "origin"),
        "tracked": None if tracked is None else len(tracked.splitlines()),
    }


def is_tracked(repo: str, path: str) -> bool:
    return subprocess.run(["git", "-C", repo, "ls-files", "--error-unmatch", path], capture_output=True).returncode == 0
