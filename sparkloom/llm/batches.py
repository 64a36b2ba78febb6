"""Arrow batches cut to a bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import written


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The rows of batches, in order, in slices of about `most` bytes of a string column (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # the worker process goes on to other tasks


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds what one Arrow batch holds, in rows and bytes, for the jobs that run inside; the session's own limits
    come back after it."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def numbered(docs: DataFrame, key: str = "doc_id", name: str = "_rid") -> DataFrame:
    """docs with a long column `name` that tells its rows apart and is the same whenever docs is read.

    That is the key itself where it is an integer without nulls and repetitions, which one aggregation shows. If not,
    the rows are numbered by place in a copy written once, since places depend on how many executors there are.
    """
    docs = docs.drop(name)
    if key in docs.columns and docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        own = docs.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
        most, nulls = own.agg(F.max("n"), F.count_if(F.col("k").isNull())).first()
        if most in (None, 1) and not nulls:
            return docs.withColumn(name, F.col(key).cast("long"))
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
