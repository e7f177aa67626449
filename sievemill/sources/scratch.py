"""Tables that operators write on the way: Parquet in the folder that driver and executors share.

Such a table cuts lineage and survives lost executors. Whoever runs several operators in turn may put each into a ``scope``
and drop what it left once its result is written; tables of other scopes, and of callers without one, are never touched.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_SCOPE: ContextVar[set[str] | None] = ContextVar("scratch_scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets one of its own (tests);
    on a cluster that is an error, as executors wouldn't see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="sievemill-"))
        named = _OWN[0]
    return named.rstrip("/")


@contextmanager
def scope() -> Iterator[set[str]]:
    """Paths made in here by this thread are in the set that it gives, and in no outer one."""
    made: set[str] = set()
    token = _SCOPE.set(made)
    try:
        yield made
    finally:
        _SCOPE.reset(token)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made = _SCOPE.get()
    if made is not None:
        made.add(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    made = _SCOPE.get()
    if made is not None:
        made.discard(path)


def sweep(spark: SparkSession, made: set[str], *keep: DataFrame) -> None:
    """Delete the tables of a scope, but for those in ``keep``."""
    for path in sorted(made - {df._stash_path for df in keep}):
        drop_path(spark, path)
        made.discard(path)


#: Rows and bytes that a plan hands to Python at once, so that what a worker holds doesn't grow with the table.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> Iterator[None]:
    """Plans made in here hand texts to Python in small batches, which bounds a worker's memory."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(most)}
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def written_by_python(df: DataFrame, name: str) -> DataFrame:
    """The same for rows that Python makes from whole texts, in small batches."""
    with small_batches(df.sparkSession):
        return written(df, name)
