"""Helpers that the operators share: the shared folder, stashed tables, row keys, ASCII folding."""

from __future__ import annotations

import ctypes
import gc
import sys
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.sources.scratch import drop_path, fresh_path, small_batches, written  # noqa: F401 (fresh_path is used by other modules)
from sievemill.sources.tables import texts

#: The ASCII white space that separates words, as a Java character class.
WS = "[\\x20\\x09-\\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    with small_batches(spark):
        return _stash(df, name)


def _stash(df: DataFrame, name: str) -> DataFrame:
    out = written(df, name)
    release(df.sparkSession)
    return out


def drop_stash(df: DataFrame) -> None:
    """Delete a stashed table's files once nothing reads it any more."""
    drop_path(df.sparkSession, df._stash_path)


#: Tables of up to so many rows, each a few numbers wide, may be sent to every task.
MOST_SENT = 1_000_000


def bounded_broadcast(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """df, marked to be sent to every task if it has at most ``most`` rows; else as it is, for a join by exchange."""
    few = df.limit(most + 1).count() <= most
    return F.broadcast(df) if few else df.hint("shuffle_hash")


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def release(spark: SparkSession) -> None:
    """Let the context cleaner delete shuffle files of finished steps, and give the driver's freed memory back. With all in
    one local JVM there is no driver to keep small, and a collection would stop the tasks."""
    if spark.sparkContext.master.startswith("local["):
        return
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, text): th tells rows apart that share an id. Null text becomes empty; other columns go.

    Rows with the same id and the same text have the same result, so one key may stand for several rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), text.alias("text"))


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. lower() equals that on pure ASCII and is much faster there."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def strip_ws(text: Column) -> Column:
    return F.regexp_replace(text, WS + "+", "")


def n_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
