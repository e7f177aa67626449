"""A content-addressed store of texts as a table (hash, content, stored_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY, MOST = 86_400, 1000


def content_hash(content: Column, source_context: Column | None = None) -> Column:
    """Hex SHA-256 of the content, with its source context's where given."""
    if source_context is None:
        return F.sha2(content, 256)
    return F.sha2(F.when(source_context.isNull(), content).otherwise(F.concat(content, F.lit(":source_context:"), source_context)), 256)


def bare_hash(h: Column) -> Column:
    return F.regexp_replace(h, r"\A(?:sha256:)+", "")


def put(store: DataFrame | None, texts: DataFrame, text_col: str = "text", at: str = "stored_at") -> DataFrame:
    """New rows to append: one for each content that the store lacks (or holds empty), the earliest of equal ones."""
    rows = texts.groupBy(content_hash(F.col(text_col)).alias("hash")).agg(F.first(text_col).alias("content"), F.min(at).alias("stored_at"))
    return rows if store is None else rows.join(store.filter("content <> ''").select("hash"), "hash", "left_anti")


def get(store: DataFrame, hashes: DataFrame, now: Column, seconds: int = DAY) -> DataFrame:
    """(hash, content) of what is there and not older than a day."""
    wanted = hashes.select(bare_hash(F.col("hash")).alias("hash")).distinct()
    age = now.cast("timestamp").cast("double") - F.col("stored_at").cast("timestamp").cast("double")
    return store.filter(age <= seconds).join(wanted, "hash", "left_semi").select("hash", "content")


def save_response(store: DataFrame, responses: DataFrame) -> DataFrame:
    """The store with responses (hash, content, stored_at) written over it: the latest for each key; of several with one
    time stamp, the one with the largest hash of its content, so that reruns agree."""
    both = store.select("hash", "content", "stored_at").unionByName(responses.select("hash", "content", "stored_at"))
    latest = F.max(F.struct("stored_at", F.sha2(F.coalesce("content", F.lit("")), 256), "content")).alias("r")
    return both.groupBy("hash").agg(latest).select("hash", "r.content", "r.stored_at")


def evict(store: DataFrame, now: Column, seconds: int = DAY, most: int = MOST) -> DataFrame:
    """What stays: entries not older than a day, of those the newest ``most`` (a top-k, ties by hash)."""
    age = now.cast("timestamp").cast("double") - F.col("stored_at").cast("timestamp").cast("double")
    return store.filter(age <= seconds).orderBy(F.col("stored_at").desc(), "hash").limit(most)


def newest_per(store: DataFrame, key: str, most: int) -> DataFrame:
    """The newest entries of each key, without a global sort."""
    order = Window.partitionBy(key).orderBy(F.col("stored_at").desc(), "hash")
    return store.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")
