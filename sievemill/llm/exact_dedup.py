"""Exact dedup by stateful streaming: keyed, disk-backed state that never expires.

Each row is reduced to (digest of the normalised text, code points of the original, stable identifier, content
locator) and landed in the shared folder. A Structured Streaming aggregation reads the landed files in
micro-batches; its RocksDB state store, on disk within a bound on memory, keeps, for every digest, the row that stays and the group's size. No watermark
is set, so no key expires, and a stream restarted on the same checkpoint carries on. On a hit (a digest with several
rows) the full normalised text of each row is compared with that of the row that stays; rows whose text differs, which
takes two texts with one SHA-256, are groups of their own, by the text itself.

Everything is DataFrame and SQL functions.

Null text counts as empty; a null id is larger than any other; empty and very long texts need nothing special; rows
that repeat wholly (same id and text) are one group of which one row stays: ``kept`` marks all of them when they are
indistinguishable in ``decisions``, and ``drop_duplicates`` returns one of them. An empty table gives an empty result.
Other columns are carried or ignored, never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import bounded_broadcast, documents, drop_path, fresh_path, stash, strip_ws, unused

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Landed files that one micro-batch takes at most.
FILES_PER_BATCH = 1000
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.minDeltasForSnapshot": "100",
    # a store takes 4 MB of disk beforehand otherwise, however little it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # all stores of an executor share one bound on memory outside the heap; the rest is on disk
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, points, id, locator); the locator is the hash that finds this very content again."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        digest_of(strip_ws(text)).alias("digest"),
        F.char_length(text).cast("long").alias("points"),
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("locator"),
    )


def winner() -> F.Column:
    """Most code points first, then the smallest id, then the smallest locator; null ids last."""
    return F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("locator"))


def stream_state(spark: SparkSession, landed: str, schema, state: str, checkpoint: str) -> DataFrame:
    """Run the stream over what has landed and not been read yet; the state's latest rows, one per digest.

    Called again with the same paths after more files have landed, it goes on from its state."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(landed)
        kept = rows.groupBy("digest").agg(F.min(winner()).alias("best"), F.count("*").alias("group_size"))

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{state}/batch={number}")

        query = kept.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    best = kept.schema["best"].dataType.simpleString()
    updates = spark.read.schema(f"digest binary, best {best}, group_size bigint, batch int").parquet(state)
    if updates.inputFiles() and len({f.rsplit("/", 2)[-2] for f in updates.inputFiles()}) > 1:
        updates = updates.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("u")).select("digest", "u.*")
    return updates.select("digest", F.col("best.id").alias("keep_id"), F.col("best.locator").alias("keep_locator"), "group_size")


def state_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(landed digests, final state) of a whole table."""
    spark = docs.sparkSession
    landed = stash(digests(docs, id_col, text_col), "landed")
    state, checkpoint = fresh_path(spark, "state"), fresh_path(spark, "stream")
    rows = stream_state(spark, landed._stash_path, landed.schema, state, checkpoint)
    drop_path(spark, checkpoint)
    return landed, rows


def differing(docs: DataFrame, state: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Full check of bytes: (id, locator, digest, norm) of rows whose normalised text isn't that of the row that stays.

    Only rows of groups of two or more are moved, and a group's text to compare with is fetched once, by (id, locator) of
    the row that stays; a skewed group is split by the adaptive join. A digest of 256 bits makes this empty in practice."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("locator"), strip_ws(text).alias("norm"))
    several = stash(state.filter("group_size > 1").select("digest", "keep_id", "keep_locator"), "several")
    stays = bounded_broadcast(several.select(F.col("keep_id").alias("id"), F.col("keep_locator").alias("locator"), F.col("digest").alias("of")))
    kept = rows.join(stays, rows["id"].eqNullSafe(stays["id"]) & (rows["locator"] == stays["locator"])).groupBy("of").agg(F.min("norm").alias("keep_norm"))
    kept = stash(kept, "stays")  # written first, so that the join below can split a group of very many rows
    members = rows.withColumn("digest", digest_of(F.col("norm"))).join(bounded_broadcast(several), "digest")
    others = members.filter(~(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("locator") == F.col("keep_locator"))))
    return others.join(kept, others["digest"] == kept["of"]).filter("norm <> keep_norm").select("id", "locator", "digest", "norm")


KEY = ("digest", "keep_id", "keep_locator", "group_size")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, locator."""
    landed, state = state_of(docs, id_col, text_col)
    state = stash(state, "kept")
    clash = stash(differing(docs, state, id_col, text_col), "clash")
    out = landed.select("id", "locator", "digest").join(state, "digest")
    if not clash.isEmpty():
        out = parted(out, landed, clash)
    return out.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("locator") == F.col("keep_locator"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "locator",
    )


def parted(out: DataFrame, landed: DataFrame, clash: DataFrame) -> DataFrame:
    """Rows whose digest another text has: groups of their own, by the normalised text itself."""
    odd = clash.distinct()
    ours = landed.join(odd.select(F.col("id").alias("_i"), F.col("locator").alias("_l"), "norm"), F.col("id").eqNullSafe(F.col("_i")) & (F.col("locator") == F.col("_l")))
    groups = ours.groupBy("norm").agg(F.min(winner()).alias("best"), F.count("*").alias("group_size"))
    own = ours.select("id", "locator", "digest", "norm").join(groups, "norm").select("id", "locator", "digest", F.col("best.id").alias("keep_id"), F.col("best.locator").alias("keep_locator"), "group_size")
    less = ours.groupBy("digest").agg(F.count("*").alias("less"))
    rest = out.join(odd.select(F.col("id").alias("_i"), F.col("locator").alias("_l")), F.col("id").eqNullSafe(F.col("_i")) & (F.col("locator") == F.col("_l")), "left_anti")
    rest = rest.join(less, "digest", "left").withColumn("group_size", F.col("group_size") - F.coalesce("less", F.lit(0)))
    cols = ["id", "locator", *KEY]
    return rest.select(cols).unionByName(own.select(cols))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, one of each group. Texts aren't moved where few rows go."""
    found = stash(decisions(docs, id_col, text_col).select("doc_id", "locator", "kept"), "decided")
    rows = found.groupBy("doc_id", "locator").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    special = stash(rows.filter("not kept or n > 1").select(F.struct("doc_id", "locator", "kept").alias(unused(docs, "row"))), "special")
    (name,) = special.columns
    locator = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    same = lambda df: docs[id_col].eqNullSafe(df[name]["doc_id"]) & (locator == df[name]["locator"])
    special, again = bounded_broadcast(special), bounded_broadcast(special.filter(F.col(name)["kept"]))
    once = docs.join(special, same(special), "left_anti")
    several = docs.join(again, same(again), "left_semi")
    order = F.concat_ws("\x00", *[F.col(f"`{c}`").cast("string") for c in docs.columns if c not in (id_col, text_col)], F.lit(""))
    one = several.groupBy(F.col(id_col).alias("i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("l")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("r"))
    return once.unionByName(one.select("r.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(documents(spark, sf_dir)).drop("locator")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d)
"""
