"""A content-addressed store that grows: rows (hash, content, stored_at) in buckets by the hash's first digits.

A folder holds one folder of Parquet for each version of a bucket, and manifests, which say which version of each bucket
counts. A change reads and rewrites the buckets that its rows fall into, writes the others' versions down again unread,
and ends with a new manifest, put in place by one rename: readers see the store before or after a change, never between,
and a change that fails leaves the old one. Next to each bucket's version stand its newest entries, so that the newest of
the whole store are found from these lists alone.

Of several contents for a hash the latest stays; of equally late ones the one with the larger SHA-256, whatever their order.
One writer at a time. Null hashes are not stored; null times are earlier than all others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemill.operators.store import DAY, MOST
from sievemill.sources.scratch import written

#: Hexadecimal digits of the hash that name its bucket: 256 buckets.
DIGITS = 2


class GrowingStore:
    def __init__(self, spark: SparkSession, root: str, digits: int = DIGITS, newest: int = MOST) -> None:
        self.spark, self.root, self.digits, self.newest = spark, root.rstrip("/"), digits, newest

    # Manifests

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _manifests(self) -> list[int]:
        fs, path = self._path("manifests")
        if not fs.exists(path):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit())

    def manifest(self) -> dict[str, str]:
        """Version of each bucket that there is."""
        known = self._manifests()
        if not known:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{known[-1]}", wholetext=True).first()[0])

    def _publish(self, found: dict[str, str]) -> None:
        number = (self._manifests() or [-1])[-1] + 1
        draft = f"drafts/{uuid.uuid4().hex}"
        fs, path = self._path(draft)
        out = fs.create(path)
        out.write(bytearray(json.dumps(found, sort_keys=True).encode()))
        out.close()
        fs.mkdirs(self._path("manifests")[1])
        if not fs.rename(path, self._path(f"manifests/{number}")[1]):
            raise OSError(f"manifest {number} is there already: another writer was faster")

    # Rows

    def _read(self, kind: str, found: dict[str, str], schema: str) -> DataFrame:
        paths = [f"{self.root}/{v}/{kind}/bucket={b}" for b, v in sorted(found.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self, buckets: set[str] | None = None) -> DataFrame:
        """(hash, content, stored_at), of some buckets or of all."""
        found = {b: v for b, v in self.manifest().items() if buckets is None or b in buckets}
        return self._read("rows", found, "hash string, content string, stored_at timestamp")

    def bucket_of(self, h: Column) -> Column:
        return F.lower(F.substring(h, 1, self.digits))

    def merge(self, new: DataFrame) -> list[str]:
        """Takes rows in; gives the buckets that were rewritten."""
        new = written(new.filter("hash is not null").select("hash", "content", F.col("stored_at").cast("timestamp").alias("stored_at")), "new-rows")
        touched = sorted(r[0] for r in new.select(self.bucket_of(F.col("hash"))).distinct().collect())
        return self._rewritten(self.rows(set(touched)).unionByName(new), touched) if touched else []

    def _rewritten(self, rows: DataFrame, touched: list[str]) -> list[str]:
        version = uuid.uuid4().hex
        order = F.struct("stored_at", F.sha2(F.coalesce("content", F.lit("")), 256), "content")
        latest = rows.groupBy("hash").agg(F.max(order).alias("r")).select("hash", "r.content", "r.stored_at", self.bucket_of(F.col("hash")).alias("bucket"))
        latest.write.partitionBy("bucket").parquet(f"{self.root}/{version}/rows")
        stored = self.spark.read.schema("hash string, stored_at timestamp, bucket string").parquet(f"{self.root}/{version}/rows")
        best = Window.partitionBy("bucket").orderBy(F.col("stored_at").desc_nulls_last(), "hash")
        top = stored.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= self.newest).drop("n")
        top.write.partitionBy("bucket").parquet(f"{self.root}/{version}/newest")
        self._publish(self.manifest() | dict.fromkeys(touched, version))
        return touched

    def newest_entries(self, now: Column, seconds: int = DAY) -> DataFrame:
        """(hash, stored_at): entries not older than a day, of those the newest, from the buckets' lists alone."""
        age = now.cast("timestamp").cast("double") - F.col("stored_at").cast("double")
        lists = self._read("newest", self.manifest(), "hash string, stored_at timestamp")
        return lists.filter(age <= seconds).orderBy(F.col("stored_at").desc(), "hash").limit(self.newest)

    def evict(self, now: Column, seconds: int = DAY) -> list[str]:
        """Keeps the newest entries only; gives the buckets that lost some."""
        stay = written(self.newest_entries(now, seconds).select("hash"), "stay")
        gone = self.rows().select("hash").join(stay, "hash", "left_anti").select(self.bucket_of(F.col("hash")).alias("b")).distinct()
        touched = sorted(r["b"] for r in gone.collect())
        if not touched:
            return []
        left = self.rows(set(touched)).join(stay, "hash", "left_semi")
        still = sorted(r[0] for r in left.select(self.bucket_of(F.col("hash"))).distinct().collect())
        if still:
            self._rewritten(left, still)
        emptied = set(touched) - set(still)
        if emptied:
            self._publish({b: v for b, v in self.manifest().items() if b not in emptied})
        return touched

    def vacuum(self) -> list[str]:
        """Deletes versions that the last manifest doesn't name, and older manifests; gives the versions."""
        used, known = set(self.manifest().values()), self._manifests()
        fs, root = self._path("")
        dead = [f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory() and f.getPath().getName() not in used | {"manifests"}]
        for name in [*dead, *(f"manifests/{n}" for n in known[:-1])]:
            fs.delete(self._path(name)[1], True)
        return [d for d in dead if d != "drafts"]
