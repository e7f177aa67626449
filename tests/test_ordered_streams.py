"""Streams that come out of order give what batches give, and forget keys that are idle."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sievemill.operators import traffic
from sievemill.streaming import chunks, ordered

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key string, id long, ts timestamp, tokens long"


def events(n=160):
    """In order of time, with ties; a last row, of a key of its own, that moves the watermark past all others."""
    rng = random.Random(3)
    rows, at = [], 0.0
    for i in range(n):
        at += rng.choice([0, 60, 400, 900, 2500])
        rows.append((f"k{rng.randrange(4)}", i, T0 + dt.timedelta(seconds=at), rng.randrange(1, 700)))
    return rows, [("end", n + i, rows[-1][2] + dt.timedelta(days=1 + i), 1) for i in range(3)]


def shuffled(rows, minutes=9):
    """Rows moved by less than the watermark's delay."""
    rng = random.Random(4)
    return sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=rng.uniform(0, minutes)))


def run(spark, tmp_path, rows, ends, make, per_file=13):
    src = tmp_path / "in"
    files = [rows[i : i + per_file] for i in range(0, len(rows), per_file)] + [[e] for e in ends]
    for i, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(src / f"{i:03d}"))
        for f in (src / f"{i:03d}").glob("*.parquet"):
            f.rename(src / f"{i:03d}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(src / "*.parquet"))
    name = "ordered_" + tmp_path.name.replace("-", "_")
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(280)
    states = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    return [r for r in spark.table(name).collect() if r["key"] != "end"], states


@pytest.fixture()
def stamped(tmp_path):
    """File sources take files by their time."""
    import os

    def touch():
        for i, f in enumerate(sorted((tmp_path / "in").glob("*.parquet"))):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))

    return touch


@pytest.mark.parametrize("kind", ["breaker", "cache"])
def test_stream_equals_batch(spark, tmp_path, kind):
    rows, ends = events()
    batch = spark.createDataFrame(rows, SCHEMA)
    if kind == "breaker":
        want = traffic.breaker(batch, "key", "ts", "id", "tokens", 900).select("key", F.col("order").alias("id"), "tokens", "admitted")
        make = lambda s: ordered.breaker_in_order(s, "key", "ts", "id", "tokens", 900)
    else:
        want = traffic.response_cache(batch.withColumnRenamed("id", "n"), "key", "ts", "n", 1200).select("key", F.col("n").alias("id"), "hit")
        make = lambda s: ordered.cache_in_order(s, "key", "ts", "id", 1200)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got, states = run(spark, tmp_path, shuffled(rows), ends, make)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))
    assert max(states) >= 4 and states[-1] <= 1


def test_chunks_out_of_order(spark, tmp_path):
    import json

    rng = random.Random(8)
    rows = []
    for s in range(6):
        n = rng.randrange(2, 12)
        for i in range(n):
            body = {"id": f"m{s}", "model": "x", "choices": [{"delta": {"content": f"w{i}"}, "finish_reason": "stop" if i == n - 1 and s != 5 else None}]}
            text = None if (s, i) == (1, 1) else "broken" if (s, i) == (2, 1) else json.dumps(body)
            rows.append((s, i, text, T0 + dt.timedelta(seconds=20 * s + i)))
    schema = "stream_id long, seq long, chunk string, ts timestamp"
    want = chunks.chunk_rows(spark.createDataFrame(rows, schema))
    mixed = rows + rows[:4]
    rng.shuffle(mixed)
    src = tmp_path / "in"
    for i in range(0, len(mixed), 5):
        spark.createDataFrame(mixed[i : i + 5], schema).coalesce(1).write.parquet(str(src / f"{i:03d}"))
    for i in range(3):
        spark.createDataFrame([(99, 0, None, T0 + dt.timedelta(days=1 + i))], schema).coalesce(1).write.parquet(str(src / f"9{i:02d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        q = chunks.chunk_stream(stream, "ts", late="1 hour").writeStream.format("memory").queryName("chunk_events").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(280)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = spark.table("chunk_events").filter("stream_id < 99").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1
