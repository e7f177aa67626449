"""Operators that split hot keys and long logs give what the plain ones give."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievemill.operators import context, skew, traffic

T0 = dt.datetime(2024, 1, 1)


def log_of(spark, n, keys, seed=1, step=40):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 1, step, 3 * step])
        rows.append((i, f"k{min(int(rng.expovariate(1) * keys / 4), keys)}", T0 + dt.timedelta(seconds=at), rng.randrange(100)))
    return spark.createDataFrame(rows, "id long, key string, ts timestamp, tokens long"), rows


@pytest.mark.parametrize("seconds, most, keys, replayed", [(300, 7, 30, 40), (5000, 3, 5, 25), (100, 1000, 50, 60), (10**6, 5, 400, 30)])
def test_shared_hits(spark, seconds, most, keys, replayed):
    log, rows = log_of(spark, 300, keys)
    frame = pd.DataFrame({"key": [r[1] for r in rows], "at": [(r[2] - T0).total_seconds() for r in rows]})
    want = dict(zip((r[0] for r in rows), traffic.shared_cache(frame, seconds, most).tolist(), strict=True))
    got = {r["id"]: r["hit"] for r in traffic.shared_hits(log, "key", "ts", "id", seconds, most, replayed).collect()}
    assert got == want
    if most == 7:
        assert traffic.shared_hits(log.limit(0), "key", "ts", "id").count() == 0


def test_rolling_total(spark):
    log, rows = log_of(spark, 300, 6, step=700)
    log = log.unionByName(spark.createDataFrame([(900, None, T0, 5), (901, "k1", None, 5)], log.schema))
    plain = {r["id"]: r["hourly_tokens"] for r in traffic.rolling_sum(log.filter("ts is not null and key is not null"), "key", "ts", "tokens").collect()}
    got = {r["id"]: r["hourly_tokens"] for r in traffic.rolling_total(log, "ts", "tokens", "key").collect()}
    assert got == plain | {900: None, 901: None}
    timed = log.filter("ts is not null")
    plain = {r["id"]: r["hourly_tokens"] for r in traffic.rolling_sum(timed.withColumn("one", F.lit(1)), "one", "ts", "tokens").collect()}
    assert {r["id"]: r["hourly_tokens"] for r in traffic.rolling_total(timed, "ts", "tokens").collect()} == plain
    assert traffic.rolling_total(log.limit(0), "ts", "tokens").count() == 0


def test_join_unique(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [(f"c{i}", i) for i in range(20)] + [(None, 1), ("alone", 2)], "k string, n long")
    unique = rows.filter("k <> 'alone'").groupBy("k").agg(F.count("*").alias("w"), F.max("n").alias("most"))
    got = skew.join_unique(rows, unique, ["k"], "w", 72, share=4)
    assert sorted(map(tuple, got.select("k", "n", "most").collect())) == sorted(map(tuple, rows.join(unique.drop("w"), "k").collect()))


@pytest.mark.parametrize("size", [0, 1, 2, 5])
@pytest.mark.parametrize("root", [None, "/srv/app"])
def test_binned_windows(spark, size, root):
    rng = random.Random(size)
    paths = ["/srv/app/a.py", "/srv/app/../b.py", "c/d.rs", "/etc/e.js", "empty.py", "missing.py"]
    found = spark.createDataFrame([(i, p, rng.choice(paths), rng.randrange(0, 30)) for i in range(40) for p in range(3)] + [(99, 0, paths[0], 7)] * 30, "id long, pos int, path string, line long")
    sources = spark.createDataFrame([(p, "\n".join(f"{p} {i}" for i in range(rng.randrange(3, 25)))) for p in paths[:4]] + [("empty.py", "")], "path string, text string")
    plain = context.windows(found.filter(context.inside(F.col("path"), root)) if root else found, sources, size)
    got = context.windows_binned(found, context.source_lines(sources), size, root)
    assert got.columns == plain.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    both = [context.contexts(found, sources, size, root), context.put_together(got)]
    assert sorted(map(str, both[0].collect())) == sorted(map(str, both[1].collect()))


def test_python_gets_small_batches_and_settings_stay(spark):
    from pyspark.sql import functions as F

    from sievemill.sources import scratch

    @F.pandas_udf("long")
    def size(x):
        return x * 0 + len(x)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = scratch.written_by_python(spark.range(0, 5000, 1, 1).select("id", size("id").alias("n")), "sizes")
    assert rows.count() == 5000
    assert rows.agg(F.max("n")).first()[0] <= scratch.BATCH_ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


@pytest.mark.parametrize("name", ["context_rooted", "context_binned", "context_text", "context_window", "files_in_context", "files_missing"])
def test_frames_are_found_once(spark, sf, name):
    """Frames are written before the steps that read them, so no step searches the logs again."""
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "RegExpExtractAll" not in plan


def test_lines_are_read_once(spark):
    text = "\n".join(f"line {i}" for i in range(20))
    found = spark.createDataFrame([(i, 0, "hot.py" if i % 2 else f"{i}.py", i % 25) for i in range(60)], "id long, pos int, path string, line long")
    sources = spark.createDataFrame([("hot.py", text), ("empty.py", ""), *((f"{i}.py", text) for i in range(0, 60, 2))], "path string, text string")
    lines, read = context.source_lines(sources), spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    got = context.windows_binned(found, lines.mapInPandas(counted, lines.schema), 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, context.windows(found, sources, 2).collect()))
    assert read.value == lines.count()
