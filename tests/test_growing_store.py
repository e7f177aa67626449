"""A store that grows by merges holds what one batch gives, and rewrites only what changes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sievemill.operators import store
from sievemill.operators.growing_store import GrowingStore

T0 = dt.datetime(2024, 1, 1)


def rows_of(spark, pairs):
    df = spark.createDataFrame([(c, T0 + dt.timedelta(hours=h)) for c, h in pairs], "content string, stored_at timestamp")
    return df.select(F.sha2("content", 256).alias("hash"), "content", "stored_at")


def test_merges_equal_one_batch(spark, tmp_path):
    s = GrowingStore(spark, f"file://{tmp_path}/s", digits=1, newest=5)
    a, b = rows_of(spark, [(f"t{i}", i) for i in range(12)]), rows_of(spark, [(f"t{i}", 30 - i) for i in range(8, 16)])
    assert s.rows().count() == 0 and s.merge(a.limit(0)) == []
    first = s.merge(a)
    before = s.manifest()
    touched = s.merge(b)
    after = s.manifest()
    assert set(first) == set(before) and {k for k in before if before[k] != after[k]} <= set(touched)
    assert [k for k in before if k not in touched] and all(after[k] == before[k] for k in before if k not in touched)
    want = store.save_response(a, b)
    assert sorted(map(tuple, s.rows().collect())) == sorted(map(tuple, want.collect()))
    now = F.lit(T0 + dt.timedelta(hours=31))
    top = store.evict(want, now, store.DAY, 5)
    assert [r["hash"] for r in s.newest_entries(now).collect()] == [r["hash"] for r in top.collect()]
    s.evict(now)
    assert sorted(map(tuple, s.rows().collect())) == sorted(map(tuple, top.collect()))
    dead = s.vacuum()
    assert dead and sorted(map(tuple, s.rows().collect())) == sorted(map(tuple, top.collect()))
    assert s.evict(now) == []


def test_ties_do_not_depend_on_order(spark, tmp_path):
    rows = [("h1", c, T0) for c in ("a", "b", "c")] + [("h1", None, T0), ("h2", "x", None), (None, "y", T0)]
    schema = "hash string, content string, stored_at timestamp"
    kept = set()
    for i, order in enumerate([rows, rows[::-1], rows[2:] + rows[:2]]):
        s = GrowingStore(spark, f"file://{tmp_path}/t{i}")
        for r in order:
            s.merge(spark.createDataFrame([r], schema))
        kept.add(tuple(sorted(map(tuple, s.rows().select("hash", "content").collect()))))
        whole = spark.createDataFrame([r for r in order if r[0] == "h1"], schema)
        assert store.save_response(whole.limit(0), whole).first()["content"] == dict(s.rows().select("hash", "content").collect())["h1"]
    assert len(kept) == 1


def test_a_change_that_fails_leaves_the_old_store(spark, tmp_path):
    s = GrowingStore(spark, f"file://{tmp_path}/f")
    s.merge(rows_of(spark, [("a", 1)]))
    with pytest.raises(Exception, match="no"):
        s.merge(rows_of(spark, [("b", 2)]).withColumn("content", F.expr("raise_error('no')")))
    assert [r["content"] for r in s.rows().collect()] == ["a"]
