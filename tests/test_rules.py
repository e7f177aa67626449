"""Custom noise rules from a table, by one automaton."""

import time

import pytest
from pyspark.sql import functions as F

from sievemill.functions import noise

LINES = ["at com.Acme.Kit", "ORDER placed", "é Straße", "nothing", "", None, "order kit order", "x" * 50]


@pytest.mark.parametrize("most_bytes", [1, 12, 1 << 20])
def test_first_rule_is_that_of_plain_search(spark, most_bytes):
    rules = [(5, "order"), (2, "KIT"), (9, "acme"), (1, None), (0, ""), (7, "straße"), (3, "rder k"), (4, "kit"), (None, "nothing")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "id int, line string")
    got = noise.first_rules(df, "line", spark.createDataFrame(rules, "rule long, pattern string"), "first", most_bytes)
    want = {i: None if x is None else min((n for n, p in rules if p and n is not None and p.lower() in x.lower()), default=None) for i, x in enumerate(LINES)}
    assert {r["id"]: r["first"] for r in got.collect()} == want
    plain = df.select("id", F.col("line").isNotNull() & noise.is_noise(F.col("line"), [p for _, p in rules if p and p != "nothing"]))
    assert {i for i, x in plain.collect() if x} >= {i for i, n in want.items() if n is not None}


def test_no_rules(spark):
    df = spark.createDataFrame([("a",)], "line string")
    assert noise.first_rules(df, "line", spark.createDataFrame([], "rule long, pattern string")).first()["rule"] is None


def test_time_hardly_depends_on_the_number_of_rules(spark):
    lines = spark.range(60_000, numPartitions=4).select(F.concat_ws(" ", F.md5(F.col("id").cast("string")), F.md5((-F.col("id")).cast("string"))).alias("line")).cache()
    lines.count()

    def took(n):
        rules = spark.range(n).select(F.col("id").alias("rule"), F.concat(F.lit("pkg/"), F.sha2(F.col("id").cast("string"), 256)).alias("pattern"))
        best = float("inf")
        for _ in range(2):
            df = noise.first_rules(lines, "line", rules)
            began = time.time()
            assert df.filter("rule is not null").count() == 0
            best = min(best, time.time() - began)
        return best

    assert took(10_000) < 4 * took(10) + 2
