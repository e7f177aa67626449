"""Importance resampling against brute force: nulls, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievemill.llm import resample


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs(w, longest):
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, n=10_000, longest=1, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % n
    s = Counter(bucket(f) for _, t in rows for f in runs(words(t), longest))
    t = Counter(bucket(f) for x in target for f in runs(words(x), longest))
    total, aim = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + n) / ((s[b] + 1) * (aim + n))))
    out = []
    for d, x in rows:
        found = [gain(bucket(f)) for f in runs(words(x), longest)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(words(x)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[1]))
    for i, r in enumerate(may[: percent * len(may) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=str)


def docs_of(spark, rows):
    clash = {c: F.lit("clash") for c in ("n_words", "buckets", "score", "rank", "weight", "drawn", "part", "copies", "count", "total")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)


ROWS = [(i, " ".join(f"w{i * j % 37}" for j in range(i % 60))) for i in range(1, 150)]
ODD = [(200, None), (201, ""), (202, " .,- \n"), (203, "Ünï ÉCOLE naïve " * 9), (204, "x " * 30_000), (None, "alpha beta " * 12), (None, "gamma w1 w2 " * 12), (7, ROWS[6][1]), (50, ROWS[49][1]), (50, ROWS[49][1])]
TARGET = [None, "", "w1 w2 w3 w3 w3", "école W5 w5"]


@pytest.mark.parametrize("rows, target", [(ROWS + ODD, TARGET), (ROWS, []), ([(5, "a b " * 15)] * 40, TARGET), ([(1, None)], TARGET)])
def test_against_brute_force(spark, rows, target):
    aim = spark.createDataFrame([(t,) for t in target], "text string").withColumn("doc_id", F.lit(1))
    got = resample.ranked(resample.scored(docs_of(spark, rows), aim))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert got.columns == columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, target)


def test_longer_runs_and_other_parameters(spark):
    aim = spark.createDataFrame([(t,) for t in TARGET], "text string")
    rows = resample.scored(docs_of(spark, ROWS + ODD), aim, n=64, longest=3)
    got = resample.ranked(rows, least_words=5, percent=37)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS + ODD, TARGET, 64, 3, 5, 37)


def test_draw_keeps_all_columns(spark):
    aim = spark.createDataFrame([(t,) for t in TARGET], "text string")
    docs = docs_of(spark, ROWS)
    got = resample.draw(docs, aim)
    want = {r[0]: r[5] for r in brute(ROWS, TARGET) if r[5]}
    assert got.columns == [*docs.columns, "rank_"]
    assert {r["doc_id"]: r["rank_"] for r in got.collect()} == want


def test_empty(spark):
    none = docs_of(spark, ROWS).limit(0)
    assert resample.ranked(resample.scored(none, none)).count() == 0
    assert resample.draw(none, none).count() == 0


def test_scoring_explodes_nothing_and_shuffles_only_totals(spark):
    rows = resample.features(docs_of(spark, ROWS), "doc_id", "text")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "Python" not in plan
