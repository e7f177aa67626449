"""Logs as rows of lines give what whole texts give, wherever blocks begin."""

import random

import pytest
from pyspark.sql import functions as F

from sievemill.functions import noise, redaction
from sievemill.operators import line_logs, ordered

LOG = "\n".join([
    "panic: x", "", "goroutine 1 [running]:", "main.load(0x1)", "runtime.goexit()", "", "goroutine 7 [GC sweep wait]:", "a(0x2)", "   ", "created by x", "", "tail",
    "goroutine 8 [select (no cases)]:", "b()", "goroutine 9 [running]:", "c()", "at org.hibernate.x", "  goroutine 3 [finalizer wait]:", "d", "e", "f",
])
TEXTS = [LOG, "", "\n", "\n\n", "one\r\ntwo\r\n", LOG + "\n" + LOG, "/srv/node_modules/a/b\nok\n", None, "last\n   \n"]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("block", [1, 2, 3, 7, 20_000])
def test_pruning_equals_that_of_whole_texts(spark, block):
    docs = docs_of(spark, TEXTS)
    rows = line_logs.line_rows(docs).withColumn("idle", F.lit("clash"))
    kept = {}
    for r in line_logs.pruned_lines(rows, ["ONE"], block).collect():
        kept.setdefault(r["file"], []).append((r["pos"], r["line"]))
    sums = {r["file"]: (r["dropped"], r["summary"]) for r in line_logs.prune_report(line_logs.judged(rows, ["ONE"], block)).collect()}
    want = docs.select("doc_id", noise.pruned(F.col("text"), ["ONE"]).alias("p")).select("doc_id", "p.*", noise.summary(F.col("p.dropped"), F.col("p.categories")).alias("s")).collect()
    for r in want:
        assert "\n".join(x for _, x in sorted(kept.get(r["doc_id"], []))) == (r["kept"] or "")
        if r["doc_id"] in sums:
            assert sums[r["doc_id"]] == (r["dropped"], r["s"])


PIECES = [
    "plain line", "", "   ", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "a -----BEGIN PRIVATE KEY----- b", "c -----END PRIVATE KEY----- d",
    "x -----BEGIN PRIVATE KEY-----k-----END PRIVATE KEY----- y -----BEGIN EC PRIVATE KEY-----", "z -----END PRIVATE KEY----- -----BEGIN PRIVATE KEY----- q", "MIIE", "db_password:", "token", " = ", "\"hunter2222\"",
    "abcdefghijklmnop", "Authorization:", "  Bearer", "tok.en-part", "aws_secret_key =", "Ab1/" * 10, "secret: 'quoted value'", "ghp_" + "a1B2" * 9, "api_key=abcdefghijkl", "password\r", "kwargs: token:\r", "AKIA" + "A1B2" * 4, "sk-" + "z9" * 14 + "-----BEGIN PRIVATE KEY-----",
]


@pytest.mark.parametrize("block", [1, 4, 20_000])
def test_masking_equals_that_of_whole_texts(spark, block):
    rng = random.Random(block)
    texts = ["\n".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    texts += ["", "\n", "-----BEGIN PRIVATE KEY-----\n" + "MIIE\n" * 500, "-----BEGIN PRIVATE KEY-----\n" + "MIIE\n" * 500 + "-----END PRIVATE KEY-----"]
    docs = docs_of(spark, texts)
    got = {}
    for r in line_logs.redacted_lines(line_logs.raw_rows(docs), [("plain", "<P>")], block).collect():
        got.setdefault(r["file"], []).append((r["pos"], r["line"]))
    want = {r["doc_id"]: r["t"] for r in docs.select("doc_id", redaction.redact(F.col("text"), [("plain", "<P>")]).alias("t")).collect()}
    assert {f: "\n".join(x for _, x in sorted(rows)) for f, rows in got.items()} == want


def test_no_row_holds_a_long_key(spark):
    rows = spark.range(5000).select(F.lit("f").alias("file"), F.col("id").alias("pos"), F.when(F.col("id") == 10, "-----BEGIN PRIVATE KEY-----").when(F.col("id") == 4990, "-----END PRIVATE KEY-----").otherwise("MIIE" * 20).alias("line"))
    got = line_logs.redacted_lines(rows, block=100).orderBy("pos").collect()
    assert [r["pos"] for r in got] == [*range(11), *range(4991, 5000)]
    assert got[10]["line"] == "[PRIVATE_KEY_REDACTED]"


def test_null_lines_and_files(spark):
    rows = spark.createDataFrame([(None, 0, "goroutine 1 [finalizer wait]:"), (None, 1, None), (None, 2, "x"), ("a", 0, "x")], "file string, pos long, line string")
    got = {(r["file"], r["pos"]): r["category"] for r in line_logs.judged(rows, block=1).collect()}
    assert got == {(None, 0): "go:idle_goroutines", (None, 1): None, (None, 2): "go:idle_goroutines", ("a", 0): None}
    assert line_logs.redacted_lines(rows).count() == 4
    assert line_logs.judged(rows.limit(0)).count() == 0 and line_logs.redacted_lines(rows.limit(0)).count() == 0


def test_prefix_sums_over_ranges(spark):
    rows = [(i * 7 % 101, i % 5) for i in range(101)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = sorted((r["k"], r["s"]) for r in ordered.prefix_sum(df, [F.col("k").desc()], F.col("v"), "s").collect())
    assert got == [(k, sum(v for j, v in rows if j > k)) for k, _ in sorted(rows)]
    assert ordered.prefix_sum(df.limit(0), [F.col("k")], F.col("v"), "s").count() == 0
