"""Operators that no query runs: bounded files, request lines as a stream, streams of texts and counters, project kinds."""

import datetime as dt

from pyspark.sql import functions as F

from sievemill.functions import bodies, noise, patch, redaction
from sievemill.operators import audit, context
from sievemill.sources import text as sources
from sievemill.streaming import gateway


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_bounded_files(spark, tmp_path):
    root = tmp_path / "root"
    (root / "a").mkdir(parents=True)
    (root / "a" / "x.py").write_text("é = 1\n")
    (root / "big.py").write_text("x" * 101)
    (tmp_path / "rootless").mkdir()
    (tmp_path / "rootless" / "y.py").write_text("y")
    got = context.bounded_files(spark, f"{tmp_path}/*/{{a/x.py,big.py,y.py}}", str(root), 100).collect()
    assert [(r["path"].removeprefix(str(tmp_path)), r["text"]) for r in got] == [("/root/a/x.py", "é = 1\n")]


def test_streams_of_texts_and_counters(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"token=abcdefghij{i}\nat org.hibernate.x\nkept", t0 + dt.timedelta(seconds=40 * i), 100 * i, 50 * i) for i in range(6)]
    batch = spark.createDataFrame(rows, "text string, ts timestamp, raw long, clean long")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = run(gateway.clean_stream(stream), "cleaned").select("text", "clean").distinct().collect()
    want = batch.select("text", noise.pruned(redaction.redact(F.col("text")))["kept"].alias("k")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    sums = run(gateway.windowed_counters(stream), "counted", "complete").collect()
    assert sorted((r["window"]["start"], r["requests"], r["raw"], r["clean"]) for r in sums) == [(t0 + dt.timedelta(minutes=m), n, a, a // 2) for m, n, a in ((0, 2, 100), (1, 1, 200), (2, 2, 700), (3, 1, 500))]


def test_request_lines_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"id": 1, "method": "x"}\n{broken\n{"id": 2}\n')
    got = run(bodies.rpc_lines(sources.rpc_stream(spark, str(tmp_path / "in"))), "requests").collect()
    assert sorted((r["method"] or "", r["error"] or 0) for r in got) == [("", -32700), ("", -32600), ("x", 0)]


def test_project_kinds_and_savings(spark):
    df = spark.createDataFrame([(["a", "go.mod"],), (["package.json", "Cargo.toml"],), (["x"],), ([],)], "files array<string>")
    assert [r[0] for r in df.select(patch.project_type(F.col("files"))).collect()] == ["go", "rust", "unknown", "unknown"]
    raw = "a  \n\n  b" + " " * 40
    got = audit.audit(spark.createDataFrame([(raw,)], "text string"), "text").first()["lossless_saved"]
    assert got == (len(raw) - len("a\nb\n")) // 4
