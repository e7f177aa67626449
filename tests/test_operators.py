import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievemill.functions import text
from sievemill.operators import audit, context, evaluation, store, traffic
from sievemill.sources import tables
from sievemill.sources import text as sources
from sievemill.streaming import gateway


def brute_admit(rows, limit, span):
    held, out = [], []
    for at, n in rows:
        held = [(a, t) for a, t in held if at - a <= span]
        ok = sum(t for _, t in held) + n <= limit
        held += [(at, n)] if ok else []
        out.append(ok)
    return out


def events(seed=7, n=300):
    rng = np.random.default_rng(seed)
    at = np.sort(rng.integers(0, 20000, n)).astype(float)
    return [(int(k), i, float(a), int(t)) for i, (k, a, t) in enumerate(zip(rng.integers(0, 4, n), at, rng.integers(1, 50, n), strict=True))]


def test_breaker_and_cache(spark):
    rows = events()
    base = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(k, i, base + dt.timedelta(seconds=a), t) for k, i, a, t in rows], "key long, id long, ts timestamp, tokens long")
    got = {r["order"]: r["admitted"] for r in traffic.breaker(df, "key", "ts", "id", "tokens", 200).collect()}
    hits = {r["id"]: r["hit"] for r in traffic.response_cache(df, "key", "ts", "id", 300).collect()}
    for k in range(4):
        own = [r for r in rows if r[0] == k]
        assert [got[r[1]] for r in own] == brute_admit([r[2:] for r in own], 200, 3600)
        stored = None
        for r in own:
            hit = stored is not None and r[2] - stored < 300
            assert hits[r[1]] == hit
            stored = stored if hit else r[2]
    assert traffic.breaker(df, "key", "ts", "id", "tokens", None).filter("not admitted").count() == 0
    shared = pd.DataFrame({"key": [1, 2, 3, 1, 1], "at": [0, 1, 2, 3, 400]})
    assert traffic.shared_cache(shared, 300, 2).tolist() == [False, False, False, False, False]
    assert traffic.shared_cache(shared, 300, 9).tolist() == [False, False, False, True, False]


def run_stream(spark, tmp_path, rows, f, name):
    """Rows as a stream of three files, in order."""
    frame = spark.createDataFrame(rows, "key long, id long, at double, tokens long")
    for i in range(3):
        frame.filter((F.col("id") * 3 / len(rows)).cast("int") == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = f(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streams_decide_as_batches_do(spark, tmp_path):
    rows = events(8, 90)
    got = {r["id"]: r["admitted"] for r in run_stream(spark, tmp_path / "b", rows, lambda s: gateway.breaker_stream(s, "key", 120), "breaker")}
    hits = {r["id"]: r["hit"] for r in run_stream(spark, tmp_path / "h", rows, lambda s: gateway.cache_stream(s, "key"), "cache")}
    for k in range(4):
        own = [r for r in rows if r[0] == k]
        assert [got[r[1]] for r in own] == brute_admit([r[2:] for r in own], 120, 3600)
        stored = float("-inf")
        for r in own:
            assert hits[r[1]] == (r[2] - stored < 300)
            stored = stored if hits[r[1]] else r[2]


def test_report_and_checks(spark):
    log = spark.createDataFrame([(dt.datetime(2020, 1, 1), 600, 100, 1, 400, False, True, 5), (dt.datetime(2020, 1, 2), 400, 100, 0, None, True, False, 9)], "ts timestamp, raw long, clean long, secrets long, cache_tokens long, limited boolean, tripped boolean, latency_ms long")
    r = traffic.report(traffic.counters(log)).first()
    assert (r["saved_by_surgery"], r["tokens_saved"], r["reduction_pct"], r["last_latency_ms"], r["rate_limits"], r["trips"]) == (200, 600, 80.0, 9, 1, 1)
    df = spark.createDataFrame([("127.0.0.1:80", True), ("127.8.0.1", True), ("[::1]:9", True), ("::1", True), ("localhost", True), ("10.0.0.1", False), ("127.0.0.1.evil.com", False)], "a string, want boolean")
    assert all(r[0] == r[1] for r in df.select(traffic.is_loopback(F.col("a")), "want").collect())
    guard = df.limit(1).select(traffic.status_guard(F.lit(101), F.lit(1), F.lit(1), F.lit(True), F.lit(True), F.lit(True), F.lit(True)), traffic.status_guard(F.lit(1), F.lit(1), F.lit(1 << 26), F.lit(True), F.lit(True), F.lit(True), F.lit(True)), traffic.bar(F.lit(0), F.lit(0))).first()
    assert tuple(guard) == (431, 413, 5.0)


def test_context(spark):
    logs = spark.createDataFrame([(1, "panicked at a.rs:2:1 b.rs:99 c.rs:1 /p/node_modules/x.rs:1")], "doc_id long, text string")
    src = spark.createDataFrame([("a.rs", "1\n2\n3\n4\n5"), ("b.rs", "x"), ("z.rs", "q")], "path string, text string")
    found = context.frames(logs)
    got = context.contexts(found, src, 1).first()
    assert got["context"] == "--- a.rs (Lines 1-3) ---\n1 | 1\n2 | 2\n3 | 3\n\n--- b.rs (Lines 98-1) ---\n\n" and got["files"] == ["a.rs", "b.rs"]
    assert [r["line_no"] for r in context.windows_by_lines(found, context.source_lines(src), 1).orderBy("line_no").collect()] == [1, 2, 3]
    assert [r["path"] for r in context.missing(found, src).collect()] == ["c.rs"]
    df = spark.createDataFrame([("a/../b", False), ("../x", True), ("a/../../b", True), ("a\x00", True), ("/w/x", False), ("/w/../x", True), ("/other", True)], "p string, out boolean")
    assert all(r[0] == (not r[1]) for r in df.select(context.inside(F.col("p"), "/w"), "out").collect())


def test_envelope(spark):
    logs = spark.createDataFrame([("TypeError: x\n at f (/a/b.ts:1:2)\n at g (/node_modules/e.js:1:1)\ntoken=abcdefghijk",), ("fine",)], "text string")
    rows = audit.error_context(logs).select("envelope", audit.parsed_envelope(F.col("report")).alias("e")).collect()
    e = rows[0]["e"]
    assert (e["version"], e["secrets_neutralized"], e["primary_crash_coordinates"], e["suggested_next_frame"], e["original_bytes"]) == ("v1.0.0", 1, "/a/b.ts", "/a/b.ts", 0)
    assert e["dropped_frames"] == "1 frames (node_modules/e.js:1:1): 1)" and rows[1]["e"]["primary_crash_coordinates"] == audit.NO_FILE
    old = "[:SIEVEMILL:M2M_CONTROL_PLANE:v9]\n[COGNITIVE_DIRECTIVE=INSPECT_CALLER_AT_x.rs]\n[SECRETS_NEUTRALIZED=zz]\n[:END_CONTROL_PLANE]"
    e = spark.createDataFrame([(old,)], "t string").select(audit.parsed_envelope(F.col("t")).alias("e")).first()["e"]
    assert e["suggested_next_frame"] == "x.rs" and e["secrets_neutralized"] == 0
    assert spark.createDataFrame([("no",)], "t string").select(audit.parsed_envelope(F.col("t"))).first()[0] is None
    compact = audit.error_context(logs, strategy="lossless_compact").first()
    assert "[DROPPED_FRAMES=0 frames (lossless_compact)]" in compact["envelope"]


def test_store(spark):
    t0 = dt.datetime(2020, 1, 1)
    texts = spark.createDataFrame([("a", t0), ("b", t0 + dt.timedelta(hours=1)), ("a", t0 + dt.timedelta(hours=2))], "text string, stored_at timestamp")
    kept = store.put(None, texts)
    assert kept.count() == 2 and store.put(kept, texts).count() == 0
    key = texts.limit(1).select(F.concat(F.lit("sha256:sha256:"), store.content_hash(F.col("text"))).alias("hash"))
    assert store.get(kept, key, F.lit(t0 + dt.timedelta(hours=24))).first()["content"] == "a"
    assert store.get(kept, key, F.lit(t0 + dt.timedelta(hours=25))).count() == 0
    assert [r["content"] for r in store.evict(kept, F.lit(t0 + dt.timedelta(hours=3)), most=1).collect()] == ["b"]
    assert store.newest_per(kept.withColumn("k", F.lit(1)), "k", 1).first()["content"] == "b"
    newer = kept.limit(1).withColumns({"content": F.lit("new"), "stored_at": F.lit(t0 + dt.timedelta(days=3))})
    assert store.save_response(kept, newer).filter("content = 'new'").count() == 1


def test_evaluation(spark):
    samples = spark.createDataFrame([("1", "x [TOKEN_REDACTED]"), ("2", "s3cret here"), ("3", "[X_REDACTED]"), ("4", "fine")], "id string, scrubbed string")
    truth = spark.createDataFrame([("1", "a", "tok"), ("2", "b", "s3cret")], "id string, type string, raw string")
    got = {r["type"]: r for r in evaluation.detector_scores(samples, truth).collect()}
    assert (got[None]["tp"], got[None]["fp"], got[None]["fn"], got[None]["precision"], got[None]["recall"]) == (1, 1, 1, 50.0, 50.0)
    assert got["a"]["f1"] == 100.0 and got["b"]["recall"] == 0.0
    assert not evaluation.passes(evaluation.detector_scores(samples, truth)).first()["ok"]
    rows = spark.createDataFrame([(100, 50), (100, 100), (200, 20), (10, 0)], "b long, a long")
    r = evaluation.reduction(rows, "b", "a").first()
    assert (r["mean"], r["median"], r["p90"], r["min"], r["max"], r["n"]) == (60.0, 70.0, 100.0, 0.0, 100.0, 4)
    theirs = spark.createDataFrame([("1", "token")], "id string, found_text string")
    assert {r["id"]: r["found"] for r in evaluation.compared(truth, theirs).collect()} == {"1": True, "2": False}


def test_sources(spark, tmp_path):
    (tmp_path / "x.log").write_text("a\nb\n")
    assert sources.whole_files(spark, str(tmp_path / "x.log")).first()["text"] == "a\nb\n"
    df = spark.createDataFrame([("aé",), ("long text",)], "text string")
    assert [r[0] for r in sources.bounded(df, 2).collect()] == ["a", "lo"] and sources.bounded(df, 3, cut=False).count() == 1
    sources.write_text(df, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["aé", "long text"]
    (tmp_path / "c.toml").write_text('strategy = "lossless_compact"\nredact_rules = [{pattern = "x"}]\n')
    c = sources.load_config("c.toml", (str(tmp_path),))
    assert c.strategy == "lossless_compact" and c.redact_rules == [("x", None)]
    (tmp_path / "c.toml").write_text("broken =")
    assert sources.load_config("c.toml", (str(tmp_path),)) == sources.Config() == sources.load_config("none.toml", (str(tmp_path),))
    m = sources.sink_metrics(spark.createDataFrame([("a\nb\n", "a\n")], "x string, y string"), "x", "y").first()
    assert tuple(m) == (2, 1, 1)


@pytest.mark.parametrize("name", ["entry", "queries"])
def test_entry(spark, name):
    import __spark_entry__

    if name == "entry":
        assert __spark_entry__.entry(spark).count() > 0
    else:
        assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_write_that_fails_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sources.write_table(spark.range(3).selectExpr("id", "'a' as text"), path)
    bad = spark.range(3).selectExpr("id", "raise_error('no') as text")
    with pytest.raises(Exception, match="no"):
        sources.write_table(bad, path)
    assert spark.read.parquet(path).count() == 3
    sources.write_table(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    sources.write_text(spark.read.parquet(path), str(tmp_path / "x"))
    with pytest.raises(Exception, match="no"):
        sources.write_text(bad, str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).count() == 2
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t", "x"]


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4, 7, 12, 40])
def test_cuts_never_split_a_character(spark, most):
    texts = ["", "abc", "aé", "日本語テキスト", "a😀b😀", "x" * 12, "é" * 9, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r[0] for r in df.orderBy("i").select(text.truncated(F.col("text"), most, "~")).collect()]
    want = [t if t is None or len(t.encode()) <= most else t.encode()[:most].decode("utf-8", "ignore") + "~" for t in texts]
    assert got == want


def test_small_tables_are_dealt_over_the_cores(spark):
    df = spark.range(10, numPartitions=1).selectExpr("id", "'x' as text")
    assert tables.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100, numPartitions=50)
    assert tables.spread(many) is many
