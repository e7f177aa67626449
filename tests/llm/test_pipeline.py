"""The pipeline, stage by stage, against plain versions of its stages on a small table."""

import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_edges import fold, norm
from test_similar import brute_kept

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from sievemill.llm import kneser_ney, simhash, substring_dedup  # noqa: E402
from sievemill.llm.common import stash  # noqa: E402
from sievemill.sources import scratch  # noqa: E402


def exact(rows):
    best = {}
    for r in rows:
        key = (-len(r["text"] or ""), r["doc_id"])
        best[norm(r["text"])] = min(best.get(norm(r["text"]), key), key)
    return {d for _, d in best.values()}


def near(rows):
    """Five words and a similarity of 0.8."""
    found = [(r["doc_id"], r["text"]) for r in rows]
    return {found[i][0] for i in brute_kept(found)}


def clean(rows, items):
    windows = set()
    for t in items:
        w = fold(t)
        windows |= {tuple(w[s : s + 10]) for s in range(max(len(w) - 9, 1) if w else 0)}
    sizes = {len(w) for w in windows}
    found = defaultdict(bool)
    for r in rows:
        w = fold(r["text"])
        found[r["doc_id"]] = any(tuple(w[s : s + n]) in windows for n in sizes for s in range(len(w) - n + 1))
    return {r["doc_id"] for r in rows if not found[r["doc_id"]]}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    want = {
        "quality classifier": lambda rows: {r["doc_id"] for r in kneser_ney.judge(docs, labels).filter("keep").collect()},
        "exact dedup": exact,
        "near dedup": near,
        "decontamination": lambda rows: clean(rows, items),
    }
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = stash(stage(spark, docs, sf), "stage")
        got = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(got) == len(set(got))
        if name in want:
            assert set(got) == want[name](rows), name
            assert out.columns == columns
            docs = out
        else:
            assert set(got) == {r["doc_id"] for r in rows}
            taken, size = out.groupBy().sum("taken", "size").first()
            assert taken == pytest.approx(1.5 * size, abs=len(got))


def test_stages_with_nulls_repeats_and_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = docs.filter("n_chars > 400").first()
    odd = [
        (None, None, None, None, None), (None, "", "en", None, 0), (None, one["text"], one["lang"], None, None), (910001, None, None, "src0", None), (910002, " \n\t", "xx", None, 3),
        (910003, one["text"], one["lang"], one["source"], one["n_chars"]), (910003, one["text"], one["lang"], one["source"], one["n_chars"]), (910004, "w " * 200_000, "en", "long", 400_000),
    ]
    all_docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({c: F.lit(c) for c in ("th", "root", "gone", "row", "hit", "class", "keep", "locator", "bucket")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stash(stage(spark, all_docs, sf), "stage")
        assert out.columns == all_docs.columns, name
        assert 0 < out.count() <= all_docs.count()
        assert out.exceptAll(all_docs).isEmpty(), name
        all_docs = out
    # null and empty texts are one text, of which the row with the smallest id stays; white space alone doesn't read like text
    assert [r["doc_id"] for r in all_docs.collect() if not (r["text"] or "").strip()] == [910001]
    mixed = corpus_pipeline.mixed(spark, all_docs, sf).collect()
    assert len(mixed) == all_docs.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_a_run_leaves_its_result_only_and_others_alone(spark, sf):
    """Queries that were built before the run, but not yet read, can still be read after it."""
    others = [substring_dedup.query(spark, sf), simhash.query(spark, sf)]
    folder = scratch.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0
    assert set(os.listdir(folder)) - before == {os.path.basename(out._stash_path)}
    assert before <= set(os.listdir(folder))
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert [df.count() for df in others] == [n, n]


def test_names_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "decontamination", "mixing"]
