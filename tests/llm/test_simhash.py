import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sievemill.llm import components, simhash


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    root = {i: i for i in range(len(rows))}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 2:
                root[top(i)] = top(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[top(i)] = min(d, best.get(top(i), d))
    return [best.get(top(i)) for i in range(len(rows))]


def test_any_two_errors_share_a_key():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 400).astype(np.int64)
    for _ in range(8):
        flips = (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
        other = (fp.view(np.uint64) ^ flips).view(np.int64)
        (r1, k1), (r2, k2) = simhash.keys(fp), simhash.keys(other)
        for i in range(0, 400, 7):
            assert set(k1[r1 == i]) & set(k2[r2 == i])


def test_one_or_six_codewords():
    _, rows = np.unique(simhash.codewords(np.arange(1 << 14, dtype=np.int64) * 512 + 77)[0], return_counts=True)
    assert set(rows) <= {1, 6}


def test_large_groups_give_the_same_components(monkeypatch):
    rng = np.random.default_rng(2)
    base = np.uint64(0x1234567890ABCDEF)
    fp = np.unique(np.array([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 4)).astype(np.uint64)) for _ in range(600)], np.uint64)).view(np.int64)

    def parts(edges):
        root = list(range(len(fp)))
        for _ in range(len(fp)):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    small = parts(simhash.forest(fp))
    monkeypatch.setattr(simhash, "PAIRWISE", 4)
    assert parts(simhash.forest(fp)) == small


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(9001, None), (9002, " \n"), (9003, "one"), (9003, "one"), (None, "one"), (9004, "Ünï Two")], docs.schema)
    docs = docs.unionByName(extra).withColumn("fp", F.lit("clash")).withColumn("th", F.lit(1))
    want = [(r["doc_id"], brute_fp(r["text"])) for r in docs.collect()]
    want = sorted(((d, f"{fp:016x}", c) for (d, fp), c in zip(want, brute_components(want), strict=True)), key=str)
    got = simhash.classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {c for _, _, c in want}


def test_one_row_of_each_component_whatever_the_ids(spark):
    texts = ["alpha beta gamma delta", "one two three four", "un deux trois quatre cinq", "eins zwei drei"]
    assert not any(bin(brute_fp(a) ^ brute_fp(b)).count("1") <= 2 for a in texts for b in texts if a < b)
    rows = [(None, t) for t in texts] + [(7, t + " end") for t in texts]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted(rows, key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(docs).count() == 0


def test_components_in_one_task_and_by_contraction(spark, monkeypatch):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(-60, 60, (70, 2))] + [(i, i + 1) for i in range(1000, 1030)]
    want = {}
    for a, b in edges:
        ra, rb = want.get(a, {a}), want.get(b, {b})
        for x in (both := ra | rb):
            want[x] = both
    want = {x: min(c) for x, c in want.items() if len(c) > 1}
    for few in (1000, 0):
        monkeypatch.setattr(components, "FEW", few)
        got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
