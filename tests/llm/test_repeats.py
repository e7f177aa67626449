import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.llm import substring_dedup, suffix, suffix_dedup
from sievemill.llm.fm_index import FMIndex


def brute(rows, units, length, join):
    split = [units(t) for _, t in rows]
    count = Counter(tuple(u[i : i + length]) for u in split for i in range(len(u) - length + 1))
    out = []
    for (d, _), u in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(u) - length + 1):
            if count[tuple(u[i : i + length])] > 1:
                gone |= set(range(i, i + length))
        runs = sum(i - 1 not in gone for i in gone)
        kept = join(x for i, x in enumerate(u) if i not in gone)
        out.append((d, len(u), len(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def words(t):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    vocab = ["wo%d" % i for i in range(40)] + ["ünï", "x\x1cy"]
    shared = [" ".join(rng.choice(vocab, 30)) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [" ".join(rng.choice(vocab, rng.integers(1, 30))) for _ in range(rng.integers(1, 4))]
        parts.insert(rng.integers(0, len(parts) + 1), shared[rng.integers(0, 4)])
        texts.append("\n".join(parts))
    texts += ["same " * 70, "ab ab ab " * 20, None, "", " \t\n", texts[0], texts[0], texts[1] + " tail"]
    rows = list(enumerate(texts))
    return [*rows, (3, texts[5]), (7, texts[7]), (None, texts[8])]


@pytest.mark.parametrize(("cap", "shard"), [(8192, 400_000), (3, 200)])
def test_words_against_brute_force(spark, cap, shard):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("x")).withColumn("th", F.lit(0))
    out = substring_dedup.dedup(docs, length=12, gram=4, cap=cap, shard_words=shard).collect()
    got = sorted(((r["doc_id"], r["n_units"], sum(x["b"] - x["a"] for x in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out), key=str)
    assert got == brute(rows, words, 12, b" ".join)


@pytest.mark.parametrize(("cap", "shard"), [(4096, 2_000_000), (3, 500)])
def test_bytes_against_brute_force(spark, cap, shard):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("s", F.lit("x"))
    chars = lambda t: [bytes([b]) for b in (t or "").encode()]
    for shorter in (24, 40):
        out = suffix_dedup.dedup(docs, length=40, gram=10, cap=cap, shard_bytes=shard, shorter=shorter).collect()
        got = sorted(((r["doc_id"], r["n_units"], sum(x["b"] - x["a"] for x in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out), key=str)
        assert got == brute(rows, chars, 40, b"".join)
        got = sorted(((r["doc_id"], r["n_units"], r["n_shared"]) for r in out), key=str)
        assert got == sorted((x[:3] for x in brute(rows, chars, shorter, b"".join)), key=str)


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_empty(spark, module):
    assert module.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    for kind in (2, 5, 200):
        data = rng.integers(1, kind + 1, 700).astype(np.uint8)
        data[300:450] = data[100:250]
        order, tied = suffix.suffix_array(suffix.packed(data, 7), 7, len(data))
        assert not tied.any()
        raw = data.tobytes()
        assert order.tolist() == sorted(range(700), key=lambda i: raw[i:])
        words8 = suffix.words8(data, 200)
        got = suffix.kasai(words8, order, tied, np.array([0, 90, 400]), 160)
        for i, p in enumerate(order[1:], 1):
            a, b = raw[p:] + b"\0" * 200, raw[order[i - 1] :] + b"\0" * 200
            lcp = next((n for n in range(160) if a[n] != b[n]), 160)
            assert got[p] == lcp


def test_fm_index_counts():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 4, 500)
    text[-1] = 0
    index = FMIndex(text, 20)
    for least in (1, 2):
        a = rng.integers(0, 480, 60)
        b = a + rng.integers(1, 20, 60)
        got = index.search(text, a, b, least)
        for i, j, t in zip(a, b, got, strict=True):
            if (text[i:j] == 0).any():
                continue
            few = [x for x in range(i, j) if sum((text[k : k + j - x] == text[x:j]).all() for k in range(500 - (j - x) + 1)) < least]
            assert t == max(few, default=i - 1)


def test_pieces_that_share_more_than_the_sorted_depth():
    for seed in (61, 160, 181, *range(40)):
        rng = np.random.default_rng(seed)
        text = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
        shared = [text(int(rng.integers(455, 641))) for _ in range(3)]
        pieces = [text(int(rng.integers(1, 60))) + shared[rng.integers(0, 3)] + text(int(rng.integers(1, 60))) for _ in range(12)]
        count = Counter(p[i : i + 400] for p in pieces for i in range(len(p) - 399))
        want = {(k, i) for k, p in enumerate(pieces) for i in range(len(p) - 399) if count[p[i : i + 400]] > 1}
        (found,) = suffix_dedup.judge(400)((pieces, np.array([len(p) - 399 for p in pieces])))
        assert {(int(k), i) for k, lo, hi in zip(*found, strict=True) for i in range(lo, hi)} == want


@pytest.mark.parametrize("small", [suffix.SMALL, 100])
def test_only_chosen_places_are_sorted_to_the_full_depth(monkeypatch, small):
    monkeypatch.setattr(suffix, "SMALL", small)
    rng = np.random.default_rng(12)
    for width, kind in ((5, 2), (7, 200), (5, 1)):
        data = rng.integers(1, kind + 1, 900).astype(np.uint8)
        data[500:620] = data[100:220]
        raw = data.tobytes()
        places = np.sort(rng.choice(np.r_[90:150, 490:550, 700:720], 60, replace=False))
        order, levels = suffix.refined(suffix.packed(data, width), width, 96, places)
        assert sorted(order.tolist()) == places.tolist()
        assert [raw[i : i + 96] for i in order] == sorted(raw[i : i + 96] for i in places)
        got = suffix.shared(suffix.words8(data, 104), levels, order, 96)
        common = lambda a, b: next((n for n in range(96) if raw[a + n : a + n + 1] != raw[b + n : b + n + 1]), 96)
        want = {i: max(common(i, j) for j in places if j != i) for i in places.tolist()}
        assert {i: int(got[i]) for i in places.tolist()} == want
        assert not got[np.setdiff1d(np.arange(900), places)].any()
