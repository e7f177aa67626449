"""Vector codes and exact search against brute force: nulls, odd numbers, ties, repeated rows, empty tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemill.llm import top_k, vector_codes
from sievemill.llm.ball_tree import BallTree, Best, search


def table_of(spark, rows):
    clash = {c: F.lit("clash") for c in ("rid", "v", "q", "parts", "pos", "part", "code", "error", "weight", "ids", "score", "rank", "n")}
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns(clash)


def made(n, dim, seed=1, spread=1.0):
    """Clustered vectors with copies and ties."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (5, dim))
    x = (centres[rng.integers(0, 5, n)] + rng.normal(0, 0.2, (n, dim))).round(2).astype(np.float32)
    x[n // 3 : 2 * n // 3] = x[0]
    return [(int(i), [float(v) for v in x[i]], int(i) % 4 if i % 7 else None) for i in rng.permutation(n)]


ODD = [(900, None, 1), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] + [0.0] * 7, 1), (904, [0.5, -0.5], 2), (905, [], 2), (None, [0.25] * 8, None), (None, [0.25] * 8, 3), (50, [0.1] * 8, 3), (100, [0.1] * 8, 3), (100, [0.1] * 8, 3)]


def kept(rows, scale):
    ok = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(v) for _, v, _ in ok), default=0)
    return [(i, [math.floor(float(np.float32(x)) * scale) for x in v] + [0] * (longest - len(v)), lab) for i, v, lab in ok]


def brute_codes(rows, parts=4, entries=256, rounds=4):
    rows = [(i, v + [0] * (-len(v) % parts), lab) for i, v, lab in kept(rows, 1024)]
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, c), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in rows:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, v, lab in rows:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, lab, [e for _, e in found], sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


@pytest.mark.parametrize("entries", [256, 6])
def test_vector_codes(spark, entries):
    rows = made(120, 8) + ODD
    got, books = vector_codes.compress(table_of(spark, rows), entries=entries)
    want, digest = brute_codes(rows, entries=entries)
    assert vector_codes.digest(books) == digest
    assert sorted(((r["vec_id"], r["label"], r["codes"], r["error"]) for r in got.collect()), key=str) == sorted(want, key=str)
    back = vector_codes.decoded(got, books)
    assert all(len(r["vector"]) == 8 for r in back.collect())


def test_vector_codes_when_no_part_is_heavy(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HEAVY", 0)
    rows = made(90, 6, seed=3)
    got, _ = vector_codes.compress(table_of(spark, rows), entries=5)
    assert sorted(((r["vec_id"], r["label"], r["codes"], r["error"]) for r in got.collect()), key=str) == sorted(brute_codes(rows, entries=5)[0], key=str)


def test_vector_codes_empty(spark):
    assert vector_codes.compress(table_of(spark, ODD).limit(0))[0].count() == 0
    got, _ = vector_codes.compress(table_of(spark, [(1, [], 1), (2, [], None), (3, None, 1)]))
    assert sorted((r["vec_id"], r["codes"], r["error"]) for r in got.collect()) == [(1, [0] * 4, 0), (2, [0] * 4, 0)]
    with pytest.raises(ValueError):
        vector_codes.compress(table_of(spark, [(1, [1e30] * 8, 1)]))


def brute_top(rows, every=50, k=5):
    rows = kept(rows, 256)
    out = []
    for n, (i, v, _) in enumerate(rows):
        if i is not None and i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0) for m, (j, w, _) in enumerate(rows) if m != n)
            out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard, block, seeds", [(16_384, 32_768, 2048), (16, 3, 2), (40, 2, 64)])
def test_top_k(spark, shard, block, seeds):
    rows = made(300, 8, spread=0.3) + ODD
    got = top_k.top_k(table_of(spark, rows), every=10, shard=shard, block=block, seeds=seeds)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_top(rows, every=10)


def test_top_k_of_few_and_none(spark):
    rows = [(0, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (7, [-1.0, 2.0], 1)]
    got = top_k.top_k(table_of(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_top(rows)
    assert top_k.top_k(table_of(spark, rows[2:])).count() == 0
    assert top_k.top_k(table_of(spark, rows).limit(0)).count() == 0


def test_ball_tree_finds_the_best_and_skips_the_rest():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 100, (20, 16))
    x = np.unique((centres[rng.integers(0, 20, 6000)] + rng.normal(0, 3, (6000, 16))).round(), axis=0)
    ids = [np.array([i]) for i in range(len(x))]
    tree = BallTree.unpacked(BallTree.built(x, ids, leaf=32).packed(), 16)
    queries = x[::97]
    best = Best(np.full(len(queries), -np.inf), 6)
    scored = search(tree, queries, best)
    leaves = (tree.nodes[:, 2] < 0).sum()
    assert scored < 0.3 * leaves * len(queries)
    for q, s, i in zip(queries, best.scores, best.ids, strict=True):
        all_ = x @ q
        order = np.lexsort((np.arange(len(x)), -all_))[:6]
        assert s.tolist() == all_[order].tolist() and i.tolist() == order.tolist()
