import re

import numpy as np
import pytest

from sievemill.llm import similar


def brute_kept(rows):
    """Indices of the rows that stay: of each component of pairs with similarity 0.8 or more the first by id, null last."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                root[top(i)] = top(j)
    best = {}
    for i, (d, t) in enumerate(rows):
        best[top(i)] = min(best.get(top(i), (True, 0, i)), (d is None, d or 0, i))
    return sorted(i for _, _, i in best.values())


@pytest.mark.parametrize("seed", [7, 8])
def test_edited_copies_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(500)]
    passage = list(rng.choice(vocab, 30))
    texts = []
    for size in (6, 20, 60, 120, 200):
        base = list(rng.choice(vocab, size)) + passage
        for edits in (0, 0, 1, 1, 2, 2, 3, 4, 4, 6):
            copy = list(base)
            for at in rng.integers(0, len(copy), edits):
                copy[at] = rng.choice(vocab)
            texts.append(" ".join(copy))
    texts += [" ".join(passage), "a b", "A  b", "", " \n", "c d e"]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)] + [(None, "null one here"), (None, "null two here"), (900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = similar.keep_one(docs)
    want = brute_kept(rows)
    assert 10 < len(want) < len(rows) - 10
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((rows[i] for i in want), key=str)


def test_documents_against_brute_force(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = corpus_pipeline.near(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(rows[i][0] for i in brute_kept(rows))


def test_recall_at_the_least_similarity():
    """Pairs at a similarity of just 0.8 share a key nearly always, unrelated ones never."""
    rng = np.random.default_rng(3)
    for size in (40, 180, 900):
        shared = size * 8 // 9
        found = met = 0
        for _ in range(150):
            x = rng.integers(0, 1 << 63, 2 * size - shared, dtype=np.int64).astype(np.uint64)
            a, b = np.sort(x[:size]), np.sort(x[size - shared :])
            total = similar.sums([a, b, np.sort(rng.integers(0, 1 << 63, size, dtype=np.int64).astype(np.uint64))])[:, :483]
            k = similar.keys_of(total)
            found += bool(set(k[0]) & set(k[1]))
            met += bool(set(k[0]) & set(k[2]))
        assert found >= 0.95 * 150
        assert met == 0


def test_sums_against_bits():
    rng = np.random.default_rng(5)
    sets = [np.sort(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)) for n in (1, 254, 255, 256, 1021)]
    got = similar.sums(sets)
    for row, s in zip(got, sets, strict=True):
        for j in (0, similar.WORDS - 1):
            hashes = similar.mix(s + np.uint64((j + 1) * int(similar.ODD) & (1 << 64) - 1))
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
            assert row[64 * j : 64 * j + 64].tolist() == (2 * bits - 1).sum(axis=0).tolist()


def test_names_that_clash(spark):
    rows = [(1, "one two three four five six", "a", "b"), (2, "one two three four five  six", "c", "d"), (3, "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string, gone string")
    assert sorted(r["doc_id"] for r in similar.keep_one(docs).collect()) == [1, 3]
    assert similar.keep_one(docs).columns == docs.columns


def test_a_large_family(spark):
    """Copies with an edit each, all near one another, and a family whose members aren't."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    texts = []
    for _ in range(120):
        copy = list(base)
        copy[rng.integers(0, 300)] = "changed"
        texts.append(" ".join(copy))
    for _ in range(60):
        copy = [w if rng.random() > 0.06 else "other" + str(rng.integers(0, 9999)) for w in base]
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in similar.keep_one(docs).collect()) == [rows[i][0] for i in brute_kept(rows)]


def test_sets_that_are_near_without_links_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Sixty sets with a key, a fingerprint and 100 shingles in common, and 20 shingles of their own; two share 118 of 120."""
    rows = [(i, list(range(100)) + list(range(1000 * i + 1000, 1000 * i + 1020))) for i in range(60)]
    rows.append((60, rows[59][1][:-1] + [500]))
    schema = "sid long, g array<long>"
    sets = spark.createDataFrame(rows, schema)
    zeros = [0] * similar.WORDS
    keys = spark.createDataFrame([(7, i, 120, zeros) for i, _ in rows], "g long, sid long, n int, bits array<long>")
    nodes = keys.select("sid", "n", "bits")
    pairs = spark.createDataFrame([], "a long, b long")
    compared, real = [], similar.linked
    monkeypatch.setattr(similar, "linked", lambda pairs, sets: compared.append(pairs.count()) or real(pairs, sets))
    roots = similar.links(nodes, pairs, keys, sets).collect()
    assert sorted((r["node"], r["root"]) for r in roots) == [(59, 59), (60, 59)]
    assert compared[-1] < 2 * len(rows)


def test_sets_of_many_keys_meet_what_is_known_of_them_once(spark, monkeypatch):
    """Twelve sets share forty keys: what a set brings to the last round is put together in a row for it, not one for each key."""
    rows = [(i, list(range(100)) + list(range(1000 * i + 1000, 1000 * i + 1020))) for i in range(12)]
    rows.append((12, rows[11][1][:-1] + [500]))
    sets = spark.createDataFrame(rows, "sid long, g array<long>")
    nodes = spark.createDataFrame([(i, 120, [0] * similar.WORDS) for i, _ in rows], "sid long, n int, bits array<long>")
    keys = spark.createDataFrame([(g, i) for g in range(40) for i, _ in rows], "g long, sid long")
    written, real = {}, similar.stash
    monkeypatch.setattr(similar, "stash", lambda df, name: written.setdefault(name, []).append(real(df, name)) or written[name][-1])
    monkeypatch.setattr(similar, "drop_stash", lambda df: None)
    found = similar.unlike(nodes, keys, spark.createDataFrame([(11, 11), (12, 11)], "node long, root long"), sets)
    assert found.count() == 0
    assert written["still"][0].count() == len(rows)
    found = similar.unlike(nodes, keys, spark.createDataFrame([], "node long, root long"), sets)
    assert [tuple(r) for r in found.collect()] == [(11, 12)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert similar.keep_one(docs).count() == 0
