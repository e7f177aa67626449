import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievemill.llm import ppm

ORDER = 5


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


class Brute:
    """PPM, method D with exclusion, straight from its definition, one byte at a time."""

    def __init__(self, texts):
        self.n = defaultdict(Counter)
        for t in texts:
            s = b"\n" * ORDER + t
            for i in range(ORDER, len(s)):
                for k in range(ORDER + 1):
                    self.n[s[i - k : i]][s[i]] += 1

    def log10(self, t):
        s, total = b"\n" * ORDER + t, 0.0
        for i in range(ORDER, len(s)):
            out = set()
            for k in range(ORDER, -1, -1):
                seen = {x: c for x, c in self.n.get(s[i - k : i], {}).items() if x not in out}
                if not seen:
                    continue
                n = sum(seen.values())
                if s[i] in seen:
                    total += math.log10((2 * seen[s[i]] - 1) / (2 * n))
                    break
                total += math.log10(len(seen) / (2 * n))
                out |= set(seen)
            else:
                total -= math.log10(256 - len(out))
        return total


@pytest.mark.parametrize("chunk_bytes, fan_in", [(1 << 24, 64), (3000, 64), (100, 3)])
def test_against_brute_force(spark, monkeypatch, chunk_bytes, fan_in):
    """Chunks of 100 bytes are shorter than some texts and take several steps of the tree."""
    monkeypatch.setattr(ppm, "FAN_IN", fan_in)
    texts = ["The cat sat on the mat.\nThe CAT sat.", "", None, "a b", "Ünïcode wörds, the cat", "zzzz qqq the mat", "the cat sat on the mat " * 30]
    rows = [(i, texts[i % 7] and texts[i % 7] + " x%d" % (i % 3)) for i in range(60)] + [(None, "the cat"), (5, "the cat"), (5, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("x")).withColumn("train", F.lit(1))
    train = [(d, words(t)) for d, t in rows if not held(d)]
    model = Brute([b" ".join(w.encode() for w in ws) + b"\n" for _, ws in train])
    count = Counter(w for _, ws in train for w in ws) + Counter({None: len(train)})
    n, v = sum(count.values()), len(count)
    want = []
    for d, t in rows:
        ws = words(t) + [None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want.append((d, held(d), len(ws), sum(count[w] > 0 for w in ws), n, base, model.log10(b" ".join(w.encode() for w in ws[:-1]) + b"\n")))
    got = sorted(ppm.score(docs, chunk_bytes=chunk_bytes).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[6]))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[6]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-5)


def test_empty(spark):
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_held_out_bits_per_byte(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    size = docs.select("doc_id", F.octet_length(F.trim("text")).alias("bytes"))
    r = ppm.score(docs).join(size, "doc_id").filter("held_out").agg(F.sum("score"), F.sum("bytes")).first()
    assert 1 < -r[0] * math.log2(10) / r[1] < 2.6
