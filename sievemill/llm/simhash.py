"""SimHash near-dedup with fuzzy keys from the binary Golay code.

Fingerprint: A-Z lower-cased, words between ASCII white space, 3-word shingles with repeats (all words if fewer), XXH64 of
each, and a bit for every position that more than half of the hashes set. Texts without words have fingerprint zero.

Links: fingerprints that differ in at most two bits. The 64 bits are cut into segments of 23, 23 and 18. Two errors
touch at most two of three segments, so one segment is the same in both (pigeonhole) and is part of a key as it is. The
other part comes from a segment of 23 bits with at most two errors: the perfect Golay code puts every 23-bit vector within
three bits of exactly one codeword, and two vectors at most two bits apart have a vector between them, one bit or less
from each, whose codeword is within four bits of both. So the keys of a segment are the codewords within four bits, one or
six of them, and two such vectors always share one. The keys are (A as is, codeword of B), (B as is, codeword of A) and
(C as is, codeword of A): 3 to 18 for a fingerprint, each of 30 to 35 bits. Rows are joined on the key by grouping, and all
members of a group are compared in full.

Only distinct fingerprints are compared; copies share one. A group of up to ``PAIRWISE`` fingerprints is compared in blocks
against itself; a larger one by its one-bit neighbourhoods, which is exact for two bits and linear in the group: two
fingerprints differ in at most two bits if and only if they share a vector at distance one or less. From each group only
the edges of a spanning forest are emitted, at most one less than its members. Components: see components.py.

Null text counts as empty. Null ids are members of groups like others, but a component's id is its smallest non-null id
(null if none). Rows that repeat give equal rows. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import ascii_lower, bounded_broadcast, documents, stash, unused
from sievemill.llm.components import components

SHINGLE = 3
SEED = 42
MOST = 2
PAIRWISE = 2048
#: Generator polynomial of the binary Golay code of length 23: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def fingerprint(text: bytes) -> int:
    """64 bits of an already lower-cased text in UTF-8."""
    words = text.split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(words, words[1:], words[2:], strict=False)]
    digest, seed = xxhash.xxh64_digest, SEED
    raw = np.frombuffer(b"".join([digest(x, seed) for x in shingles]), np.uint8)
    bits = np.unpackbits(raw.reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fp) of every row; fp as a signed long, th the hash of the text."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t.encode()) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), of(ascii_lower(F.coalesce(F.col(text_col), F.lit("")))).alias("fp"))


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(codeword by syndrome: the error of at most three bits for each 11-bit syndrome; weight-7 codewords)."""
    singles = [1 << i for i in range(23)]
    errors = [0, *singles]
    errors += [a | b for i, a in enumerate(singles) for b in singles[:i]]
    errors += [a | b | c for i, a in enumerate(singles) for j, b in enumerate(singles[:i]) for c in singles[:j]]
    errors = np.array(errors, np.int64)
    table = np.zeros(2048, np.int64)
    table[syndrome(errors)] = errors
    words = np.arange(4096, dtype=np.int64) << 11
    words |= syndrome(words)
    return table, words[np.bitwise_count(words) == 7]


def syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit vectors, read as polynomials, by the generator."""
    v = v.copy()
    for i in range(22, 10, -1):
        v ^= ((v >> i) & 1) * (GOLAY << (i - 11))
    return v


def codewords(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): for each 23-bit vector the 12-bit indices of all codewords within four bits of it."""
    table, sevens = golay()
    error = table[syndrome(v)]
    near = v ^ error
    rows, found = [np.arange(len(v))], [near]
    far = np.flatnonzero(np.bitwise_count(error) == 3)
    for s in sevens:
        hit = far[(error[far] & s) == error[far]]
        rows.append(hit)
        found.append(near[hit] ^ s)
    return np.concatenate(rows), np.concatenate(found) >> 11


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of fingerprints: all fuzzy keys."""
    fp = fp.view(np.uint64)
    a = (fp & np.uint64(0x7FFFFF)).astype(np.int64)
    b = ((fp >> np.uint64(23)) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (fp >> np.uint64(46)).astype(np.int64)
    (ra, ka), (rb, kb) = codewords(a), codewords(b)
    rows = np.concatenate([rb, ra, ra])
    out = np.concatenate([a[rb] << 12 | kb, 1 << 40 | b[ra] << 12 | ka, 2 << 40 | c[ra] << 12 | ka])
    return rows, out


def forest(fp: np.ndarray, most: int = MOST) -> np.ndarray:
    """Edges (i, j) of a spanning forest of the graph that ties distinct fingerprints at most ``most`` bits apart."""
    n = len(fp)
    fp = fp.view(np.uint64)
    root = np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def tie(left: np.ndarray, right: np.ndarray) -> None:
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            x, y = top(i), top(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                edges.append((i, j))

    edges: list[tuple[int, int]] = []
    if n <= PAIRWISE or most != MOST:
        for start in range(0, n, 256):
            near = np.bitwise_count(fp[start : start + 256, None] ^ fp[None, start:]) <= most
            i, j = np.nonzero(np.triu(near, 1))
            tie(i + start, j + start)
    else:
        flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
        around = (fp[:, None] ^ flips[None, :]).ravel()
        order = np.argsort(around, kind="stable")
        same = np.flatnonzero(around[order[1:]] == around[order[:-1]])
        tie(order[same] // 65, order[same + 1] // 65)
    return np.array(edges, np.int64).reshape(-1, 2)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints at most two bits apart, enough of them to connect what is connected."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            rows, key = keys(fp)
            yield pd.DataFrame({"key": key, "fp": fp[rows]})

    def tie(group: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(group["fp"].to_numpy(np.int64))
        e = forest(fp)
        return pd.DataFrame({"a": fp[e[:, 0]], "b": fp[e[:, 1]]})

    spread_out = stash(distinct.select("fp").mapInPandas(spread, "key bigint, fp bigint"), "keys")
    several = spread_out.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    several = stash(several, "several")
    pairs = several.filter(f"n = 2 and bit_count(a ^ b) <= {MOST}").select("a", "b")
    larger = spread_out.join(several.filter("n > 2").select("key"), "key", "left_semi")
    return pairs.union(larger.groupBy("key").applyInPandas(tie, "a bigint, b bigint"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fp, root, component_id) for each row; root, a fingerprint, tells components apart whose ids don't."""
    marked = stash(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct))
    nodes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(best, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns: of each component the row with the smallest id (of rows that share it, the one with the
    smallest text hash; of wholly repeated rows, all)."""
    return best_rows(docs, classes(docs, id_col, text_col), id_col, text_col)


def best_rows(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of docs that stand for their component. found: (doc_id, th, root) for each row. Texts aren't moved where few go."""
    found = stash(found.select(F.col("doc_id").cast("long").alias("doc_id"), "th", "root"), "found")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    best = found.groupBy("root").agg(F.min(order).alias("b"), F.max(order).alias("z")).filter("b <> z").select("root", "b")
    name = unused(docs, "gone")
    gone = found.join(best, "root").filter(order != F.col("b")).select(F.struct("doc_id", "th").alias(name)).distinct()
    gone = bounded_broadcast(stash(gone, "gone"))
    same = docs[id_col].cast("long").eqNullSafe(gone[name]["doc_id"]) & (F.xxhash64(docs[text_col]) == gone[name]["th"])
    return docs.join(gone, same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
