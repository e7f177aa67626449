"""SimHash near-dedup for a similarity: classes of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

A text's set: A-Z lower-cased, words between ASCII white space, 64-bit hashes of its 5-word shingles (all words if fewer).
Sets of that similarity have fingerprints that lie about a seventh of the bits apart, too far for the two bits that
simhash.py links exactly, so this is the same method with wider fingerprints and keys from all that is known of a bit. A
fingerprint has ``GROUPS`` x ``SEGMENTS`` segments of 23 bits. Its bits are signs of sums over the shingles' hash bits, and
the sums say how sure each sign is. A segment is decoded to the ``NEAREST`` Golay codewords, nearest by the sums (so that
errors in doubtful bits cost little). A group of segments gives ``KEYS`` keys, the combinations of its segments' codewords
that lie nearest in all: 36 bits each, so that unrelated texts meet seldom however many there are. Errors that spoil one
group's keys leave another group whole (pigeonhole): at a similarity of just 0.8 a pair shares a key of one group with
probability 0.42 and of any with 0.98; at 0.85 with 0.998. The README has the recall measured on documents.

Texts that share a key are compared by their fingerprints first: a pair further apart than ``APART`` bits can't be linked
(more than two deviations above what 0.8 gives on the average; for sets of a few shingles the bound is wider). What is left is compared in full, by its sets, made
again from the texts. Pairs come in three rounds, each leaving out pairs that are in one component already: every text
with the nearest of its keys' heads (a key's head is its text with the least hash, the same for most keys of a family),
then with its keys' other heads, then, within keys whose texts are still in several components, with texts of other
components. Groups of copies are thus linear, and no pair of a group is emitted unless its fingerprints are near and, in the
last round, its sets' rarest shingles leave room for a similarity of 0.8 (a bound, so no link is lost): texts that come from
one passage but went different ways have rare shingles of their own, and few of their pairs are compared in full.

Equal sets are one node (64 bits tell sets apart), so texts without words are copies. Null text counts as empty. Ids may be
null or repeat. Empty tables give empty results; other columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import bounded_broadcast, drop_stash, stash
from sievemill.llm.components import components
from sievemill.llm.segments import BYTES, word_units
from sievemill.llm.simhash import best_rows, syndrome
from sievemill.llm.url_filter import mix

SHINGLE = 5
GROUPS, SEGMENTS, NEAREST, KEYS = 7, 3, 6, 16
WIDTH = 23
#: 64-bit words of a fingerprint.
WORDS = -(-GROUPS * SEGMENTS * WIDTH // 64)
#: Of 483 bits, pairs at 0.8 differ in 73 on the average, with a deviation of 8; unrelated ones in 241.
APART = 92
#: Sets of fewer shingles get a wider bound.
FEW = 30
BLOCK = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
MARKED = "doc_id bigint, th bigint, sid bigint, n int, bits array<bigint>, keys array<bigint>"


def folded(words: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words that begin at ``first``."""
    with np.errstate(over="ignore"):
        out = mix(words[first] + np.uint64(size))
        for j in range(1, size):
            out = mix(out * ODD + words[first + j])
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text, data[offsets[i]:offsets[i + 1]], its distinct shingle hashes, sorted."""
    data = LOWER[data]
    words, starts = word_units(data, offsets)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.arange(max(0, len(words) - SHINGLE + 1))
    at = at[text[at] == text[at + SHINGLE - 1]]
    hashes = folded(words, at, SHINGLE)
    ends = np.searchsorted(at, starts)
    out = []
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        size = int(starts[i + 1] - starts[i])
        if 0 < size < SHINGLE:
            out.append(folded(words, starts[i : i + 1], size))
        else:
            h = np.sort(hashes[a:b])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) > 1 else h)
    return out


#: By byte: its bits, the highest first, each in a byte of its own.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def sums(sets: list[np.ndarray]) -> np.ndarray:
    """For each set (none empty) and bit: how many more of its hashes have the bit than don't."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    begin = np.cumsum(sizes) - sizes
    # a counter of one byte holds 255 hashes
    runs = -(-sizes // 255)
    first = np.cumsum(runs) - runs
    cuts = np.repeat(begin, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    out = np.empty((len(sets), WORDS * 64), np.int64)
    with np.errstate(over="ignore"):
        for j in range(WORDS):
            x = mix(flat + np.uint64(j + 1) * ODD)
            counts = np.add.reduceat(SPREAD[x.view(np.uint8).reshape(-1, 8)], cuts, axis=0).view(np.uint8)
            out[:, 64 * j : 64 * j + 64] = np.add.reduceat(counts, first, axis=0, dtype=np.int64)
    return 2 * out - sizes[:, None]


@lru_cache(1)
def code() -> np.ndarray:
    """Half of the Golay code's words as signs, 23 x 2048; the others are their complements."""
    words = np.arange(2048, dtype=np.int64) << 11
    words |= syndrome(words)
    return (((words >> np.arange(WIDTH)[:, None]) & 1) * 2 - 1).astype(np.float32)


def nearest(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codewords, scores) of the NEAREST codewords of each row of 23 sums; sums and scores are whole numbers."""
    score = segment.astype(np.float32) @ code()
    size = np.abs(score)
    rows = np.arange(len(score))
    which, worth = np.empty((len(score), NEAREST), np.int64), np.empty((len(score), NEAREST), np.int64)
    for i in range(NEAREST):
        at = size.argmax(axis=1)
        which[:, i] = at | (score[rows, at] < 0).astype(np.int64) << 11
        worth[:, i] = size[rows, at]
        size[rows, at] = -1
    return which, worth


@lru_cache(1)
def ways() -> np.ndarray:
    return np.array(list(product(range(NEAREST), repeat=SEGMENTS)), np.int64)


def keys_of(total: np.ndarray) -> np.ndarray:
    """GROUPS x KEYS keys of each row of sums."""
    out = []
    for g in range(GROUPS):
        worth, key = np.zeros((len(total), len(ways())), np.int64), np.zeros((len(total), len(ways())), np.int64)
        for s in range(SEGMENTS):
            at = (g * SEGMENTS + s) * WIDTH
            word, score = nearest(total[:, at : at + WIDTH])
            worth += score[:, ways()[:, s]]
            key = key << 12 | word[:, ways()[:, s]]
        # the place breaks ties, so the choice is the same everywhere
        worth = worth * len(ways()) - np.arange(len(ways()))
        best = np.argpartition(-worth, KEYS - 1, axis=1)[:, :KEYS]
        out.append(np.take_along_axis(key, best, axis=1) | g << 12 * SEGMENTS)
    return np.concatenate(out, axis=1)


def split(raw: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of blocks of texts, in order."""
    sizes = np.array(pa.compute.binary_length(raw), np.int64)
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + BLOCK, side="right")))
        part = raw.slice(a, b - a)
        offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        yield data, offsets - offsets[0]
        a = b


def lists(values: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists of longs."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s for data, offsets in split(batch.column("raw")) for s in shingles(data, offsets)]
        n = np.array([len(s) for s in sets], np.int64)
        sid = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        bits, keys = np.zeros((len(sets), WORDS), np.int64), np.zeros((len(sets), GROUPS * KEYS), np.int64)
        full = np.flatnonzero(n)
        for a in range(0, len(full), 256):
            rows = full[a : a + 256]
            total = sums([sets[i] for i in rows])[:, : GROUPS * SEGMENTS * WIDTH]
            signs = np.zeros((len(rows), WORDS * 64), bool)
            signs[:, : total.shape[1]] = total > 0
            bits[rows] = np.packbits(signs, axis=1).view(np.int64)
            keys[rows] = keys_of(total)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(sid), pa.array(n.astype(np.int32)), lists(bits), lists(keys)], ["doc_id", "th", "sid", "n", "bits", "keys"])


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s for data, offsets in split(batch.column("raw")) for s in shingles(data, offsets)]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["sid", "g"])


def side(df: DataFrame, x: str, *values: str) -> DataFrame:
    return df.select(F.col("sid").alias(x), *[F.col(v).alias(v + x) for v in values])


def apart(x: str, y: str) -> Column:
    return sum((F.bit_count(F.col(f"bits{x}")[i].bitwiseXOR(F.col(f"bits{y}")[i])) for i in range(WORDS)), F.lit(0))


def near(x: str, y: str) -> Column:
    """Whether two rows' sizes and fingerprints allow a link. Sums over few shingles are often zero, so their signs vary."""
    least, most = F.least(f"n{x}", f"n{y}"), F.greatest(f"n{x}", f"n{y}")
    return (5 * least >= 4 * most) & (apart(x, y) <= F.when(least < FEW, APART + 30).otherwise(APART))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of sets whose similarity is 0.8 or more."""
    shared = F.size(F.array_intersect("ga", "gb"))
    both = pairs.join(side(sets, "a", "g"), "a").join(side(sets, "b", "g"), "b")
    return stash(both.filter(9 * shared >= 4 * (F.size("ga") + F.size("gb"))).select("a", "b"), "linked")


def rooted(df: DataFrame, roots: DataFrame, x: str) -> DataFrame:
    """df with the root of its node x."""
    return df.join(roots.select(F.col("node").alias(x), F.col("root").alias("r")), x, "left").withColumn(f"root{x}", F.coalesce("r", x)).drop("r")


def links(nodes: DataFrame, pairs: DataFrame, keys: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of linked sets. nodes: (sid, n, bits); pairs: (a, b) that share a key with nobody else; keys: (g, sid), of
    keys that more sets have."""
    heads = keys.groupBy("g").agg(F.min_by("sid", F.xxhash64("sid")).alias("b"))
    # most keys of a set have the same head: only distinct pairs meet their fingerprints
    to_heads = keys.select("g", F.col("sid").alias("a")).join(heads, "g").filter("a <> b").select("a", "b")
    met = to_heads.unionByName(pairs).distinct().join(side(nodes, "a", "n", "bits"), "a").join(side(nodes, "b", "n", "bits"), "b")
    stars = stash(met.filter(near("a", "b")).select("a", "b", apart("a", "b").alias("apart")), "stars")
    one = stash(stars.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("m")).select("a", F.col("m.b").alias("b")), "one")
    edges = linked(one, sets)
    roots = stash(components(edges), "roots")
    rest = rooted(rooted(stars.select("a", "b"), roots, "a"), roots, "b").filter("roota <> rootb").select("a", "b")
    more = linked(rest.join(one, ["a", "b"], "left_anti"), sets)
    drop_stash(one)
    drop_stash(roots)
    edges = stash(edges.union(more), "edges")
    drop_stash(more)
    seen = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = linked(unlike(nodes, keys, components(edges), sets).join(seen, ["a", "b"], "left_anti"), sets)
    drop_stash(stars)
    return components(edges.union(more))


def rarest(sets: DataFrame) -> DataFrame:
    """(sid, rare): the rarest third of each set's shingles and one more, as numbers that grow with how many sets have them."""
    each = stash(sets.select("sid", F.explode("g").alias("e")), "elements")
    order = stash(each.groupBy("e").count().orderBy("count", "e").select("e", F.monotonically_increasing_id().alias("at")), "order")
    sorted_ = each.join(order, "e").groupBy("sid").agg(F.array_sort(F.collect_list("at")).alias("all"))
    out = stash(sorted_.select("sid", F.expr("slice(all, 1, size(all) div 3 + 1)").alias("rare")), "rarest")
    for t in (each, order):
        drop_stash(t)
    return out


def may_link(x: str, y: str) -> Column:
    """Whether what the rarest shingles of two sets tell allows a similarity of 0.8. Up to the smaller of the two last ones
    all shingles of both are known, and so is how many they share; of the others they share as many as there are at most."""
    last = F.least(F.element_at(f"rare{x}", -1), F.element_at(f"rare{y}", -1))
    left = lambda z: F.col(f"n{z}") - F.size(F.filter(f"rare{z}", lambda at: at <= last))
    return 9 * (F.size(F.array_intersect(f"rare{x}", f"rare{y}")) + F.least(left(x), left(y))) >= 4 * (F.col(f"n{x}") + F.col(f"n{y}"))


def unlike(nodes: DataFrame, keys: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): near sets that share a key, are in different components, and whose rarest shingles allow a link. What is known
    of a set is put together once, with its open keys in a list, and then dealt to these keys."""
    placed = stash(rooted(keys.select("g", "sid"), roots, "sid"), "placed")
    still = placed.groupBy("g").agg(F.min("rootsid").alias("x"), F.max("rootsid").alias("y")).filter("x <> y").select("g")
    rows = stash(placed.join(still, "g").groupBy("sid").agg(F.min("rootsid").alias("root"), F.collect_set("g").alias("keys")), "still")
    rare = rarest(sets.join(rows.select("sid"), "sid", "left_semi"))
    known = rows.join(nodes.select("sid", "n", "bits"), "sid").join(rare, "sid")
    met = known.select(F.explode("keys").alias("g"), F.col("sid").alias("a"), *[F.col(c).alias(f"{c}a") for c in ("root", "n", "bits", "keys", "rare")])
    met = stash(met, "open")
    other = met.withColumnsRenamed({f"{c}a": f"{c}b" for c in ("", "root", "keys", "n", "bits", "rare")})
    first = F.array_min(F.array_intersect("keysa", "keysb")) == F.col("g")
    out = met.join(other, "g").filter((F.col("a") < F.col("b")) & (F.col("roota") != F.col("rootb")) & near("a", "b") & first & may_link("a", "b"))
    out = stash(out.select("a", "b"), "unlike")
    for t in (placed, rows, rare, met):
        drop_stash(t)
    return out


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, root) for each row; rows of a component of near copies have the same root."""
    rows = rows_of(docs, id_col, text_col)
    marked = stash(rows.mapInArrow(mark, MARKED), "marked")
    spread = marked.filter("n > 0").select(F.explode("keys").alias("g"), "sid")
    several = spread.groupBy("g").agg(F.count("*").alias("k"), F.min("sid").alias("a"), F.max("sid").alias("b")).filter("a <> b")
    several = stash(several, "several")
    pairs = stash(several.filter("k = 2").select("a", "b").distinct(), "pairs")
    keys = stash(spread.join(several.filter("k > 2").select("g").hint("shuffle_hash"), "g", "left_semi").distinct(), "keys")
    wanted = keys.select("sid").union(pairs.select("a")).union(pairs.select("b")).distinct()
    nodes = stash(marked.join(wanted, "sid", "left_semi").select("sid", "th", "n", "bits").dropDuplicates(["sid"]), "nodes")
    texts = rows.select("th", "raw").join(bounded_broadcast(nodes.select("sid", "th")), "th").dropDuplicates(["sid"])
    sets = stash(texts.select("sid", "raw").mapInArrow(sets_of, "sid bigint, g array<bigint>"), "sets")
    roots = stash(links(nodes, pairs, keys, sets), "roots")
    for t in (several, pairs, keys, nodes, sets):
        drop_stash(t)
    return marked.select("doc_id", "th", "sid").join(roots, F.col("sid") == F.col("node"), "left").select("doc_id", "th", F.coalesce("root", "sid").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns: of each component the row with the smallest id (null ids last; of rows that share it, the
    one with the smallest text hash; of wholly repeated rows, all)."""
    return best_rows(docs, classes(docs, id_col, text_col), id_col, text_col)
