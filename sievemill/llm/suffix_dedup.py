"""Substring dedup by bytes, with a suffix array for each shard.

A byte of a text's UTF-8 goes if a string of 400 bytes that covers it also starts anywhere else, in the same text or
another; strings never cross texts and are judged on the input. How they come to shards: see repeats.py. A shard's segments
are joined by a byte that UTF-8 never has; the suffix array is refined after Larsson and Sadakane, common prefixes come
from the ranks of its rounds (suffix.py), and a string is repeated if either neighbour in the array shares 400 bytes. Parts of a split
hash are merged by binary search: the strings of one part are looked up in the other part's array.

Shorter passages that texts share stay, but are reported: ``n_shared`` counts the bytes that strings of 280 bytes cover which
also start elsewhere. Both lengths come from the same common prefixes: segments are made for the shorter strings, and reach
on far enough for the longer ones.

Null text is empty. Texts shorter than 400 bytes are never touched. A removed run may cut a character of several bytes, so
the kept text is binary. Ids that repeat are told apart by the text; a row that repeats wholly is a second place for all its
strings. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import repeats, suffix
from sievemill.llm.common import documents

LENGTH, GRAM = 400, 48
#: Strings of this length that repeat are reported, not removed: passages of 50 words and more are that long.
SHORTER = 280
CAP, SHARD_BYTES = 2048, 320_000
GAP = b"\xff"
#: Bytes that suffixes are first sorted by; four rounds reach 405 from there.
FIRST = 5


def joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each piece begins)."""
    data = np.frombuffer(b"".join(p + GAP for p in pieces), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])[:-1]]).astype(np.int64)


def window_places(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place in it) of all windows. What follows the last window of a segment is there to be compared only: as a
    place it belongs to another segment."""
    seg = np.repeat(np.arange(len(windows)), windows)
    return seg, np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)


def judge(*lengths: int):
    longest = lengths[-1]

    def of(own: tuple[list[bytes], np.ndarray], other: tuple[list[bytes], np.ndarray] | None = None):
        pieces, windows = own
        data, begin = joined(pieces)
        words = suffix.words8(data, longest + 8)
        seg, at = window_places(windows)
        places = begin[seg] + at
        left = np.array([len(p) for p in pieces], np.int64)[seg] - at
        if other is None:
            order, levels = suffix.refined(suffix.packed(data, FIRST), FIRST, longest, places)
            prefix = suffix.shared(words, levels, order, longest)
            hits = [prefix[places] >= x for x in lengths]
        else:
            theirs, their_begin = joined(other[0])
            their_seg, their_at = window_places(other[1])
            order, _ = suffix.refined(suffix.packed(theirs, FIRST), FIRST, longest, their_begin[their_seg] + their_at)
            others = suffix.words8(theirs, longest + 8)
            hits = [suffix.find_equal(others, order, words, places, x) for x in lengths]
        return [ranges(seg, at, hit & (left >= x)) for x, hit in zip(lengths, hits, strict=True)]

    return of


def ranges(seg: np.ndarray, at: np.ndarray, hit: np.ndarray):
    """(segment, lo, hi): runs of hits."""
    seg, at = seg[hit], at[hit]
    if not len(seg):
        return seg, at, at
    new = np.concatenate([[True], (np.diff(seg) != 0) | (np.diff(at) != 1)])
    end = np.concatenate([new[1:], [True]])
    return seg[new], at[new], at[end] + 1


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, cap: int = CAP, shard_bytes: int = SHARD_BYTES, shorter: int = SHORTER) -> DataFrame:
    """(doc_id, n_units, spans, kept, n_shared) for each row: number of bytes, removed byte ranges, kept bytes, bytes that
    repeated strings of ``shorter`` bytes cover. length, shorter: multiples of 8, shorter at most length."""
    if length % 8 or shorter % 8 or not gram < shorter <= length:
        raise ValueError("length and shorter must be multiples of 8, shorter above gram and at most length")
    rows = repeats.rows_of(docs, id_col, text_col)
    lengths = (shorter, length) if shorter < length else (length,)
    spans = repeats.repeated(rows, False, lengths, gram, judge(*lengths), cap, shard_bytes)
    return repeats.remove(rows, spans, False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared")


def _runs(name: str, length: int) -> str:
    """CTEs up to {name} (doc_id, a, b): maximal runs of bytes that repeated strings cover, from d (doc_id, x: hex, n)."""
    return f"""{name}_w AS (SELECT doc_id, i, md5(substring(x, 2 * i + 1, {2 * length})) AS g FROM (SELECT doc_id, x, unnest(range(0, n - {length - 1})) AS i FROM d WHERE n >= {length})),
{name}_r AS (SELECT doc_id, i FROM {name}_w WHERE g IN (SELECT g FROM {name}_w GROUP BY g HAVING count(*) > 1)),
{name}_m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {length} THEN 0 ELSE 1 END AS new FROM {name}_r),
{name}_k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM {name}_m),
{name} AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS b FROM {name}_k GROUP BY doc_id, k)"""


SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
{_runs("gone", LENGTH)},
{_runs("shared", SHORTER)},
pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM gone UNION ALL SELECT doc_id, max(b), 9223372036854775807 FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substring(x, 2 * s + 1, 2 * (least(e, n) - s)), '' ORDER BY s) AS k FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
g AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM gone GROUP BY doc_id),
h AS (SELECT doc_id, sum(b - a)::BIGINT AS n_shared FROM shared GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256, coalesce(n_shared, 0)::BIGINT AS n_shared
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
