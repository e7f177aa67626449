"""Substring dedup by words, with an FM-index for each shard.

Words are runs of anything but ASCII white space. A word goes if a window of 35 consecutive words that covers it also
starts anywhere else, in the same text or another; windows are judged on the input. How windows come to shards: see
repeats.py. A shard's index is a Burrows-Wheeler transform of its segments in a packed wavelet matrix (fm_index.py). The
segments are streamed against it: backward search from a segment's right end gives the longest suffix that occurs often
enough (its matching statistic), and all windows inside that suffix are reported; what is left is searched again from the
other end, where a failure rules out all windows that hold the failing part.

Null text has no words. Texts with fewer than 35 words are never touched. Ids that repeat are told apart by the text; a row
that repeats wholly is a second place for all its windows, so both rows lose them. Empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import repeats
from sievemill.llm.common import documents
from sievemill.llm.fm_index import FMIndex

LENGTH, GRAM = 35, 8
#: Distinct segments of one minimiser hash that one index takes; words that a shard takes, about.
CAP, SHARD_WORDS = 8192, 400_000


def judge(length: int):
    def of(own: tuple[list[bytes], np.ndarray], other: tuple[list[bytes], np.ndarray] | None = None):
        pieces, windows = own
        rows = [p.split() for p in pieces]
        index_rows = rows if other is None else [p.split() for p in other[0]]
        flat = [w for r in index_rows for w in (*r, b"")]
        codes, names = pd.factorize(np.array(flat, object))
        # 0 ends a row; words follow
        number = {w: i + 1 for i, w in enumerate(n for n in names if n)}
        number[b""] = 0
        text = np.array([number[n] for n in names], np.int64)[codes]
        longest = max(len(r) for r in rows)
        index = FMIndex(text, max(longest, length))
        if other is None:
            query = text
            begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in rows])[:-1]]).astype(np.int64)
        else:
            query = np.array([number.get(w, -1) for r in rows for w in r], np.int64)
            begin = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]]).astype(np.int64)
        return [report(index, query, begin, windows, length, 2 if other is None else 1)]

    return of


def report(index: FMIndex, query: np.ndarray, begin: np.ndarray, windows: np.ndarray, length: int, least: int):
    """(segment, lo, hi): window ranges of each segment, of all windows that occur ``least`` times."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    seg = np.arange(len(begin))
    first, last = np.zeros(len(begin), np.int64), windows - 1
    while len(seg):
        at = begin[seg]
        t = index.search(query, at + first, at + last + length, least) - at
        good = np.minimum(t, last) < last
        found.append((seg[good], np.maximum(t, first - 1)[good] + 1, last[good] + 1))
        last = np.where(t < last, t, last - 1)
        on = last >= first
        seg, first, last = seg[on], first[on], last[on]
        if not len(seg):
            break
        at = begin[seg]
        t = index.search(query, at + first, at + first + length, least) - at
        hit = t < first
        found.append((seg[hit], first[hit], first[hit] + 1))
        first = np.where(hit, first + 1, t + 1)
        on = last >= first
        seg, first, last = seg[on], first[on], last[on]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, cap: int = CAP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_units, spans, kept) for each row: number of words, removed word ranges, kept words as UTF-8."""
    rows = repeats.rows_of(docs, id_col, text_col)
    spans = repeats.repeated(rows, True, (length,), gram, judge(length), cap, shard_words)
    return repeats.remove(rows, spans, True).drop("n_shared")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return out.select("doc_id", F.col("n_units").alias("n_words"), removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM rep),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM pos GROUP BY doc_id),
kept AS (SELECT d.doc_id, string_agg(word, ' ' ORDER BY p) AS k FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) d
         WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.doc_id = d.doc_id AND pos.p = d.p) GROUP BY d.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
