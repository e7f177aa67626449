"""Windows of texts that stand elsewhere too: the steps that substring dedup by words and by bytes have in common.

1. Every text is cut into minimiser segments (segments.py); a segment is kept as two hashes and its place.
2. Segments whose minimiser hash occurs once are dropped: no window in them stands elsewhere.
3. Segments of equal content are counted and one stands for all. If there are several, all its windows are repeated.
4. Distinct segments that share a minimiser hash are fetched from their texts and dealt to shards by that hash. A shard's
   index finds the windows that occur twice in it (fm_index.py, suffix.py).
5. A hash with more than ``cap`` distinct segments is split into parts by content. Each part has its own index, and every
   part's segments are also looked up in each other part's index, so memory is bounded and nothing is lost.
6. The found ranges go back to all places of their segments, and to the texts.

Intermediate tables are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import drop_stash, keyed, stash
from sievemill.llm.segments import BYTES, segments, word_units

BLOCK = 1 << 20
PLACES = "doc_id bigint, th bigint, h bigint, s bigint, first bigint, windows int, size int"
FOUND = "h bigint, s bigint, level int, lo int, hi int"


def scanner(by_words: bool, lengths: tuple[int, ...], gram: int) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th, raw = batch.column("doc_id"), batch.column("th"), batch.column("raw")
            sizes = np.array(pa.compute.binary_length(raw), np.int64)
            ends = np.cumsum(sizes)
            a = 0
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + BLOCK, side="right")))
                part = raw.slice(a, b - a)
                offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
                data = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
                offsets = offsets - offsets[0]
                units, starts = word_units(data, offsets) if by_words else (BYTES[data], offsets)
                text, first, windows, size, h, s = segments(units, starts, lengths[0], gram, lengths[-1])
                at = pa.array(text + a)
                yield pa.RecordBatch.from_arrays([doc.take(at), th.take(at), pa.array(h), pa.array(s), pa.array(first), pa.array(windows.astype(np.int32)), pa.array(size.astype(np.int32))], ["doc_id", "th", "h", "s", "first", "windows", "size"])
                a = b

    return scan


def cutter(by_words: bool) -> Callable:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw, asked in zip(batch["raw"], batch["asked"], strict=True):
                words = raw.split() if by_words else None
                for x in asked:
                    end = x["first"] + x["size"]
                    piece = b" ".join(words[x["first"] : end]) if by_words else raw[x["first"] : end]
                    out.append((x["h"], x["s"], x["k"], x["windows"], piece))
            yield pd.DataFrame(out, columns=["h", "s", "k", "windows", "piece"])

    return cut


def repeated(docs: DataFrame, by_words: bool, lengths: tuple[int, ...], gram: int, judge: Callable, cap: int, shard_units: int) -> DataFrame:
    """(doc_id, th, spans0, spans1, ...): texts with repeated windows. spans of a level: [a, b) ranges of units that repeated
    windows of that level's length cover (sorted by a, they may overlap). docs: as keyed() gives them; lengths: windows'
    lengths, the shortest first.

    judge(own, other=None) -> for each level (segment, lo, hi) arrays: of own's segments (pieces, windows) the ranges of
    places whose windows occur twice in own or, where other (the same) is given, once in other."""
    raw = docs.select("doc_id", "th", F.col("text").cast("binary").alias("raw"))
    places = stash(raw.mapInArrow(scanner(by_words, lengths, gram), PLACES), "places")
    # written first, so that both sides of the join are plain exchanges and a hot hash is split
    often = stash(places.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "often")
    likely = stash(places.join(often.hint("shuffle_hash"), "h", "left_semi"), "likely")
    drop_stash(places)
    drop_stash(often)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "th", "first", "windows", "size")).alias("one")
    kinds = stash(likely.groupBy("h", "s").agg(F.count("*").alias("n"), one), "kinds")
    shared = stash(kinds.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1"), "shared")
    alike = stash(kinds.join(shared.hint("shuffle_hash"), "h").select("h", "s", "k", "one.*"), "alike")
    asked = alike.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "s", "k", "first", "windows", "size")).alias("asked"))
    d, a = raw.alias("d"), asked.alias("a")
    met = d.join(a.hint("shuffle_hash"), F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("d.th") == F.col("a.th")))
    pieces = stash(met.select("raw", "asked").mapInPandas(cutter(by_words), "h bigint, s bigint, k bigint, windows int, piece binary"), "pieces")
    units = alike.agg(F.sum("size")).first()[0] or 0
    shards = int(max(1, -(-units // shard_units)))
    parts, part = F.ceil(F.col("k") / cap), lambda p: F.pmod(F.col("s"), p)
    place = lambda g, own, other, role: F.struct(g.alias("g"), own.cast("long").alias("own"), other.cast("long").alias("other"), F.lit(role).alias("role"))
    none = F.lit(-1)
    every = F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))
    hot = F.flatten(F.transform(every, lambda q: F.array(place(F.col("h"), part(parts), q, 0), place(F.col("h"), q, part(parts), 1))))
    hot = F.array_distinct(F.transform(hot, lambda x: F.when(x["own"] == x["other"], place(x["g"], x["own"], x["other"], 0)).otherwise(x)))
    dealt = pieces.withColumn("to", F.explode(F.when(parts > 1, hot).otherwise(F.array(place(F.pmod("h", F.lit(shards)), none, none, 0))))).select("h", "s", "windows", "piece", "to.*")

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["h", "s", "role"])
        own = rows[rows["role"] == 0]
        apart = rows["own"].iloc[0] != rows["other"].iloc[0]
        other = rows[rows["role"] == 1] if apart else None
        if not len(own) or apart and not len(other):
            return pd.DataFrame({"h": [], "s": [], "level": [], "lo": [], "hi": []})
        parts = [(x["piece"].tolist(), x["windows"].to_numpy(np.int64)) for x in (own, other) if x is not None]
        found = judge(*parts)
        rows = [pd.DataFrame({"h": own["h"].to_numpy()[seg], "s": own["s"].to_numpy()[seg], "level": level, "lo": lo, "hi": hi}) for level, (seg, lo, hi) in enumerate(found)]
        return pd.concat(rows, ignore_index=True)

    judged = dealt.groupBy("g", "own", "other").applyInPandas(group, FOUND)
    ends = F.array(*[F.struct(F.lit(i).alias("level"), F.least("one.windows", F.col("one.size") - x + 1).alias("hi")) for i, x in enumerate(lengths)])
    whole = kinds.filter("n > 1").select("h", "s", F.explode(ends).alias("e")).filter("e.hi > 0").select("h", "s", "e.level", F.lit(0).alias("lo"), "e.hi")
    runs = stash(judged.union(whole).groupBy("h", "s").agg(F.collect_set(F.struct("level", "lo", "hi")).alias("runs")), "runs")
    back = likely.join(runs, ["h", "s"]).select("doc_id", "th", "first", F.explode("runs").alias("r"))
    long = F.element_at(F.array(*map(F.lit, lengths)), F.col("r.level") + 1)
    span = F.struct((F.col("first") + F.col("r.lo")).alias("a"), (F.col("first") + F.col("r.hi") - 1 + long).alias("b"))
    spans = [F.array_sort(F.collect_set(F.when(F.col("r.level") == i, span))).alias(f"spans{i}") for i in range(len(lengths))]
    out = stash(back.groupBy("doc_id", "th").agg(*spans), "spans")
    for t in (likely, kinds, shared, alike, pieces, runs):
        drop_stash(t)
    return out


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (as keyed() gives them) with the ranges of each level, null where there are none."""
    d, s = docs.alias("d"), spans.alias("s")
    met = d.join(s.hint("shuffle_hash"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.th") == F.col("s.th")), "left")
    return met.select("d.doc_id", F.col("d.text").cast("binary").alias("raw"), *[f"s.{c}" for c in spans.columns if c.startswith("spans")])


def united(spans) -> list[tuple[int, int]]:
    """Sorted [a, b) ranges, overlapping and touching ones made one."""
    out: list[list[int]] = []
    for x in spans if spans is not None else ():
        if out and x["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["b"])
        else:
            out.append([x["a"], x["b"]])
    return [tuple(x) for x in out]


def remove(docs: DataFrame, spans: DataFrame, by_words: bool) -> DataFrame:
    """(doc_id, n_units, spans, kept, n_shared): the operators' real output: what the longest windows cover is removed; kept
    bytes (words joined by one space); how many units the shortest windows cover."""
    levels = [c for c in spans.columns if c.startswith("spans")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, runs, kept, shared = [], [], [], []
            for raw, short, found in zip(batch["raw"], batch[levels[0]], batch[levels[-1]], strict=True):
                units = raw.split() if by_words else raw
                gone = united(found)
                left, at = [], 0
                for a, b in gone:
                    left.append(units[at:a])
                    at = b
                left.append(units[at:])
                sizes.append(len(units))
                runs.append([{"a": a, "b": b} for a, b in gone])
                kept.append(b" ".join(w for x in left for w in x) if by_words else b"".join(left))
                shared.append(sum(b - a for a, b in united(short)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_units": sizes, "spans": runs, "kept": kept, "n_shared": shared})

    return with_spans(docs, spans).mapInPandas(cut, "doc_id bigint, n_units bigint, spans array<struct<a:bigint,b:bigint>>, kept binary, n_shared bigint")


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
