"""Benchmark decontamination with a broadcast hash set of normalised test windows.

Normal form: A-Z lower-cased, then maximal runs of digits, lower-case letters and non-ASCII characters are words. A
benchmark item of ten words or more gives every window of ten consecutive words; a shorter one that isn't empty is a
window by itself. A document is scanned once: every window of its words, of each length that test windows have, is looked
up by its hash in the set, a hash of word hashes, and what is found is compared word by word. Spans of verified windows are
united per document. Generating, looking up and comparing are one stage, so windows that aren't in the set are never
written anywhere.

The set is broadcast only while its measured size is at most ``broadcast_bytes``; beyond that the join is by exchange on
the hash. Only DataFrame functions are used.

Null and empty texts have no words and no hits. Ids that repeat are told apart by the text; rows that repeat wholly give
equal rows. Benchmark items with a null text give no window; a null item id is written as an empty string. Empty tables
on either side work; columns other than the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import ascii_lower, bounded_broadcast, documents, stash, unused

WINDOW = 10
BROADCAST_BYTES = 64 << 20
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text that ascii_lower has folded."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def window_hash(hashes: Column, at: Column, n: int | Column) -> Column:
    """Hash of n words from a place on (from 0), from the words' hashes."""
    return F.xxhash64(F.slice(hashes, at + 1, n))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def windows(benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(win, n, h, items): distinct windows as joined words, their number, their hash, and the items that have them."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words_of(ascii_lower(F.coalesce(F.col(text_col), F.lit("")))).alias("words")).filter("size(words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    rows = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, size))).alias("w"))
    return rows.groupBy(F.array_join("w", " ").alias("win"), F.size("w").alias("n"), F.xxhash64(hashes_of(F.col("w"))).alias("h")).agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def scan(docs: DataFrame, wins: DataFrame, id_col: str, text_col: str, broadcast_bytes: int) -> DataFrame:
    """(doc_id, th, n_words, s, e, items): a row for each document row, with nulls, and one for each window that it has."""
    sizes, bytes_ = wins.agg(F.array_sort(F.collect_set("n")), F.sum(F.octet_length("win") + F.size("items") * 16 + 64)).first()
    wins = F.broadcast(wins) if (bytes_ or 0) <= broadcast_bytes else wins.hint("shuffle_hash")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), words_of(ascii_lower(F.coalesce(F.col(text_col), F.lit("")))).alias("words"))
    rows = rows.withColumn("hashes", hashes_of(F.col("words")))
    place = lambda i, h: F.struct(i.cast("int").alias("s"), h.alias("h"))

    def places(n: int) -> Column:
        starts = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: place(i, window_hash(F.col("hashes"), i, n)))

    mark = F.array(place(F.lit(-1), F.lit(None).cast("bigint")))
    rows = rows.select("doc_id", "th", "words", F.explode(F.concat(mark, *[places(n) for n in sizes])).alias("p")).select("doc_id", "th", "words", "p.s", "p.h")
    met = rows.join(wins, "h", "left")
    same = F.array_join(F.slice("words", F.col("s") + 1, F.col("n")), " ") == F.col("win")
    met = met.filter((F.col("s") < 0) | F.col("win").isNotNull() & same)
    found = lambda c: F.when(F.col("s") >= 0, c)
    return met.select("doc_id", "th", F.size("words").alias("n_words"), found(F.col("s")).alias("s"), found(F.col("s") + F.col("n")).alias("e"), found(F.col("items")).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row per input row: doc_id, th, n_words, spans (disjoint [s, e) word ranges, sorted), items (sorted ids).

    What a group holds is bounded by the length of one document times the number of its copies under the same id."""
    rows = scan(docs, windows(benchmark, size), id_col, text_col, broadcast_bytes)
    groups = rows.groupBy("doc_id", "th", "n_words").agg(
        F.sum(F.col("s").isNull().cast("long")).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s", "e")))).alias("pairs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    pair = "struct<s:int,e:int>"
    empty = F.array().cast(f"array<{pair}>")
    merged = F.aggregate(
        F.col("pairs").cast(f"array<{pair}>"),
        empty,
        lambda acc, p: F.when((F.size(acc) > 0) & (p["s"] <= F.element_at(acc, -1)["e"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], p["e"]).alias("e")).cast(pair)))).otherwise(F.concat(acc, F.array(p))),
    )
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return groups.select("doc_id", "th", "n_words", merged.alias("spans"), "items", each.alias("copy")).drop("copy")


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    found = hits(docs, benchmark, size)
    n_hit = F.aggregate("spans", F.lit(0), lambda acc, p: acc + p["e"] - p["s"]).cast("long")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def hit_rows(docs: DataFrame, benchmark: DataFrame, size: int, id_col: str, text_col: str) -> tuple[DataFrame, str, Column]:
    """(one column with (doc_id, th, spans) of rows with hits, its name, which of docs' rows it means)."""
    name = unused(docs, "hit")
    bad = hits(docs, benchmark, size, id_col, text_col).filter("size(spans) > 0").select(F.struct("doc_id", "th", "spans").alias(name)).distinct()
    bad = bounded_broadcast(stash(bad, "hits"))
    return bad, name, docs[id_col].eqNullSafe(bad[name]["doc_id"]) & (F.xxhash64(docs[text_col]) == bad[name]["th"])


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, in which no window occurs."""
    bad, _, same = hit_rows(docs, benchmark, size, id_col, text_col)
    return docs.join(bad, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns; where windows occur, text is its normal form without the hit words."""
    bad, name, same = hit_rows(docs, benchmark, size, id_col, text_col)
    spans = F.col(name)["spans"]
    left = F.filter(words_of(ascii_lower(F.col(text_col))), lambda w, i: ~F.exists(spans, lambda p: (p["s"] <= i) & (i < p["e"])))
    return docs.join(bad, same, "left").withColumn(text_col, F.when(spans.isNull(), F.col(text_col)).otherwise(F.array_join(left, " "))).select([F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_FOLD}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array({_FOLD}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
