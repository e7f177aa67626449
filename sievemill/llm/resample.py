"""Importance resampling of documents towards a target distribution, over hashed features.

Features of a text are its words and runs of consecutive words up to a length; each falls into one of a fixed number of
buckets. A bucket's gain is the logarithm of how much more often the target has it than the source, with one added to
every count. A document's weight is the mean gain of its features; weight plus Gumbel noise, drawn from a hash of the
document's id, is its score, and drawing the highest scores is drawing without replacement by weight.

Scoring explodes nothing: higher-order functions make each document's array of buckets, which is written once, and its
weight is an aggregate over element_at of a literal array that holds all gains (as many entries as there are buckets).
Counting the buckets adds up inside the tasks first, so only totals are shuffled and sent to the driver, a row for each
bucket at most. Ranks come from ranges of the order, not from one sorted task; only documents that can be drawn are
sorted at all. Documents that are alike in all columns of the result are ranked as one row with a count, so copies of one
row don't meet in one range.

Null and empty texts have no features and weight 0; they are scored, but have too few words to be drawn. A null id is
hashed as an empty string and comes last among ties. Rows that repeat are documents of their own and get ranks of their
own. An empty table gives an empty result; an empty target, or one of null texts, gives all buckets a count of 0 there.
Other columns are ignored by ``scored`` and kept by ``draw``, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import ascii_lower, bounded_broadcast, documents, stash, unused
from sievemill.llm.decontaminate import words_of
from sievemill.operators.ordered import prefix_sum

BUCKETS, LONGEST_RUN = 10_000, 1
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024
SCALE = 1000
#: Copies of a row that are written out as one array.
AT_ONCE = 65_536


def buckets_of(words: Column, n: int, longest: int) -> Column:
    """Buckets of all runs of 1 to ``longest`` words."""
    bucket = lambda s: (F.crc32(s) % n).cast("int")

    def runs(size: int) -> Column:
        starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, size), " ")))

    singles = F.transform(words, bucket)
    return singles if longest == 1 else F.concat(singles, *[runs(size) for size in range(2, longest + 1)])


def features(docs: DataFrame, id_col: str, text_col: str, n: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """(doc_id, n_words, buckets)."""
    words = words_of(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("words"))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), buckets_of(F.col("words"), n, longest).alias("buckets"))


def totals(rows: DataFrame, n: int) -> np.ndarray:
    """How often each bucket occurs. Partial counts are made where the rows are; n rows at most come here."""
    out = np.zeros(n)
    for r in rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect():
        out[r["bucket"]] = r["count"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored gain of every bucket, in thousandths."""
    n = len(source)
    ratio = lambda s, t: (t + 1.0) * (source.sum() + n) / ((s + 1.0) * (target.sum() + n))
    return np.array([math.floor(SCALE * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Floored Gumbel noise, in thousandths, from the first 32 bits of a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", n: int = BUCKETS, longest: int = LONGEST_RUN, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score): a row for each document, written to the shared folder."""
    rows = stash(features(docs, id_col, text_col, n, longest), "features")
    aim = features(target, target_text, target_text, n, longest)
    gain = F.lit(gains(totals(rows, n), totals(aim, n)))
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(gain, b + 1))
    rows = rows.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), total.alias("total"))
    floored = F.expr("(total - pmod(total, n_features)) div n_features")
    rows = rows.select("doc_id", "n_words", "n_features", F.when(F.col("n_features") > 0, floored).otherwise(F.lit(0)).cast("long").alias("weight"))
    return stash(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")


def ranked(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """rows of ``scored`` with their rank among those drawn; null for the others.

    The table of scores has a row for each floored score, whose range doesn't grow with the documents."""
    long_enough = F.col("n_words") >= least_words
    per_score = stash(rows.filter(long_enough).groupBy("score").count(), "score-counts")
    wanted = (per_score.agg(F.sum("count")).first()[0] or 0) * percent // 100
    above = prefix_sum(per_score, [F.col("score").desc()], F.col("count"), "above")
    least = above.filter(F.col("above") < wanted).agg(F.min("score")).first()[0]
    none = F.lit(None).cast("long").alias("rank")
    if least is None:
        return rows.select("*", none)
    may = long_enough & (F.col("score") >= least)
    same = rows.filter(may).groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("n_words").asc()]
    placed = prefix_sum(same, order, F.col("copies"), "before")
    last = F.col("before") + F.col("copies")
    steps = placed.select(*rows.columns, last.alias("last"), F.explode(F.sequence(F.col("before") + 1, last, F.lit(AT_ONCE).cast("long"))).alias("first"))
    each = steps.select(*rows.columns, F.explode(F.sequence("first", F.least("last", F.col("first") + (AT_ONCE - 1)))).alias("place"))
    drawn = each.select(*rows.columns, F.when(F.col("place") <= wanted, F.col("place")).alias("rank"))
    return rows.filter(~may).select("*", none).unionByName(drawn)


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Rows of docs, all columns, whose id is drawn, with its rank; ids should be unique."""
    name = unused(docs, "drawn")
    rows = ranked(scored(docs, target, id_col, text_col, target_text), percent=percent).filter("rank is not null")
    few = bounded_broadcast(stash(rows.groupBy("doc_id").agg(F.min("rank").alias("rank")).select(F.struct("doc_id", "rank").alias(name)), "drawn"))
    met = docs.join(few, docs[id_col].eqNullSafe(few[name]["doc_id"]))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(name)["rank"].alias(unused(docs, "rank")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
#: CRC-32 (reversed polynomial 0xEDB88320), byte by byte, one step of recursion for each byte of the longest word.
SQL = rf"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS n FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM bits WHERE n < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE n = 8),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS w FROM d),
bw AS (SELECT unnest(w) AS w FROM b),
vocab AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
crc AS (
  SELECT w, h, 1 AS p, 4294967295::BIGINT AS c FROM vocab
  UNION ALL SELECT w, h, p + 2, xor(c >> 8, tab[(xor(c, concat('0x', substring(h, p, 2))::BIGINT) & 255) + 1]) FROM crc, tab WHERE p <= length(h)),
hashed AS (SELECT w, xor(c, 4294967295) % 10000 AS k FROM crc WHERE p > length(h)),
s AS (SELECT k, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM bw JOIN hashed USING (w) GROUP BY k),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
gain AS (SELECT k, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000) / ((s::DOUBLE + 1) * (tt + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (k), total),
sums AS (SELECT doc_id, sum(g)::BIGINT AS g FROM dw JOIN hashed USING (w) JOIN gain USING (k) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE ((g - ((g % len(w)) + len(w)) % len(w)) // len(w)) END::BIGINT AS weight,
        concat('0x', substring(sha256(concat('2024:', coalesce(d.doc_id::VARCHAR, ''))), 1, 8))::BIGINT::DOUBLE AS h FROM d LEFT JOIN sums USING (doc_id)),
sc AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS wanted FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= wanted THEN place END::BIGINT AS "rank" FROM r
"""
