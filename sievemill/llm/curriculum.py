"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share 150 % of all words by weight. A
target stops at twice its source's size; what is over is shared again by weight among the others until none is above.

Documents of a source stand in a fixed pseudo-random order (md5 of the id). The source's words, in that order, twice over,
are a tape of length twice its size; the mix takes the tape from 0 up to the (rounded) target. A document takes what lies
on its two stretches of tape, so it never gives more than twice its size and the source gives its target.

Curriculum: source i has the weight schedule w_i(t) = target_i * (1 + a_i * (2t - 1)) over training time t in [0, 1], with
a_i from ``slopes`` in turn. Its integral, the cumulative demand, is D_i(t) = target_i * (t + a_i * (t^2 - t)), which ends
at target_i. Each stretch of tape is due at the time at which the demand reaches its start: D_i is inverted in closed form.
The training position is the total demand of all sources by then. ``ordered`` range-sorts the stretches by position.

Prefix sums never put a source into one task: words are summed by (source, bucket), buckets being ranges of the md5 and as
many as the rows need; running sums over buckets give each bucket's start, and a window inside the bucket the rest.

Null text has size 0; null source is a source of its own, the last; null ids come last in their order; rows that repeat
wholly stand next to each other and each is one document. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemill.llm.common import documents, n_words, stash

WEIGHTS = (5, 2, 1)
SHARE = 1.5
SLOPES = (0.5, 0.0, -0.5)
#: Rows that a bucket of one source holds, about.
BUCKET_ROWS = 20_000


def cycle(values, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, slopes=SLOPES) -> DataFrame:
    """(source, source_size, target, slope); sizes has source and source_size, a row for each source.

    A source is full if, with all sources of a smaller ratio of limit to weight full, its share would pass its limit."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    rows = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", cycle(weights, F.col("rank")).cast("long")).withColumn("slope", cycle(slopes, F.col("rank")).cast("double"))
    rows = rows.withColumn("most", F.col("source_size") * 2)
    before = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumns({"full": F.coalesce(F.sum("most").over(before), F.lit(0)), "used": F.coalesce(F.sum("weight").over(before), F.lit(0)), "all_size": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every)})
    left, over = F.col("all_size") * F.lit(share) - F.col("full"), F.col("all_weight") - F.col("used")
    rows = rows.withColumn("is_full", left * F.col("weight") >= F.col("most") * over)
    rows = rows.withColumns({"full": F.coalesce(F.sum(F.when(F.col("is_full"), F.col("most"))).over(every), F.lit(0)), "used": F.coalesce(F.sum(F.when(F.col("is_full"), F.col("weight"))).over(every), F.lit(0))})
    left, over = F.col("all_size") * F.lit(share) - F.col("full"), F.col("all_weight") - F.col("used")
    target = F.when(F.col("is_full"), F.col("most").cast("double")).otherwise(left * F.col("weight") / over)
    return rows.select("source", "source_size", target.alias("target"), "slope")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), order.alias("place"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, slopes=SLOPES) -> DataFrame:
    """A row for each document: doc_id, size, source, source_size, target, taken, first_taken, position, position_again.

    position: that of the first stretch, null if nothing of it is taken; position_again: that of the second."""
    rows = stash(sized(docs, id_col, text_col, source_col), "sized")
    buckets = max(1, rows.count() // BUCKET_ROWS)
    digits = max(1, len(f"{buckets - 1:x}"))
    rows = rows.withColumn("bucket", F.substring("place", 1, digits))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = stash(sums, "sums")
    per_source = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, slopes)
    total = stash(per_source, "targets")
    start = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("source", "bucket", start.alias("start"))
    known = sums.join(total, sums["source"].eqNullSafe(total["source"])).select(sums["source"].alias("s"), F.col("bucket").alias("b"), "start", "source_size", "target", "slope")
    rows = rows.join(known, rows["source"].eqNullSafe(known["s"]) & (rows["bucket"] == known["b"])).drop("s", "b")
    inside = Window.partitionBy("source", "bucket").orderBy("place", F.col("doc_id").isNull(), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    stop = F.round("target").cast("long")
    part = lambda begin: F.greatest(F.lit(0), F.least(F.col("size"), stop - begin)).cast("long")
    first, again = part(F.col("at")), part(F.col("at") + F.col("source_size"))
    schedule = [(r["target"], r["slope"]) for r in total.groupBy("slope").agg(F.sum("target").alias("target")).orderBy("slope").collect()]
    return rows.select(
        "doc_id", "size", "source", "source_size", "target",
        (first + again).alias("taken"), first.alias("first_taken"),
        F.when(first > 0, position(F.col("at"), schedule)).alias("position"),
        F.when(again > 0, position(F.col("at") + F.col("source_size"), schedule)).alias("position_again"),
    )


def due(at: Column, target: Column, slope: Column) -> Column:
    """Time at which the demand target * (t + slope * (t^2 - t)) reaches at: slope * t^2 + (1 - slope) * t = at / target."""
    x, b = at / target, F.lit(1.0) - slope
    root = (F.sqrt(b * b + F.lit(4.0) * slope * x) - b) / (F.lit(2.0) * slope)
    return F.least(F.lit(1.0), F.when(slope == 0, x).otherwise(root))


def position(at: Column, schedule: list[tuple[float, float]]) -> Column:
    """Total demand at the time at which the row's source wants its word number at. schedule: the targets by slope, as
    many as there are slopes."""
    t = due(at.cast("double"), F.col("target"), F.col("slope"))
    total = F.lit(0.0)
    for target, slope in schedule:
        total = total + F.lit(target) * (t + F.lit(slope) * (t * t - t))
    return F.round(total, 3)


def ordered(mixed: DataFrame) -> DataFrame:
    """Training order: a row for each stretch taken (doc_id, source, taken, pass, position), range-sorted by position."""
    part = lambda n, words, at: F.struct(F.lit(n).alias("pass"), words.alias("taken"), F.col(at).alias("position"))
    both = F.array(part(1, F.col("first_taken"), "position"), part(2, F.col("taken") - F.col("first_taken"), "position_again"))
    rows = mixed.select("doc_id", "source", F.explode(F.filter(both, lambda p: p["taken"] > 0)).alias("p")).select("doc_id", "source", "p.*")
    return rows.orderBy("position", "doc_id", "pass")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position", "position_again").orderBy("position", "doc_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS most, (CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight, CASE rank % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0::DOUBLE ELSE -0.5::DOUBLE END AS slope, sum(source_size) OVER ()::DOUBLE * 1.5 AS budget
      FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s)),
fill AS (
  SELECT 0 AS round, source, source_size, most, weight, slope, budget, false AS is_full FROM w
  UNION ALL
  SELECT round + 1, source, source_size, most, weight, slope, budget,
         is_full OR (budget - coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0)::DOUBLE) * weight >= most * coalesce(sum(CASE WHEN NOT is_full THEN weight END) OVER (), 0)::DOUBLE
  FROM fill WHERE round < 60),
f AS (SELECT * FROM fill WHERE round = 60),
t AS (SELECT source, source_size, slope, CASE WHEN is_full THEN most::DOUBLE ELSE
        (budget - coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0)::DOUBLE) * weight / coalesce(sum(CASE WHEN NOT is_full THEN weight END) OVER (), 0)::DOUBLE END AS target FROM f),
a AS (SELECT d.*, source_size, slope, target, round(target)::BIGINT AS stop,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, greatest(0, least(size, stop - at_)) AS p1, greatest(0, least(size, stop - at_ - source_size)) AS p2,
        at_::DOUBLE / target AS x1, (at_ + source_size)::DOUBLE / target AS x2, 1.0::DOUBLE - slope AS b FROM a),
y AS (SELECT *, least(1.0::DOUBLE, CASE WHEN slope = 0 THEN x1 ELSE (sqrt(greatest(0, b * b + 4.0::DOUBLE * slope * x1)) - b) / (2.0::DOUBLE * slope) END) AS t1,
             least(1.0::DOUBLE, CASE WHEN slope = 0 THEN x2 ELSE (sqrt(greatest(0, b * b + 4.0::DOUBLE * slope * x2)) - b) / (2.0::DOUBLE * slope) END) AS t2 FROM x),
g AS (SELECT coalesce(sum(target) FILTER (slope = -0.5), 0) AS g1, coalesce(sum(target) FILTER (slope = 0), 0) AS g2, coalesce(sum(target) FILTER (slope = 0.5), 0) AS g3 FROM t)
SELECT doc_id, size, source_size, target, (p1 + p2)::BIGINT AS taken,
  CASE WHEN p1 > 0 THEN round(g1 * (t1 - 0.5 * (t1 * t1 - t1)) + g2 * t1 + g3 * (t1 + 0.5 * (t1 * t1 - t1)), 3) END AS position,
  CASE WHEN p2 > 0 THEN round(g1 * (t2 - 0.5 * (t2 * t2 - t2)) + g2 * t2 + g3 * (t2 + 0.5 * (t2 * t2 - t2)), 3) END AS position_again
FROM y, g
"""
