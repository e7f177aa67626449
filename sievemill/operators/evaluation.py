"""How good a detector and a pruner are, on labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = r"\[[A-Z_]*REDACTED\]"
GATE_RECALL = 95.0


def ratio(part: Column, whole: Column, empty: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(empty)


def scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, f1) in per cent, two decimals. Nothing found is precise if nothing was to be found."""
    p = ratio(tp, tp + fp, F.when(fn == 0, 1.0).otherwise(0.0))
    r = ratio(tp, tp + fn, F.lit(1.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return tuple(F.round(x * 100, 2) for x in (p, r, f))


def outcomes(samples: DataFrame, truth: DataFrame, scrubbed_col: str = "scrubbed") -> DataFrame:
    """(id, type, hit): a labelled secret is hit if it isn't in the scrubbed text. truth: id, type, raw."""
    return truth.join(samples.select("id", scrubbed_col), "id").select("id", "type", (~F.col(scrubbed_col).contains(F.col("raw"))).alias("hit"))


def false_positives(samples: DataFrame, truth: DataFrame, scrubbed_col: str = "scrubbed") -> DataFrame:
    """(id): samples without any label in which something was masked."""
    return samples.join(truth.select("id"), "id", "left_anti").filter(F.col(scrubbed_col).rlike(MASK)).select("id")


def detector_scores(samples: DataFrame, truth: DataFrame, scrubbed_col: str = "scrubbed") -> DataFrame:
    """A row for each type and one for all (type null): tp, fp, fn and scores. False positives count only for all.

    One pass over the samples: each meets its labels once, and only counts by type go on."""
    rows = samples.select("id", F.col(scrubbed_col).alias("s")).join(truth.select("id", "type", "raw", F.lit(True).alias("known")), "id", "left")
    hit = ~F.col("s").contains(F.col("raw"))
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    by_type = rows.groupBy("known", "type").agg(one(F.col("known") & hit).alias("tp"), one(F.col("known") & ~hit).alias("fn"), one(F.col("known").isNull() & F.col("s").rlike(MASK)).alias("fp"))
    sums = by_type.rollup("known", "type").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp")], F.grouping_id().alias("level"))
    sums = sums.filter("level = 3 or level = 0 and known")
    none = F.lit(0).cast("long")
    sums = sums.select("type", *[F.coalesce(c, none).alias(c) for c in ("tp", "fn")], F.when(F.col("level") == 3, F.coalesce("fp", none)).otherwise(none).alias("fp"))
    p, r, f = scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("type", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def reduction(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Distribution of the per cent of tokens saved: mean, median, p90, min, max, and the per cent saved of all.

    p90 is the value at place min(floor(0.9 n), n - 1) of the sorted ones: the exact order statistic, from a count by
    value (rounded to two decimals), so that no list of all values is made."""
    pct = F.round(F.when(F.col(before) > 0, (F.col(before) - F.col(after)) / F.col(before) * 100.0).otherwise(0.0), 2)
    rows = rows.select(pct.alias("pct"), F.col(before).alias("b"), F.col(after).alias("a"))
    rank = F.least(F.floor(F.lit(0.9) * F.col("n")), F.col("n") - 1)
    by_value = rows.groupBy("pct").agg(F.count("*").alias("c"), F.sum("b").alias("b"), F.sum("a").alias("a"))
    from pyspark.sql import Window

    order, every = Window.orderBy("pct"), Window.partitionBy()
    by_value = by_value.withColumns({"upto": F.sum("c").over(order), "n": F.sum("c").over(every)})
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("pct")))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return by_value.agg(
        F.round(F.sum(F.col("pct") * F.col("c")) / F.sum("c"), 2).alias("mean"), F.round((at(low) + at(high)) / 2, 2).alias("median"), at(rank).alias("p90"),
        F.min("pct").alias("min"), F.max("pct").alias("max"), F.round(F.when(F.sum("b") > 0, (F.sum("b") - F.sum("a")) / F.sum("b") * 100.0).otherwise(0.0), 2).alias("all"), F.sum("c").alias("n"),
    )


def compared(truth: DataFrame, theirs: DataFrame) -> DataFrame:
    """(id, type, raw, found): whether another tool's findings (id, found_text) hold a secret or lie within it."""
    either = (F.col("t.raw").contains(F.col("o.found_text"))) | (F.col("o.found_text").contains(F.col("t.raw")))
    met = truth.alias("t").join(theirs.alias("o"), (F.col("t.id") == F.col("o.id")) & either, "left")
    return met.groupBy("t.id", "t.type", "t.raw").agg(F.max(F.col("o.id").isNotNull()).alias("found"))


def passes(scored: DataFrame) -> DataFrame:
    """(ok): recall of at least 95 per cent and no false positive over all types."""
    return scored.filter(F.col("type").isNull()).select(((F.col("recall") >= GATE_RECALL) & (F.col("fp") == 0)).alias("ok"))
