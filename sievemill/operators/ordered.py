"""Total orders over whole tables: ranks, prefix sums and carried states without putting the table into one task.

Rows are dealt into ranges of the order and written with their range's number. What a range adds is one row, and only
these rows, as many as there are ranges, meet in one task; each range then goes on from what came before it.

The order should be total: rows that it can't tell apart stand in any order, but all stay. Equal rows land in one range,
so a table in which a third of all rows are equal should be grouped, with counts, before it is ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.sources.scratch import written


def dealt(df: DataFrame, order: Sequence[Column], part: str = "part", parts: int | None = None) -> DataFrame:
    """df with the number of each row's range: all rows of a range come before all of the next one's."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), "ranges")


def before_parts(rows: DataFrame, sums: dict[str, Column], part: str = "part") -> DataFrame:
    """(part, a column for each of sums): what the ranges before a range add up to; zero for the first."""
    per = rows.groupBy(part).agg(*[c.alias(n) for n, c in sums.items()])
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(part, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])


def prefix_sum(df: DataFrame, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """df with the sum of value over all rows that come before a row, itself not counted."""
    rows = dealt(df.withColumn("_value", value), order, "_part")
    start = before_parts(rows, {"_start": F.sum("_value")}, "_part")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = rows.join(F.broadcast(start), "_part").withColumn(out, (F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).cast("long"))
    return met.drop("_part", "_value", "_start")
