"""Joins that no hot key can stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with so large a share of the rows is heavy; there are as many heavy keys at most.
SHARE = 1000


def join_unique(rows: DataFrame, unique: DataFrame, keys: Sequence[str], weight: str, total: int, share: int = SHARE) -> DataFrame:
    """rows joined with a table that holds each key once, and in ``weight`` how many rows have it (of ``total``).

    Heavy keys, at most ``share`` of them, are sent to every task, so their rows stay where they are; the others meet by
    exchange, where no key has more than a small share of the rows. Both paths give inner joins; null keys meet nothing."""
    heavy = F.col(weight) * share >= total
    mark = f"_{weight}_met"
    few = F.broadcast(unique.filter(heavy).withColumn(mark, F.lit(True)).drop(weight))
    met = rows.join(few, list(keys), "left")
    light = unique.filter(~heavy).drop(weight)
    rest = met.filter(F.col(mark).isNull()).select(*rows.columns).join(light, list(keys))
    first = met.filter(F.col(mark).isNotNull()).drop(mark)
    return first.unionByName(rest)
