"""What the operators on vectors share: integer components from floats, and equal vectors met in bounded ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums of products of components must stay exact in a double.
EXACT = 2.0**53


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """Every component, as a double, times scale, rounded down."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))


def shape(rows: DataFrame, col: str) -> tuple[int, int, int]:
    """(rows, longest vector, largest magnitude); raises if inner products of such vectors aren't exact in doubles."""
    most = F.greatest(F.coalesce(F.array_max(col), F.lit(0)), -F.coalesce(F.array_min(col), F.lit(0)))
    n, longest, largest = rows.agg(F.count("*"), F.coalesce(F.max(F.size(col)), F.lit(0)), F.coalesce(F.max(most), F.lit(0))).first()
    if 4.0 * longest * float(largest) ** 2 > EXACT:
        raise ValueError(f"components of up to {largest} in {longest} dimensions: their products aren't exact in doubles")
    return n, longest, int(largest)


def padded(vector: Column, length: int) -> Column:
    """Zeros added up to a length."""
    return F.concat(vector, F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size(vector)))
