"""Statistics across the columns of a row, as array expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(values: list[Column]) -> Column:
    """The row's non-null values, sorted."""
    return F.array_sort(F.array_compact(F.array(*values)))


def row_quantile(values: list[Column], q: float) -> Column:
    """Quantile with linear interpolation at (n - 1) q over the non-null values; null where there are none."""
    return array_quantile(present(values), q)


def array_quantile(ordered: Column, q: float) -> Column:
    size = F.size(ordered)
    at = (size - 1) * F.lit(float(q))
    low = F.floor(at).cast("int")
    high = F.ceil(at).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, high)
    return F.when(size > 0, below + (above - below) * (at - low))


def row_median(values: list[Column]) -> Column:
    return row_quantile(values, 0.5)


def row_absmax(values: list[Column]) -> Column:
    """Largest absolute value among the non-null ones."""
    return F.array_max(F.transform(F.array_compact(F.array(*values)), lambda x: F.abs(x)))


def row_count(values: list[Column]) -> Column:
    return F.size(F.array_compact(F.array(*values)))
