"""Exact quantiles of large columns without gathering them in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 200_000
BINS = 1024


def exact_quantiles(df: DataFrame, column: str, qs: list[float], small: int = SMALL) -> list[float | None]:
    """Quantiles with linear interpolation at (n - 1) q over the non-null, non-NaN values of a numeric column.

    A histogram of ``BINS`` bins finds the bin that holds each rank; it is cut
    finer until it holds at most ``small`` values, which then go through the
    exact aggregate. None for a column without values.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    row = values.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n = row["n"]
    if not n:
        return [None for _ in qs]

    def at_rank(rank: int) -> float:
        lo, hi, below, inside = row["lo"], row["hi"], 0, n
        part = values
        while inside > small and lo < hi:
            width = (hi - lo) / BINS
            bin_of = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(BINS - 1))
            counts = part.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
            for b in sorted(counts, key=lambda r: r["bin"]):
                if below + b["c"] > rank:
                    lo, hi, inside = b["a"], b["b"], b["c"]
                    break
                below += b["c"]
            part = values.filter(F.col("v").between(lo, hi))
        if lo == hi:
            return lo
        place = (rank - below) / (inside - 1) if inside > 1 else 0.0
        return part.agg(F.percentile("v", F.lit(min(max(place, 0.0), 1.0)))).first()[0]

    if n <= small:
        told = values.agg(F.percentile("v", F.array(*[F.lit(float(q)) for q in qs]))).first()[0]
        return list(told)
    out = []
    for q in qs:
        place = (n - 1) * q
        low = at_rank(math.floor(place))
        high = low if place == math.floor(place) else at_rank(math.floor(place) + 1)
        out.append(low + (high - low) * (place - math.floor(place)))
    return out


def exact_medians(df: DataFrame, columns: list[str], small: int = SMALL) -> dict[str, float | None]:
    """The exact median of several columns: in one aggregate while the rows are few, each by :func:`exact_quantiles` beyond."""
    if df.select(*columns).limit(small + 1).count() <= small:
        row = df.agg(*[F.percentile(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.5)).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns}
    return {c: exact_quantiles(df, c, [0.5], small)[0] for c in columns}
