"""Filters by lists and thresholds, identifiers by digest, splits, and the assembly of final results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds_any(text: Column, parts: list[str]) -> Column:
    """Whether the text holds any of the parts, in any case; a null text holds none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for part in parts:
        out = out | low.contains(part.lower())
    return out


def digits(text: Column) -> Column:
    """How many ASCII digits a text has; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(text, "[^0-9]", "")), F.lit(0))


def keyword_lists(
    scored: DataFrame,
    category: str,
    keyword: str,
    frequency: str,
    score: str,
    specificity: str,
    least: int = 5,
    broad: tuple[float, float] = (0.8, 0.7),
    strict: tuple[float, float] = (0.9, 0.8),
) -> DataFrame:
    """(keyword, category, list) with list "broad" or "strict": keywords at or above both thresholds, of at least ``least`` occurrences.

    A strict keyword is a broad one, too. Nulls pass no threshold.
    """
    kept = scored.filter(F.col(frequency) >= least)

    def passing(name: str, limits: tuple[float, float]) -> DataFrame:
        return kept.filter((F.col(score) >= limits[0]) & (F.col(specificity) >= limits[1])).select(keyword, category, F.lit(name).alias("list"))

    return passing("broad", broad).unionAll(passing("strict", strict))


def without_listed(rows: DataFrame, column: str, listed: DataFrame, listed_column: str) -> DataFrame:
    """Rows whose value is not listed, whatever its case; null values stay."""
    known = listed.select(F.lower(listed_column).alias("__listed")).filter("__listed is not null").distinct()
    return rows.join(known, F.lower(F.col(column)) == F.col("__listed"), "left_anti")


def md5_group(key: Column, modulus: int = 1_000_000_000) -> Column:
    """The MD5 of a key as a number, modulo ``modulus``; null for a null key.

    Its 32 hexadecimal digits are taken four at a time, so no step exceeds a
    64-bit integer.
    """
    digest = F.md5(key.cast("binary"))
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    return F.when(key.isNotNull(), F.aggregate(words, F.lit(0).cast("bigint"), lambda rest, word: (rest * 65536 + word) % modulus))


def ranged(numbered: DataFrame, place: str, start: int = 1, stop: int | None = None) -> DataFrame:
    """Rows from place ``start`` to ``stop``, both included; ``place`` counts from 1 and is pushed down to the scan."""
    kept = numbered.filter(F.col(place) >= start)
    return kept if stop is None else kept.filter(F.col(place) <= stop)


def stratified_split(df: DataFrame, key: str, stratum: str, share: float, seed: int = 42) -> DataFrame:
    """Add ``part``: "test" for the rows of the smallest hashes of each stratum, ``share`` of it rounded down, else "train".

    Ranks need one task per stratum and hash bucket only: bucket counts first
    tell how many rows of each bucket are test rows.
    """
    from pyspark.sql import Window

    h = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 1)
    rows = df.withColumn("__h", h).withColumn("__bucket", F.shiftright("__h", 51))  # 4,096 buckets
    counts = rows.groupBy(stratum, "__bucket").agg(F.count("*").alias("__n"))
    order = Window.partitionBy(stratum).orderBy("__bucket")
    before = F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    total = F.sum("__n").over(Window.partitionBy(stratum))
    quota = counts.select(F.col(stratum).alias("__s"), F.col("__bucket").alias("__b"), (F.floor(total * F.lit(share)) - before).alias("__left"))
    joined = rows.join(quota, rows[stratum].eqNullSafe(quota["__s"]) & (F.col("__bucket") == F.col("__b")))
    place = F.row_number().over(Window.partitionBy(stratum, "__bucket").orderBy("__h", key))
    return joined.withColumn("part", F.when(place <= F.col("__left"), "test").otherwise("train")).select(*df.columns, "part")


def final_results(companies: DataFrame, key: str, real: DataFrame, synthetic: DataFrame, factor: float, columns: list[str]) -> DataFrame:
    """Companies with the real estimates, the synthetic ones and these adjusted by ``factor``; a company may have either, both or none.

    Both tables have ``key`` once. Missing synthetic values are 0. Null keys match nothing.
    """
    one = real.select(key, *[F.col(c).alias(f"real_{c}") for c in columns])
    two = synthetic.select(key, *[F.col(c).alias(f"synthetic_{c}") for c in columns])
    both = companies.join(one, key, "left").join(two, key, "left")
    filled = {f"synthetic_{c}": F.coalesce(f"synthetic_{c}", F.lit(0.0)) for c in columns}
    both = both.withColumns(filled)
    return both.withColumns({f"adjusted_{c}": F.col(f"synthetic_{c}") / F.lit(float(factor)) for c in columns})
