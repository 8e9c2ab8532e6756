"""Relational operators with explicit order: first-wins, groups by rank, cut-offs, unions by precedence, repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialize


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first by ``order``; a map-side aggregate, so keys with many rows are no hot spot.

    Null keys are a key like any other.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__first")).select(*keys, "__first.*").select(*df.columns)


def first_wins_union(sources: list[DataFrame], keys: list[str], order: list[Column | str]) -> DataFrame:
    """Sources in order of precedence, united by name; the earliest source's first row of each key."""
    tagged = [s.withColumn("__rank", F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_wins(both, keys, ["__rank", *order]).drop("__rank")


def first_known(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: of every other column the first value by ``order`` that is not null, so a row may come from several.

    Rows with a null key are left out. A map-side aggregate, as :func:`first_wins`.
    """
    place = F.struct(*order)
    rest = [c for c in df.columns if c not in keys]
    known = df.na.drop(subset=keys)
    return known.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in rest]).select(*df.columns)


def precedence_union(main: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """All of ``main`` and, of each of the others, the keys that ``main`` lacks; a key of several others comes from each of them."""
    have = main.select(key)
    return reduce(lambda out, new: out.unionByName(new.join(have, key, "left_anti"), allowMissingColumns=True), others, main)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, by: str = "place") -> DataFrame:
    """The first ``k`` rows of each group with their place.

    Spark keeps only ``k`` rows a group in each task before the shuffle.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(by, F.row_number().over(w)).filter(F.col(by) <= k)


def group_index(df: DataFrame, column: str, out: str = "group", base: int = 0) -> DataFrame:
    """Consecutive numbers of the sorted distinct non-null values, joined to the rows.

    Values are numbered by range partitions: a count per partition, then the
    place within it, so no task holds all values. The partitions are written
    once, as both steps must see the same ones.
    """
    distinct = df.select(column).filter(F.col(column).isNotNull()).distinct()
    ranged = materialize(distinct.repartitionByRange(F.col(column)).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over partitions, not rows
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(column))
    numbered = ranged.withColumn("__place", within).join(F.broadcast(offsets), "__part")
    index = numbered.select(column, (F.col("__before") + F.col("__place") - 1 + base).cast("bigint").alias(out))
    return df.join(index, column, "left")


def running_cutoff(df: DataFrame, value: str, order: list[str], target: int, buckets: int = 1024) -> DataFrame:
    """Rows in ascending order of ``value`` while the sum before them is below ``target``: the row that crosses it is the last.

    Sums by value find where the target is crossed; only the rows of that
    value are put in order.
    """
    sums = df.groupBy(value).agg(F.sum(value).alias("__sum"))
    ranged = materialize(sums.repartitionByRange(F.col(value)).withColumn("__part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("__part").agg(F.sum("__sum").alias("__total"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(offsets), "__part").select(
        value, "__sum", (F.col("__offset") + F.coalesce(F.sum("__sum").over(inside), F.lit(0))).alias("__before")
    )
    kept = placed.filter(F.col("__before") < target)
    joined = df.join(kept, value)
    whole = joined.filter(F.col("__before") + F.col("__sum") <= target)
    edge = joined.filter(F.col("__before") + F.col("__sum") > target)
    w = Window.partitionBy(value).orderBy(*order)
    cut = edge.withColumn("__nth", F.row_number().over(w)).filter(F.col("__before") + (F.col("__nth") - 1) * F.col(value) < target)
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))


def repair_ids(df: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Add ``repaired``: the first of the trimmed, the lower-case and the decoded id that is known, else null."""
    attempts = [F.trim(column), F.lower(F.trim(F.col(column))), F.lower(F.trim(F.try_url_decode(F.trim(F.col(column)))))]
    attempts.append(F.regexp_replace(attempts[2], r"\s+", "-"))
    ids = known.select(F.col(key)).distinct()
    out = df
    for i, attempt in enumerate(attempts):
        out = out.withColumn(f"__try{i}", attempt).join(ids.select(F.col(key).alias(f"__hit{i}")), F.col(f"__try{i}") == F.col(f"__hit{i}"), "left")
    return out.select(*df.columns, F.coalesce(*[f"__hit{i}" for i in range(len(attempts))]).alias("repaired"))


def null_outliers(df: DataFrame, count: str, reference: str, columns: list[str], times: float = 3.0) -> DataFrame:
    """Null the columns of rows whose count is ``times`` above or below the reference."""
    far = (F.col(count) >= times * F.col(reference)) | (F.col(count) <= F.col(reference) / times)
    return df.withColumns({c: F.when(far, None).otherwise(F.col(c)) for c in columns})


def batches(df: DataFrame, order: str, size: int, value: str) -> DataFrame:
    """Rows in order as arrays of ``size``, by an order column of consecutive numbers from 1."""
    at = F.floor((F.col(order) - 1) / size)
    return df.groupBy(at.cast("bigint").alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("items"))


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, rank, ties) of the distinct values: the mean place of equal ones in ascending order, from counts by range partitions."""
    counts = df.groupBy(value).agg(F.count("*").alias("ties"))
    ranged = materialize(counts.repartitionByRange(F.col(value)).withColumn("__part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("__part").agg(F.sum("ties").alias("__total"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over partitions, not rows
    offsets = parts.select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(offsets), "__part").withColumn("__before", F.col("__offset") + F.coalesce(F.sum("ties").over(inside), F.lit(0)))
    return placed.select(value, (F.col("__before") + (F.col("ties") + 1) / 2.0).alias("rank"), "ties")
