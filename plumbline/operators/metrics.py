"""Scores of binary annotators, summaries of distributions and comparisons of estimates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is 0."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def truth(column: Column) -> Column:
    """1 for 1, '1', yes or true; 0 for anything else and null."""
    return F.coalesce(F.lower(F.trim(column.cast("string"))).isin("1", "1.0", "yes", "true"), F.lit(False)).cast("int")


def confusion_metrics(df: DataFrame, label: str, methods: list[str], digits: int | None = 3) -> DataFrame:
    """TP, FP, FN, TN and six measures of every method, best F1 first; null counts as 0, 0/0 is 0.

    Every method is counted in the same pass (partial sums per task), then
    turned to rows.
    """
    have = [m for m in methods if m in df.columns]
    if label not in df.columns or not have:
        return df.sparkSession.createDataFrame(
            [], "method string, TP bigint, FP bigint, FN bigint, TN bigint, sensitivity double, specificity double, precision double, recall double, f1 double, accuracy double"
        )
    y = truth(F.col(label))
    sums = []
    for m in have:
        p = truth(F.col(m))
        for name, hit in (("TP", (y == 1) & (p == 1)), ("FP", (y == 0) & (p == 1)), ("FN", (y == 1) & (p == 0)), ("TN", (y == 0) & (p == 0))):
            sums.append(F.count_if(hit).alias(f"{m}|{name}"))
    one = df.agg(*sums)
    rows = F.array(*[F.struct(F.lit(m).alias("method"), *[F.col(f"`{m}|{k}`").alias(k) for k in ("TP", "FP", "FN", "TN")]) for m in have])
    counts = one.select(F.explode(rows).alias("r")).select("r.*")
    tp, fp, fn, tn = (F.col(k) for k in ("TP", "FP", "FN", "TN"))
    keep = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    told = counts.select(
        "method",
        "TP",
        "FP",
        "FN",
        "TN",
        keep(ratio(tp, tp + fn)).alias("sensitivity"),
        keep(ratio(tn, tn + fp)).alias("specificity"),
        keep(ratio(tp, tp + fp)).alias("precision"),
        keep(ratio(tp, tp + fn)).alias("recall"),
        keep(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        keep(ratio(tp + tn, tp + fp + fn + tn)).alias("accuracy"),
    )
    return told.orderBy(F.desc_nulls_last("f1"), "method")


def annotator_bias(df: DataFrame, label: str, methods: list[str]) -> DataFrame:
    """Sensitivity, specificity, accuracy on rows with both labels, and the positive rate less the prevalence."""
    y = F.col(label)
    parts = []
    for m in methods:
        p = F.col(m)
        both = y.isNotNull() & p.isNotNull()
        parts.append(
            F.struct(
                F.lit(m).alias("method"),
                F.count_if(both).alias("n"),
                F.try_divide(F.count_if(both & (y == 1) & (p == 1)), F.count_if(both & (y == 1))).alias("sensitivity"),
                F.try_divide(F.count_if(both & (y == 0) & (p == 0)), F.count_if(both & (y == 0))).alias("specificity"),
                F.try_divide(F.count_if(both & (y == p)), F.count_if(both)).alias("accuracy"),
                (F.avg(F.when(both, p.cast("double"))) - F.avg(F.when(both, y.cast("double")))).alias("bias"),
            )
        )
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def contingency(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """n00, n01, n10, n11 of every pair of columns over the rows where both are present: one pass for all pairs."""
    parts = []
    for a, b in combinations(columns, 2):
        x, y = F.col(a), F.col(b)
        parts.append(
            F.struct(
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
                *[F.count_if((x == i) & (y == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)],
            )
        )
    grouped = df.groupBy(*(by or [])).agg(F.array(*parts).alias("p"))
    return grouped.select(*(by or []), F.explode("p").alias("r")).select(*(by or []), "r.*")


def theta(df: DataFrame, label: str, methods: list[str]) -> DataFrame:
    """P(method = 1 | label) for both labels; 0.5 where there is nothing to count."""
    grouped = df.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("label"))
    wide = grouped.agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in methods])
    long = wide.select("label", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("p1")) for m in methods])).alias("r"))
    return long.select("label", "r.method", F.coalesce("r.p1", F.lit(0.5)).alias("p1"))


def pattern(columns: list[str]) -> Column:
    """The row's votes as a text of 0, 1 and _ for null."""
    return F.concat_ws("", *[F.coalesce(F.col(c).cast("int").cast("string"), F.lit("_")) for c in columns])


def pattern_counts(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*by, pattern(columns).alias("pattern")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Pearson correlation of every pair of columns by class; 0 where it is not defined."""
    parts = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.nanvl(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)), F.lit(0.0)).alias("rho"))
        for a, b in combinations(columns, 2)
    ]
    return df.groupBy(by).agg(F.array(*parts).alias("p")).select(by, F.explode("p").alias("r")).select(by, "r.*")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over rows where both are present; null where the weights add to 0 or less."""
    both = value.isNotNull() & weight.isNotNull()
    total = F.sum(F.when(both, weight))
    return F.when(total > 0, F.sum(F.when(both, value * weight)) / total)


def distribution(value: Column) -> list[Column]:
    """mean, population std, q10, q50, q90 of a group's values."""
    v = value.cast("double")
    return [
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.percentile(v, F.lit(0.1)).alias("q10"),
        F.percentile(v, F.lit(0.5)).alias("q50"),
        F.percentile(v, F.lit(0.9)).alias("q90"),
    ]


def log_regression(x: Column, y: Column) -> list[Column]:
    """Slope, intercept and r2 of log10 y on log10 x over rows where both are positive."""
    lx = F.when((x > 0) & (y > 0), F.log10(x.cast("double")))
    ly = F.when((x > 0) & (y > 0), F.log10(y.cast("double")))
    return [F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"), F.regr_r2(ly, lx).alias("r2")]


def log_histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in ``bins`` bins of equal width in log10 between ``low`` and ``high`` (as exponents)."""
    at = F.width_bucket(F.log10(F.col(value).cast("double")), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.filter(F.col(value) > 0).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def coverage(value: Column, low: Column, high: Column) -> Column:
    return F.avg(value.between(low, high).cast("double"))


def confidence_class(q10: Column, q50: Column, q90: Column) -> Column:
    """The first class that holds; 'Not Detected' where a quantile is null."""
    missing = q10.isNull() | q50.isNull() | q90.isNull()
    return F.when(missing, "Not Detected").when(q10 > 0, "Probable").when(q50 > 0, "Possible").when(q90 > 0, "Non-zero").otherwise("Not Detected")


def size_band(count: Column) -> Column:
    return F.when(count < 100, "<100").when(count < 1000, "100-999").when(count < 10000, "1000-9999").when(count.isNotNull(), ">=10000")


def size_bucket(count: Column) -> Column:
    return F.when(count < 10, "micro").when(count < 50, "small").when(count < 200, "medium").when(count < 1000, "large").otherwise("enterprise")


def headcount_mismatch(count: Column, other: Column) -> Column:
    """Whether two head counts differ by more than three times; True where the other is null, False where it is 0."""
    quotient = F.when(other > 0, count / other)
    return F.when(other.isNull(), True).otherwise(F.coalesce((quotient > 3) | (quotient < F.lit(1.0) / 3), F.lit(False)))


def predictive_check(draws: DataFrame, group: str, value: str, observed: Column) -> DataFrame:
    """Per group: mean, std, low and high (2.5 and 97.5 %) of the draws, two-sided p of the observed value, and whether it lies between."""
    v = F.col(value).cast("double")
    upper, lower = F.avg((v >= observed).cast("double")), F.avg((v <= observed).cast("double"))
    told = draws.groupBy(group).agg(
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.percentile(v, F.lit(0.025)).alias("low"),
        F.percentile(v, F.lit(0.975)).alias("high"),
        F.least(F.lit(1.0), 2 * F.least(upper, lower)).alias("p"),
    )
    inside = observed.between(F.col("low"), F.col("high"))
    return told.select(group, *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")], F.round("p", 9).alias("p"), inside.alias("in_ci"))


def rank_estimators(df: DataFrame, truth_column: str, estimators: list[str], near: float = 0.1) -> DataFrame:
    """estimator, rmse, mae, worst, near (share within ``near`` of the truth) and place by rmse; rows without an estimate are left out for it."""
    from pyspark.sql import Window

    long = df.select(F.col(truth_column).alias("truth"), *estimators).unpivot(["truth"], estimators, "estimator", "estimate").filter("estimate is not null")
    gap = F.abs(F.col("estimate") - F.col("truth"))
    told = long.groupBy("estimator").agg(
        F.round(F.sqrt(F.avg(gap * gap)), 6).alias("rmse"),
        F.round(F.avg(gap), 6).alias("mae"),
        F.round(F.max(gap), 6).alias("worst"),
        F.round(F.avg((gap <= near * F.abs(F.col("truth"))).cast("double")), 9).alias("near"),
    )
    return told.withColumn("place", F.rank().over(Window.orderBy("rmse")).cast("bigint"))  # over the few estimators


def column_shares(df: DataFrame, column: str, value: str) -> DataFrame:
    """Values of each column as shares: where most of its values exceed 1 it holds percentages, and all are divided by 100."""
    most = df.groupBy(column).agg((F.count_if(F.col(value) > 1) * 2 > F.count("*")).alias("__percent"))
    return df.join(most, column).withColumn(value, F.when(F.col("__percent"), F.col(value) / 100).otherwise(F.col(value))).drop("__percent")


def group_tests(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: groups, f, p_f, eta2 (analysis of variance) and h, p_h (Kruskal-Wallis, corrected for ties).

    Rows without group or value are left out. Ranks come from counts of the
    values by range partitions, so no task orders all rows.
    """
    from plumbline.functions.kernels import chi2_tail, f_tail
    from plumbline.operators.relational import average_ranks

    x = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).na.drop()
    ranks = average_ranks(x, "v")
    by_group = x.join(ranks, "v").groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"), F.sum("rank").alias("r"))
    n = F.sum("n")
    row = by_group.agg(
        F.count("*").alias("groups"),
        n.alias("n"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), F.lit(2)) / n).alias("between"),
        F.sum(F.col("n") * F.col("s")).alias("within"),
        F.sum(F.col("r") * F.col("r") / F.col("n")).alias("b"),
    ).first()
    ties = ranks.agg(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("t")).first()["t"]
    k, total = row["groups"], row["n"] or 0
    f = p_f = eta2 = h = p_h = None
    if k > 1 and total > k and row["within"]:
        f = (row["between"] / (k - 1)) / (row["within"] / (total - k))
        eta2 = row["between"] / (row["between"] + row["within"])
        p_f = f_tail(f, k - 1, total - k)
    if k > 1 and total > 1 and ties < total**3 - total:
        h = (12.0 / (total * (total + 1)) * row["b"] - 3 * (total + 1)) / (1 - ties / (total**3 - total))
        p_h = chi2_tail(h, k - 1)
    return df.sparkSession.createDataFrame([(k, f, p_f, eta2, h, p_h)], "groups bigint, f double, p_f double, eta2 double, h double, p_h double")
