"""Log-median debiasing of several counts of one quantity per row."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.horizontal import present, array_quantile, row_absmax, row_count
from plumbline.operators.quantiles import exact_medians

METHODS = [
    "filter_broad_yes",
    "filter_strict_no",
    "filter_broad_yes_strict_no",
    "claude_total_accepted",
    "gpt5_total_accepted",
    "gemini_total_accepted",
]
MODEL_METHODS = METHODS[3:]
EPSILON = 0.5


def zero_as_missing(df: DataFrame, columns: list[str] = MODEL_METHODS) -> DataFrame:
    """A model's count of 0 means that none was made; a filter's 0 is a count."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in columns})


def method_biases(df: DataFrame, methods: list[str] = METHODS) -> dict[str, float]:
    """Per method, the median over rows of its log count less the row's median log count."""
    logs = [F.ln(F.when(F.col(c) <= 0, EPSILON).otherwise(F.col(c).cast("double"))) for c in methods]
    centre = array_quantile(present(logs), 0.5)
    gaps = df.select(*[(x - centre).alias(c) for c, x in zip(methods, logs, strict=True)])
    return {c: m or 0.0 for c, m in exact_medians(gaps, methods).items()}


def log_debias(df: DataFrame, total: str | None = "total_headcount", methods: list[str] = METHODS) -> DataFrame:
    """The input's columns and consensus, interval, uncertainty, outlier flag, shares and per-method columns.

    Counts of 0 or less enter as ``EPSILON``. A row's consensus is the median
    of its debiased logs, its interval their quantiles .1 and .9; rounded half
    to even. A row without counts has null results. One pass finds the
    methods' biases, the rest stays in one projection.
    """
    bias = method_biases(df, methods)
    number = {c: F.col(c).cast("double") for c in methods}
    adjusted = {c: F.when(x <= 0, EPSILON).otherwise(x) for c, x in number.items()}
    debiased = {c: F.ln(x) - F.lit(bias[c]) for c, x in adjusted.items()}
    work = df.withColumns({f"__{c}": x for c, x in debiased.items()})
    logs = [F.col(f"__{c}") for c in methods]
    work = work.withColumn("__sorted", present(logs))
    work = work.withColumns({"__mu": array_quantile(F.col("__sorted"), 0.5), "__lo": array_quantile(F.col("__sorted"), 0.1), "__hi": array_quantile(F.col("__sorted"), 0.9)})
    apart = row_absmax([x - F.col("__mu") for x in logs])
    out = work.withColumns(
        {
            "ml_consensus_round": F.rint(F.exp("__mu")).cast("bigint"),
            "ml_lower80_round": F.rint(F.exp("__lo")).cast("bigint"),
            "ml_upper80_round": F.rint(F.exp("__hi")).cast("bigint"),
            "uncertainty_factor_x": F.exp("__hi") / F.exp("__lo"),
            "k_methods": row_count([F.col(c) for c in methods]),
            "outlier_flag_gt3x": F.coalesce(apart > math.log(3.0), F.lit(False)),
        }
    )
    if total is not None:
        size = F.when(F.col(total) > 0, F.col(total).cast("double"))
        for name in ("consensus", "lower80", "upper80"):
            column = "ml_share" if name == "consensus" else f"ml_share_{name}"
            out = out.withColumn(column, F.try_divide(F.col(f"ml_{name}_round").cast("double"), size))
    out = out.withColumns({f"debiased__{c}": F.exp(F.col(f"__{c}")) for c in methods})
    out = out.withColumns({f"{c}__zero_replaced": F.coalesce(F.col(c) <= 0, F.lit(False)) for c in methods})
    return out.drop("__mu", "__lo", "__hi", "__sorted", *[f"__{c}" for c in methods])


def scale_bands(df: DataFrame) -> DataFrame:
    """Which overlapping scale bands a row of :func:`log_debias` belongs to."""
    count, share = F.col("ml_consensus_round"), F.col("ml_share")
    return df.withColumns(
        {
            "band_enterprise": F.coalesce((count >= 500) & (share >= 0.005), F.lit(False)),
            "band_midscale": F.coalesce((count >= 50) & (share >= 0.01), F.lit(False)),
            "band_boutique": F.coalesce((count >= 10) & (count < 50) & (share >= 0.05), F.lit(False)),
        }
    )
