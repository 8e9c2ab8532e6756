"""Correlated probit fusion of annotators and its bootstrap, over counts of vote patterns.

Resampling rows with replacement is drawing pattern counts from a
multinomial, so rows are counted by company and pattern once and only these
counts are resampled. Pattern likelihoods depend on the classes' parameters,
not on companies: at most 3 ** annotators of them per iteration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.kernels import nearest_correlation, pattern_likelihood, phi_inv, tetrachoric
from plumbline.operators.metrics import pattern

#: Head count below which a Beta prior (alpha, beta) of the share holds.
PRIORS = [(100, (2.415889, 21.742998)), (1000, (3.001591, 57.030237)), (10000, (1.563834, 154.819604)), (float("inf"), (1.0, 999.0))]
#: Fixed value: the prior of comparators outside the field, whatever their head count.
OTHER_PRIOR = (1.0, 9999.0)
#: Fixed value: the prior without a head count.
FALLBACK_PRIOR = (1.563834, 154.819604)


@dataclass
class Probit:
    """Means and correlation of the latent normals for the classes 0 and 1."""

    mean: tuple[np.ndarray, np.ndarray]
    cov: tuple[np.ndarray, np.ndarray]

    def likelihoods(self, patterns: list[str], points: int = 2048) -> dict[str, tuple[float, float]]:
        return {p: tuple(pattern_likelihood(p, self.mean[k], self.cov[k], points) for k in (0, 1)) for p in patterns}


def fit_probit(counts: list[tuple[int, str, float]], annotators: int, smooth: float = 0.5) -> Probit:
    """From counts (class, pattern, rows): means from positive rates, correlations from the pairs' 2 x 2 counts."""
    means, covs = [], []
    for k in (0, 1):
        own = [(p, n) for c, p, n in counts if c == k]
        rate = np.empty(annotators)
        for j in range(annotators):
            yes = sum(n for p, n in own if p[j] == "1")
            no = sum(n for p, n in own if p[j] == "0")
            rate[j] = (yes + smooth) / (yes + no + 2 * smooth)
        rho = np.eye(annotators)
        for i, j in combinations(range(annotators), 2):
            cell = {(a, b): sum(n for p, n in own if p[i] == a and p[j] == b) for a in "01" for b in "01"}
            rho[i, j] = rho[j, i] = tetrachoric(cell["0", "0"], cell["0", "1"], cell["1", "0"], cell["1", "1"])
        means.append(phi_inv(rate))
        covs.append(nearest_correlation(rho))
    return Probit((means[0], means[1]), (covs[0], covs[1]))


def class_counts(df: DataFrame, label: str, columns: list[str]) -> list[tuple[int, str, float]]:
    """Counts of the labelled rows by class and pattern: at most 2 * 3 ** columns rows come to the driver."""
    told = df.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("k"), pattern(columns).alias("p")).agg(F.count("*").alias("n"))
    return [(r["k"], r["p"], float(r["n"])) for r in told.collect()]


def posterior(l0: float, l1: float, prior: float) -> float:
    bottom = l1 * prior + l0 * (1 - prior)
    return l1 * prior / bottom if bottom > 0 else 0.5


def pattern_posteriors(df: DataFrame, label: str, columns: list[str], prior: float) -> DataFrame:
    """pattern, rows, l0, l1, p: the posterior of class 1 for every pattern present."""
    spark = df.sparkSession
    counts = class_counts(df, label, columns)
    model = fit_probit(counts, len(columns))
    seen: dict[str, float] = {}
    for _, p, n in counts:
        seen[p] = seen.get(p, 0.0) + n
    told = model.likelihoods(sorted(seen))
    rows = [(p, int(n), told[p][0], told[p][1], posterior(*told[p], prior)) for p, n in sorted(seen.items())]
    return spark.createDataFrame(rows, "pattern string, n bigint, l0 double, l1 double, p double")


def tetrachoric_table(pairs: DataFrame) -> DataFrame:
    """Add rho to a table of 2 x 2 counts (n00, n01, n10, n11)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["rho"] = [tetrachoric(*c) for c in zip(batch.n00, batch.n01, batch.n10, batch.n11, strict=True)]
            yield batch

    return pairs.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in pairs.dtypes) + ", rho double")


def prior_for(headcount: float | None, org_type: str = "consulting") -> tuple[float, float]:
    """(alpha, beta) by head count; ``org_type`` "comparator_non_ml" has one prior for all sizes."""
    if headcount is None or not np.isfinite(headcount) or headcount <= 0:
        return FALLBACK_PRIOR
    if org_type == "comparator_non_ml":
        return OTHER_PRIOR
    return next(p for upper, p in PRIORS if headcount < upper)


def bootstrap_counts(
    company_patterns: DataFrame,
    company: str,
    headcount: str,
    labelled: list[tuple[int, str, float]],
    annotators: int,
    iterations: int,
    seed: int = 1000,
    points: int = 1024,
    org_type: str = "consulting",
) -> DataFrame:
    """(company, iteration, positives): bootstrap distribution of the number of positives per company.

    ``company_patterns``: company, headcount, patterns (array of struct pattern,
    n), one row per company. Iteration 0 takes the labelled counts as they are; each other one resamples the labelled counts within their class, refits the model,
    draws each company's patterns up to its head count and its share from the
    prior, and adds binomial draws. The models of all iterations are fitted in
    parallel; companies stay partitioned and never meet.
    """
    spark = company_patterns.sparkSession
    names = [r[0] for r in company_patterns.select(F.explode("patterns.pattern").alias("p")).distinct().collect()]  # at most 3 ** annotators

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for b in batch["iteration"]:
                draw = np.random.default_rng([seed, int(b)])
                again = []
                for k in (0, 1):
                    own = [(p, n) for c, p, n in labelled if c == k]
                    total = int(sum(n for _, n in own))
                    if total and b == 0:
                        again += [(k, p, n) for p, n in own]
                    elif total:
                        drawn = draw.multinomial(total, np.array([n for _, n in own]) / total)
                        again += [(k, p, float(n)) for (p, _), n in zip(own, drawn, strict=True) if n]
                told = fit_probit(again, annotators).likelihoods(names, points)
                out.append([float(x) for p in names for x in told[p]])
            yield pd.DataFrame({"iteration": batch["iteration"], "l": out})

    models = spark.range(iterations).withColumnRenamed("id", "iteration").repartition(min(iterations, 64)).mapInPandas(fit, "iteration bigint, l array<double>")
    fits = sorted((int(r["iteration"]), r["l"]) for r in models.collect())  # iterations x patterns numbers
    iterations_of = [i for i, _ in fits]
    first = [i == 0 for i in iterations_of]
    shipped = spark.sparkContext.broadcast((names, np.array([x for _, x in fits]).reshape(len(fits), -1, 2)))
    kind = dict(company_patterns.dtypes)[company]

    def draw_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, fitted = shipped.value
        place = {p: i for i, p in enumerate(names)}
        for batch in batches:
            ids, its, positives = [], [], []
            for key, size, patterns in zip(batch[company], batch[headcount], batch["patterns"], strict=True):
                at = np.array([place[p["pattern"]] for p in patterns])
                n = np.array([p["n"] for p in patterns], dtype=float)
                known = size is not None and not pd.isna(size) and size > 0
                target = int(max(size, n.sum())) if known else int(n.sum())
                a, b = prior_for(float(size) if known else None, org_type)
                # one generator a company and one draw for all iterations
                draw = np.random.default_rng([seed, *str(key).encode()])
                share = draw.beta(a, b, len(iterations_of))[:, None]
                drawn = draw.multinomial(target, n / n.sum(), len(iterations_of))
                drawn[first] = n  # iteration 0 takes the rows observed
                l0, l1 = fitted[:, at, 0], fitted[:, at, 1]
                bottom = l1 * share + l0 * (1 - share)
                p = np.where(bottom > 0, l1 * share / np.where(bottom > 0, bottom, 1), 0.5)
                ids += [key] * len(iterations_of)
                its += iterations_of
                positives += draw.binomial(drawn, np.clip(p, 0, 1)).sum(axis=1).tolist()
            yield pd.DataFrame({company: ids, "iteration": its, "positives": positives})

    return company_patterns.mapInPandas(draw_counts, f"{company} {kind}, iteration bigint, positives bigint")


def summarise(draws: DataFrame, company: str) -> DataFrame:
    """mean, std, q10, q50, q90 of each company's draws."""
    v = F.col("positives").cast("double")
    return draws.groupBy(company).agg(
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.percentile(v, F.lit(0.1)).alias("q10"),
        F.percentile(v, F.lit(0.5)).alias("q50"),
        F.percentile(v, F.lit(0.9)).alias("q90"),
    )


def validation_bootstrap(df: DataFrame, label: str, columns: list[str], iterations: int, prior: float, seed: int = 7, points: int = 1024) -> DataFrame:
    """(iteration, sensitivity, specificity, accuracy) of the fused posterior at a half, over resampled labelled counts."""
    spark = df.sparkSession
    counts = class_counts(df, label, columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for b in batch["iteration"]:
                draw = np.random.default_rng([seed, int(b)])
                again = []
                for k in (0, 1):
                    own = [(p, n) for c, p, n in counts if c == k]
                    total = int(sum(n for _, n in own))
                    if total:
                        drawn = draw.multinomial(total, np.array([n for _, n in own]) / total)
                        again += [(k, p, float(n)) for (p, _), n in zip(own, drawn, strict=True) if n]
                told = fit_probit(again, len(columns)).likelihoods(sorted({p for _, p, _ in again}), points)
                hit = {(k, v): 0.0 for k in (0, 1) for v in (0, 1)}
                for k, p, n in again:
                    hit[k, int(posterior(*told[p], prior) >= 0.5)] += n
                yes, no = hit[1, 1] + hit[1, 0], hit[0, 0] + hit[0, 1]
                rows.append((int(b), hit[1, 1] / yes if yes else 0.0, hit[0, 0] / no if no else 0.0, (hit[1, 1] + hit[0, 0]) / (yes + no) if yes + no else 0.0))
            yield pd.DataFrame(rows, columns=["iteration", "sensitivity", "specificity", "accuracy"])

    it = spark.range(iterations).withColumnRenamed("id", "iteration").repartition(min(iterations, 64))
    return it.mapInPandas(run, "iteration bigint, sensitivity double, specificity double, accuracy double")


def synthetic_patterns(df: DataFrame, company: str, headcount: str, counts: list[str], probit: Probit, seed: int = 11) -> DataFrame:
    """(company, pattern, n): votes drawn from a Gaussian copula whose margins are the company's own rates.

    A company's head count is spread over the patterns in one multinomial draw,
    so its rows are never made one by one.
    """
    kind = dict(df.dtypes)[company]
    size = len(counts)
    names = [format(i, f"0{size}b") for i in range(1 << size)]
    cov = probit.cov[0][:size, :size]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                total = int(getattr(row, headcount))
                rates = np.clip([getattr(row, c) / total for c in counts], 1e-4, 1 - 1e-4)
                mean = phi_inv(np.array(rates))
                p = np.array([pattern_likelihood(n, mean, cov, 512) for n in names])
                key = getattr(row, company)
                draw = np.random.default_rng([seed, *str(key).encode()])
                drawn = draw.multinomial(total, p / p.sum())
                out += [(key, n, int(k)) for n, k in zip(names, drawn, strict=True) if k]
            yield pd.DataFrame(out, columns=[company, "pattern", "n"])

    usable = df.filter((F.col(headcount) > 0) & F.least(*[F.col(c).isNotNull().cast("int") for c in counts]).cast("boolean"))
    return usable.select(company, headcount, *counts).mapInPandas(run, f"{company} {kind}, pattern string, n bigint")


#: Log10 of the prevalence: mean, deviation, and the limits beyond which nothing is drawn.
LOG_PREVALENCE = (-1.5, 0.8, -3.0, 0.0)


def truncated_normal_quantiles(mean: float, deviation: float, low: float, high: float, steps: int = 2048) -> list[float]:
    """Quantiles at 0, 1/steps, ..., 1 of a normal law cut at two limits."""
    law = NormalDist(mean, deviation)
    a, b = law.cdf(low), law.cdf(high)
    inner = [law.inv_cdf(a + (b - a) * i / steps) for i in range(1, steps)]
    return [low, *inner, high]


def fake_annotations(spark, companies: int, rows: int, sens: list[float], spec: list[float], seed: int = 42) -> DataFrame:
    """Rows of invented companies with known prevalence: company_id, prevalence, label and one column per annotator.

    All draws come from hashes of the row's number, so any partitioning gives
    the same table.
    """

    def uniform(*salt):
        return F.shiftrightunsigned(F.xxhash64(*salt, F.lit(seed)), 11) / F.lit(float(1 << 53))

    base = spark.range(rows).select("id", F.pmod("id", F.lit(companies)).alias("company_id"))
    u1 = uniform("company_id", F.lit("a"))
    table = truncated_normal_quantiles(*LOG_PREVALENCE)
    at = F.floor(u1 * (len(table) - 1))
    low, high = F.get(F.lit(table), at.cast("int")), F.get(F.lit(table), (at + 1).cast("int"))
    told = base.withColumn("prevalence", F.pow(F.lit(10.0), low + (high - low) * (u1 * (len(table) - 1) - at)))
    told = told.withColumn("label", (uniform("id", F.lit("label")) < F.col("prevalence")).cast("int"))
    for j, (a, b) in enumerate(zip(sens, spec, strict=True)):
        rate = F.when(F.col("label") == 1, F.lit(a)).otherwise(F.lit(1 - b))
        told = told.withColumn(f"annotator_{j}", (uniform("id", F.lit(f"annotator{j}")) < rate).cast("int"))
    return told
