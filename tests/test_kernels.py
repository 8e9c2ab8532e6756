import math

import numpy as np

from plumbline.functions import kernels as k
from plumbline.operators import bootstrap, debias


def test_normal_functions():
    x = np.array([-3.0, -1.0, 0.0, 0.5, 2.5])
    assert np.allclose(k.phi_inv(k.phi(x)), x, atol=1e-9)
    assert abs(float(k.phi(1.959963984540054)) - 0.975) < 1e-12


def test_bivariate_against_orthant_formula_and_monte_carlo():
    for rho in (-0.9, -0.3, 0.0, 0.5, 0.95):
        assert abs(k.bivariate_cdf(0, 0, rho) - (0.25 + math.asin(rho) / (2 * math.pi))) < 1e-9
    draw = np.random.default_rng(0).multivariate_normal([0, 0], [[1, 0.6], [0.6, 1]], 400_000)
    assert abs(k.bivariate_cdf(0.4, -0.7, 0.6) - ((draw[:, 0] < 0.4) & (draw[:, 1] < -0.7)).mean()) < 3e-3


def test_orthant():
    cov = np.array([[1, 0.5, 0.2], [0.5, 1, 0.3], [0.2, 0.3, 1]])
    mean = np.array([0.3, -0.2, 0.1])
    draw = np.random.default_rng(1).multivariate_normal(mean, cov, 400_000)
    for signs in ([1, 1, 1], [-1, 1, -1], [1, -1, -1]):
        want = (draw * np.array(signs) > 0).all(axis=1).mean()
        assert abs(k.orthant(mean, cov, np.array(signs, float)) - want) < 3e-3
    total = sum(k.pattern_likelihood(format(i, "03b"), mean, cov) for i in range(8))
    assert abs(total - 1) < 3e-3
    assert abs(k.pattern_likelihood("1__", mean, cov) - float(k.phi(0.3))) < 1e-9
    assert k.pattern_likelihood("___", mean, cov) == 1.0


def test_tetrachoric_recovers_rho():
    draw = np.random.default_rng(2).multivariate_normal([0, 0], [[1, 0.55], [0.55, 1]], 200_000)
    a, b = draw[:, 0] > 0.3, draw[:, 1] > -0.2
    rho = k.tetrachoric(*[((a == i) & (b == j)).sum() for i in (0, 1) for j in (0, 1)])
    assert abs(rho - 0.55) < 0.01
    assert k.tetrachoric(10, 0, 5, 0) == 0.0


def test_nearest_correlation():
    m = k.nearest_correlation(np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]]))
    assert np.allclose(np.diag(m), 1) and np.linalg.eigvalsh(m).min() > 0


def test_posterior_edges():
    assert bootstrap.posterior(0.0, 0.0, 0.2) == 0.5
    assert bootstrap.posterior(0.0, 0.3, 0.2) == 1.0


def test_bootstrap_recovers_share(spark):
    fake = bootstrap.fake_annotations(spark, 5, 20_000, [0.9, 0.85, 0.8], [0.95, 0.9, 0.9])
    from plumbline.operators.metrics import pattern_counts
    from pyspark.sql import functions as F

    cols = ["annotator_0", "annotator_1", "annotator_2"]
    labelled = bootstrap.class_counts(fake, "label", cols)
    counts = pattern_counts(fake, ["company_id"], cols).groupBy("company_id").agg(F.sum("n").alias("headcount"), F.collect_list(F.struct("pattern", "n")).alias("patterns"))
    told = bootstrap.summarise(bootstrap.bootstrap_counts(counts, "company_id", "headcount", labelled, 3, 6, points=256), "company_id").collect()
    assert len(told) == 5 and all(r.q10 <= r.q50 <= r.q90 for r in told)
    again = bootstrap.summarise(bootstrap.bootstrap_counts(counts, "company_id", "headcount", labelled, 3, 6, points=256), "company_id").collect()
    assert sorted(told) == sorted(again)  # the same whatever the partitioning
    v = bootstrap.validation_bootstrap(fake, "label", cols, 3, 0.1, points=256).toPandas()
    assert (v.accuracy > 0.9).all()


def test_log_debias_against_numpy(spark):
    draw = np.random.default_rng(4)
    data = np.where(draw.random((40, 6)) < 0.2, np.nan, np.round(draw.lognormal(3, 1, (40, 6)) * (draw.random((40, 6)) > 0.1)))
    rows = [(str(i), 1000, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "id string, total_headcount bigint, " + ", ".join(f"{m} double" for m in debias.METHODS))
    got = {r.id: r for r in debias.log_debias(df).collect()}
    x = np.log(np.where(data <= 0, 0.5, data))
    keep = ~np.isnan(x).all(axis=1)
    y = x[keep] - np.nanmedian(x[keep] - np.nanmedian(x[keep], axis=1)[:, None], axis=0)
    mu = np.nanmedian(y, axis=1)
    for i, m, lo in zip(np.flatnonzero(keep), mu, np.nanquantile(y, 0.1, axis=1)):
        assert got[str(i)].ml_consensus_round == np.rint(np.exp(m))
        assert got[str(i)].ml_lower80_round == np.rint(np.exp(lo))
    assert all(got[str(i)].ml_consensus_round is None for i in np.flatnonzero(~keep))
