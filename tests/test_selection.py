import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.kernels import chi2_tail, f_tail, incomplete_beta
from plumbline.operators import evalprep, extras, metrics, relational, selection
from plumbline.operators.bootstrap import OTHER_PRIOR, FALLBACK_PRIOR, fake_annotations, prior_for, truncated_normal_quantiles
from plumbline.sources import readers, writers


def test_holds_any_and_digits(spark):
    df = spark.createDataFrame([("The BEST way", 1), ("12 34", 2), (None, 3), ("", 4)], "t string, i int")
    got = {r.i: (r.h, r.d) for r in df.select("i", selection.holds_any(F.col("t"), ["best"]).alias("h"), selection.digits(F.col("t")).alias("d")).collect()}
    assert got == {1: (True, 0), 2: (False, 4), 3: (False, 0), 4: (False, 0)}


def test_keyword_lists(spark):
    rows = [("a", "yes", 9, 0.95, 0.9), ("b", "yes", 9, 0.85, 0.7), ("c", "no", 4, 0.99, 0.99), ("d", "no", 9, None, 0.9), ("e", "no", 5, 0.9, 0.8)]
    df = spark.createDataFrame(rows, "k string, c string, n int, s double, p double")
    got = {(r.k, r.list) for r in selection.keyword_lists(df, "c", "k", "n", "s", "p").collect()}
    assert got == {("a", "broad"), ("a", "strict"), ("b", "broad"), ("e", "broad"), ("e", "strict")}
    assert selection.keyword_lists(df.limit(0), "c", "k", "n", "s", "p").count() == 0


def test_without_listed_keeps_nulls(spark):
    df = spark.createDataFrame([("A",), ("b",), (None,), ("c",), ("c",)], "w string")
    listed = spark.createDataFrame([("a",), ("B",), (None,)], "x string")
    assert sorted(str(r.w) for r in selection.without_listed(df, "w", listed, "x").collect()) == ["None", "c", "c"]


def test_md5_group_equals_python(spark):
    words = ["", "acme", "ümläut", "x" * 100_000]
    df = spark.createDataFrame([(w,) for w in [*words, None]], "w string")
    got = [r.g for r in df.select(selection.md5_group(F.col("w")).alias("g")).collect()]
    assert got == [int(hashlib.md5(w.encode()).hexdigest(), 16) % 10**9 for w in words] + [None]


def test_stratified_split(spark):
    rows = [(i, "hot" if i % 3 else "cold") for i in range(3000)] + [(9_000 + i, None) for i in range(11)]
    told = selection.stratified_split(spark.createDataFrame(rows, "id int, s string").repartition(7), "id", "s", 0.2)
    got = {(r.s, r.part): r["count"] for r in told.groupBy("s", "part").count().collect()}
    assert got == {("hot", "test"): 400, ("hot", "train"): 1600, ("cold", "test"): 200, ("cold", "train"): 800, (None, "test"): 2, (None, "train"): 9}
    again = selection.stratified_split(spark.createDataFrame(rows, "id int, s string"), "id", "s", 0.2)
    assert told.exceptAll(again).count() == 0
    assert selection.stratified_split(told.drop("part").limit(0), "id", "s", 0.2).count() == 0


def test_final_results(spark):
    c = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    real = spark.createDataFrame([("a", 4.0), (None, 9.0)], "k string, mean double")
    synthetic = spark.createDataFrame([("a", 5.0), ("b", 10.0)], "k string, mean double")
    got = {r.k: (r.real_mean, r.synthetic_mean, r.adjusted_mean) for r in selection.final_results(c, "k", real, synthetic, 1.25, ["mean"]).collect()}
    assert got == {"a": (4.0, 5.0, 4.0), "b": (None, 10.0, 8.0), "c": (None, 0.0, 0.0), None: (None, 0.0, 0.0)}


def test_average_ranks_and_tests(spark):
    rows = [("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 3.0), ("b", 5.0), ("c", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.v: (r["rank"], r.ties) for r in relational.average_ranks(df.na.drop(), "v").collect()}
    assert got == {1.0: (1.0, 1), 2.0: (2.5, 2), 3.0: (4.0, 1), 5.0: (5.0, 1)}
    told = metrics.group_tests(df, "g", "v").first()
    assert told.groups == 2 and 0 < told.p_f < 1 and abs(told.h - 2.08333 / 0.95) < 1e-4 and abs(told.p_h - 0.1386) < 1e-4  # by hand
    assert metrics.group_tests(df.limit(0), "g", "v").first().f is None


def test_tails_of_laws():
    # values of the published tables
    assert abs(f_tail(3.0, 4, 20) - 0.04320) < 1e-5 and abs(chi2_tail(3.841459, 1) - 0.05) < 1e-6
    assert abs(chi2_tail(18.307038, 10) - 0.05) < 1e-6 and abs(chi2_tail(0.5, 4) - 0.973501) < 1e-6
    assert incomplete_beta(2, 3, 0.0) == 0 and incomplete_beta(2, 3, 1.0) == 1 and f_tail(0.0, 1, 1) == 1.0 == chi2_tail(0.0, 3)


def test_priors_by_kind():
    assert prior_for(50.0, "comparator_non_ml") == OTHER_PRIOR == prior_for(1e6, "comparator_non_ml")
    assert prior_for(None, "comparator_non_ml") == FALLBACK_PRIOR and prior_for(20_000.0) == (1.0, 999.0)


def test_prevalence_is_drawn_from_a_truncated_law(spark):
    table = truncated_normal_quantiles(-1.5, 0.8, -3.0, 0.0)
    assert table[0] == -3.0 and table[-1] == 0.0 and abs(table[1024] + 1.5) < 1e-9 and table == sorted(table)
    fake = fake_annotations(spark, 2_000, 2_000, [0.9], [0.9])
    row = fake.agg(F.max("prevalence").alias("high"), F.min("prevalence").alias("low"), F.avg((F.log10("prevalence") > -0.1).cast("int")).alias("edge")).first()
    assert row.high < 1.0 and row.low > 1e-3 and row.edge < 0.03


def test_lookup_by_containment(spark):
    names = spark.createDataFrame([("lobex",), ("Acme",), ("ab",), (None,)], "n string")
    known = spark.createDataFrame([("Big Globex Group", 1), ("Globex", 2), ("ACME!", 3), ("abba", 4)], "m string, id int")
    assert {r.n: r.id for r in extras.loose_lookup(names, "n", known, "m", "id").collect()} == {"lobex": 2, "Acme": 3, "ab": None, None: None}


def test_slope_is_near_that_of_all_pairs(spark):
    import numpy as np

    draw = np.random.default_rng(0)
    x = draw.random(1500) * 10
    y = 2 * x + 1 + draw.standard_t(2, 1500)
    i, j = np.triu_indices(1500, 1)
    want = np.median((y[j] - y[i]) / (x[j] - x[i]))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    assert abs(extras.theil_sen(df, "x", "y")[0] - want) < 0.01


def test_prompts_and_splits(spark):
    df = spark.createDataFrame([(i, f"q{i}", ["w", "x", "y", "z"], i % 4) for i in range(4)], "id int, q string, c array<string>, a int")
    told = {r.id: r for r in evalprep.k_shot(df, "id", "q", "c", "a", 2).collect()}
    assert set(told) == {2, 3} and told[2].completion == "C" and told[2].text.endswith("Answer: C") and told[3].prompt.startswith("q0\nA. w")
    statements = df.filter("id = 1").select(evalprep.true_false(F.col("q"), F.col("c"), F.col("a")).alias("s")).first().s
    assert [s.rsplit(" ", 1)[1] for s in statements] == ["False", "True", "False", "False"]
    wrong = df.select("id", evalprep.seeded_wrongs(F.col("id"), F.col("c"), F.col("a"), 9).alias("w")).collect()
    assert all(len(set(r.w)) == 3 for r in wrong)
    dealt = evalprep.strided_splits(spark.range(500), "id", most=100, held=10, k=3)
    assert {r.split: r["count"] for r in dealt.groupBy("split").count().collect()} == {-1: 10, 0: 30, 1: 30, 2: 30}


def test_small_formats(spark):
    df = spark.createDataFrame([(None, 1), ("#N/A", 2), (" ", 3), ("1,5", 4)], "t string, i int")
    assert [r.v for r in df.select(tx.without_sentinels(F.col("t")).alias("v")).collect()] == [None, None, None, "1,5"]
    assert spark.range(1).select(tx.percent_text(F.lit(None).cast("double")).alias("p")).first().p == "-"
    assert writers.as_json_array(spark.range(2)).first().value == '[{"id":0},{"id":1}]'
    with pytest.raises(ValueError):
        writers.as_json_array(spark.range(3), most=2)
    base = readers.company_base(spark.createDataFrame([("x", None), ("y", 49)], "linkedin_id string, employees int")).collect()
    assert [(r.id, r.employees, r.company_size) for r in base] == [("x", 0, "Unknown"), ("y", 49, "Small")]
    assert readers.company_base(spark.createDataFrame([("x",)], "name string")).first().employees == 100


def test_column_shares(spark):
    df = spark.createDataFrame([("p", 50.0), ("p", 2.0), ("p", 0.5), ("f", 0.5), ("f", 1.5), ("f", None)], "c string, x double")
    got = sorted((r.c, r.x) for r in metrics.column_shares(df, "c", "x").na.drop().collect())
    assert got == [("f", 0.5), ("f", 1.5), ("p", 0.005), ("p", 0.02), ("p", 0.5)]


def test_estimators_and_checks(spark):
    df = spark.createDataFrame([(10.0, 10.0, 20.0), (20.0, 21.0, None)], "t double, a double, b double")
    got = {r.estimator: (r.rmse, r.place) for r in metrics.rank_estimators(df, "t", ["a", "b"]).collect()}
    assert got["a"] == (0.707107, 1) and got["b"] == (10.0, 2)
    draws = spark.createDataFrame([("g", float(i)) for i in range(101)], "g string, v double")
    told = metrics.predictive_check(draws, "g", "v", F.lit(50.0)).first()
    assert told.mean == 50.0 and told.in_ci and told.p == 1.0
    assert not metrics.predictive_check(draws, "g", "v", F.lit(500.0)).first().in_ci
