from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.operators import relational as rel
from plumbline.operators.quantiles import exact_medians, exact_quantiles
from plumbline.sources.contracts import contract, validated, violations
from pyspark.sql import functions as F
import numpy as np
import pytest


def test_first_wins_order_and_null_keys(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "n"), (None, 4, "m"), ("a", 1, "y")], "k string, o int, v string")
    got = {r.k: r.v for r in rel.first_wins(df, ["k"], ["o", "v"]).collect()}
    assert got == {"a": "y", None: "m"}


def test_first_wins_union_takes_missing_columns(spark):
    a = spark.createDataFrame([("p", 1)], "k string, x int")
    b = spark.createDataFrame([("p", 2, "z"), ("q", 3, "w")], "k string, x int, y string")
    got = {r.k: (r.x, r.y) for r in rel.first_wins_union([a, b], ["k"], ["x"]).collect()}
    assert got == {"p": (1, None), "q": (3, "w")}


def test_group_index_is_dense(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "k string")
    got = {r.k: r.group for r in rel.group_index(df, "k").collect()}
    assert got == {"a": 0, "b": 1, "c": 2, None: None}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 9), min_size=1, max_size=40), st.integers(1, 120))
def test_running_cutoff_matches_loop(spark, values, target):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, n int")
    total, want = 0, []
    for v, i in sorted((v, i) for i, v in enumerate(values)):
        if total >= target:
            break
        want.append(i)
        total += v
    assert sorted(r.id for r in rel.running_cutoff(df, "n", ["id"], target).collect()) == sorted(want)


def test_exact_quantiles_refine(spark):
    draw = np.random.default_rng(0)
    x = np.concatenate([draw.normal(size=3000), np.full(2000, 0.25)])  # one value holds two fifths of the rows
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    for q in (0.0, 0.1, 0.5, 0.613, 1.0):
        assert abs(exact_quantiles(df, "v", [q], small=100)[0] - np.quantile(x, q)) < 1e-12
    assert exact_quantiles(df.filter("v > 99"), "v", [0.5]) == [None]
    assert abs(exact_medians(df, ["v"], small=10)["v"] - np.median(x)) < 1e-12


def test_repair_ids(spark):
    known = spark.createDataFrame([("alpha-beta",), ("gamma",)], "slug string")
    df = spark.createDataFrame([(" alpha-beta ",), ("GAMMA",), ("alpha%2Dbeta",), ("alpha%20beta",), ("nothing",), (None,)], "id string")
    assert [r.repaired for r in rel.repair_ids(df, "id", known, "slug").collect()].count(None) == 2


def test_contracts(spark):
    good = spark.createDataFrame([("a", 1)], "affiliation string, count bigint")
    assert validated(good, "affiliations") is good
    bad = spark.createDataFrame([(None, -1)], "affiliation string, count bigint")
    assert set(violations(bad, contract("affiliations"))) == {"affiliation: null", "count: below 0"}
    with pytest.raises(ValueError):
        validated(bad, "affiliations")
    with pytest.raises(ValueError):
        contract("nothing")
    assert "count: missing" in violations(good.drop("count"), contract("affiliations"))


def test_precedence_union(spark):
    a = spark.createDataFrame([(1, "a")], "id int, s string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "id int, s string")
    c = spark.createDataFrame([(2, "c"), (3, "c")], "id int, s string")
    # the others are compared with the main table only
    assert sorted((r.id, r.s) for r in rel.precedence_union(a, [b, c], "id").collect()) == [(1, "a"), (2, "b"), (2, "c"), (3, "c")]


def test_first_known(spark):
    df = spark.createDataFrame([("k", 2, "late", 5), ("k", 1, None, 7), (None, 1, "x", 1), ("n", 1, None, None)], "k string, o int, s string, v int")
    got = {r.k: (r.s, r.v) for r in rel.first_known(df, ["k"], ["o"]).collect()}
    assert got == {"k": ("late", 7), "n": (None, None)}
    assert rel.first_known(df.limit(0), ["k"], ["o"]).count() == 0


def test_null_outliers(spark):
    df = spark.createDataFrame([(300.0, 100.0, 7.0), (100.0, 100.0, 7.0), (None, 100.0, 7.0)], "c double, h double, v double")
    assert [r.v for r in rel.null_outliers(df, "c", "h", ["v"]).collect()] == [None, 7.0, 7.0]
