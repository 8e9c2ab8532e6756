import pytest

from plumbline.functions.horizontal import row_absmax, row_median, row_quantile
from plumbline.operators import metrics
from pyspark.sql import functions as F

METHODS = ["strict_yes_strict_no", "strict_yes_broad_no", "broad_yes_broad_no", "broad_yes_strict_no", "strict_yes_only", "broad_yes_only", "strict_no_only", "broad_no_only"]


@pytest.mark.parametrize(
    "truth, said, counts, measures",
    [
        ([1, 1, 0, 0, 1, 0], [1, 1, 0, 0, 1, 0], (3, 3, 0, 0), {"sensitivity": 1.0, "specificity": 1.0, "f1": 1.0, "accuracy": 1.0}),
        ([1, 1, 0, 0, 1, 0], [1, 0, 1, 0, 1, 1], (2, 1, 2, 1), {"sensitivity": 0.667, "specificity": 0.333, "precision": 0.5, "recall": 0.667, "accuracy": 0.5}),
        ([1, 1, 0, 0, 1, 0], [1, 1, 1, 1, 1, 1], (3, 0, 3, 0), {"sensitivity": 1.0, "specificity": 0.0, "precision": 0.5, "accuracy": 0.5}),
        ([1, 1, None, 0, 1, 0], [1, 0, 1, 0, 1, 1], (2, 1, 2, 1), {}),
    ],
)
def test_confusion_literals(spark, truth, said, counts, measures):
    df = spark.createDataFrame(list(zip(truth, said)), "y int, m int")
    row = metrics.confusion_metrics(df, "y", ["m"]).first()
    assert (row.TP, row.TN, row.FP, row.FN) == counts
    for name, value in measures.items():
        assert row[name] == value


def test_confusion_all_methods(spark):
    rows = [("yes", 1, 1, 0), ("yes", 1, 0, 0), ("no", 0, 0, 1), ("yes", 1, 1, 0)]
    data = [(c, a, b, a, a, a, a, n, n) for c, a, b, n in rows]
    df = spark.createDataFrame(data, "category string, " + ", ".join(f"{m} int" for m in METHODS))
    told = metrics.confusion_metrics(df, "category", METHODS).collect()
    assert len(told) == 8
    assert [r.f1 for r in told] == sorted((r.f1 for r in told), reverse=True)
    assert metrics.confusion_metrics(df, "category", METHODS[:2]).count() == 2
    assert metrics.confusion_metrics(df, "category", ["nothing"]).count() == 0
    assert metrics.confusion_metrics(df.drop("category"), "category", METHODS).count() == 0


def test_row_statistics(spark):
    df = spark.createDataFrame([(1.0, None, 4.0, 2.0), (None, None, None, None), (3.0, None, None, None)], "a double, b double, c double, d double")
    cols = [F.col(c) for c in "abcd"]
    rows = df.select(row_median(cols).alias("m"), row_quantile(cols, 0.9).alias("q"), row_absmax([c - 3 for c in cols]).alias("x")).collect()
    assert rows[0].m == 2.0 and abs(rows[0].q - 3.6) < 1e-12 and rows[0].x == 2.0
    assert rows[1].m is None and rows[1].x is None
    assert rows[2].q == 3.0


def test_contingency_counts_present_pairs_only(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (None, 1), (1, 0)], "a int, b int")
    r = metrics.contingency(df, ["a", "b"]).first()
    assert (r.n00, r.n01, r.n10, r.n11) == (0, 1, 1, 1)


def test_classes_and_mismatch(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (0.0, 2.0, 3.0), (0.0, 0.0, 3.0), (0.0, 0.0, 0.0), (None, 1.0, 1.0)], "a double, b double, c double")
    got = [r[0] for r in df.select(metrics.confidence_class(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["Probable", "Possible", "Non-zero", "Not Detected", "Not Detected"]
    sizes = spark.createDataFrame([(100, 20.0), (100, 90.0), (100, 0.0), (100, None), (10, 90.0)], "h bigint, c double")
    assert [r[0] for r in sizes.select(metrics.headcount_mismatch(F.col("h"), F.col("c"))).collect()] == [True, False, False, True, True]
