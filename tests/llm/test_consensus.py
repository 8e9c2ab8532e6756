import numpy as np

from plumbline.llm import consensus


def test_votes_are_read(spark):
    rows = [(1, 7, " YES ", 1), (1, 7, "no", 2), (1, 8, "unsure", 1), (2, 7, "T", 1), (2, 8, "False", 1), (2, 8, "False", 1), (None, 7, "yes", 1), (3, 7, None, 1)]
    df = spark.createDataFrame(rows, "i int, a int, l string, t int")
    assert sorted(map(tuple, consensus.last_votes(df, "i", "a", "l", ["t"]).collect())) == [(1, "7", 0.0), (2, "8", 0.0)]


def test_recovers_reliability(spark):
    draw = np.random.default_rng(3)
    truth = draw.random(1500) < 0.35
    sens, spec = [0.9, 0.85, 0.8, 0.75, 0.5, 0.15], [0.9, 0.8, 0.9, 0.85, 0.5, 0.2]
    votes = []
    for i, t in enumerate(truth):
        for j in range(6):
            if draw.random() < 0.8 or j == 0:  # one annotator labels everything
                votes.append((i, f"a{j}", float(draw.random() < (sens[j] if t else 1 - spec[j]))))
    items, raters = consensus.consensus(spark.createDataFrame(votes, "item bigint, annotator string, y double"))
    got = {r.annotator: r for r in raters.collect()}
    for j in range(6):
        assert abs(got[f"a{j}"].sens - sens[j]) < 0.1 and abs(1 - got[f"a{j}"].fpr - spec[j]) < 0.1
    assert got["a5"].informed < -0.4 and abs(got["a4"].informed) < 0.15
    told = {r.item: r.verdict for r in items.collect()}
    right = np.mean([told[i] == t for i, t in enumerate(truth)])
    majority = {}
    for i, _, y in votes:
        majority.setdefault(i, []).append(y)
    assert right > np.mean([(np.mean(majority[i]) >= 0.5) == t for i, t in enumerate(truth)]) and right > 0.9


def test_related_raters_and_items_without_votes(spark):
    votes = spark.createDataFrame([(i, a, float(i % 2)) for i in range(40) for a in ("x", "y", "z")], "item bigint, annotator string, y double")
    items = spark.createDataFrame([(i, i % 2, None) for i in range(44)], "item bigint, m int, n int")
    told = {r.item: r for r in consensus.consensus(votes, items, ["m", "n"])[0].collect()}
    assert len(told) == 44 and all(told[i].verdict == i % 2 for i in range(44))
    assert told[43].votes == 0 and told[43].agreement is None and told[0].agreement == 1.0


def test_edges(spark):
    empty = spark.createDataFrame([], "item bigint, annotator string, y double")
    items, raters = consensus.consensus(empty)
    assert items.count() == 0 and raters.count() == 0
    alone = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.0)], "item bigint, annotator string, y double")
    assert consensus.consensus(alone)[0].count() == 2


def test_totals_apart(spark):
    rows = [("a", 40.0, 10.0, 10.0), ("b", 39.0, 10.0, 10.0), ("c", 2.0, 10.0, 12.0), ("d", None, 10.0, 10.0), ("e", 0.0, 10.0, 10.0), ("f", 100.0, 10.0, 16.0), ("g", 9.0, 0.0, 0.0), ("a", 40.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "company_id string, claude_total_accepted double, gpt5_total_accepted double, gemini_total_accepted double")
    assert sorted(r.company_id for r in consensus.totals_apart(df).collect()) == ["a", "c", "e"]


def test_expected_totals(spark):
    rows = [(str(i), float(i + 1), float(i + 1), float(2 * i + 2)) for i in range(30)] + [("odd", 1000.0, 10.0, 10.0), (None, 1.0, 1.0, 1.0), ("nan", float("nan"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "company_id string, claude_total_accepted double, gpt5_total_accepted double, gemini_total_accepted double")
    told = {(r.company_id, r.total): r for r in consensus.expected_totals(df).collect()}
    assert len(told) == 93
    odd = told["odd", "claude_total_accepted"]
    assert odd.residual > np.log(50) and abs(odd.expected - 10) < 1e-6
    assert consensus.expected_totals(df.limit(0)).count() == 0


def test_leading_vector():
    u = np.array([0.2, 0.5, 0.3])
    matrix = np.outer(u, u)
    got = consensus.leading_vector(matrix)
    assert abs(got - u / u.sum()).max() < 1e-6
    assert list(consensus.leading_vector(np.zeros((3, 3)))) == [1 / 3] * 3


def test_vector_that_does_not_settle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(consensus, "MOST_ROUNDS", 1)
    votes = spark.createDataFrame([(i, a, float((i * k) % 3 == 0)) for i in range(40) for k, a in enumerate("xyz", 1)], "item bigint, annotator string, y double")
    try:
        consensus.consensus(votes)
    except RuntimeError:
        return
    raise AssertionError
