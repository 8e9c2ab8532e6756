from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.llm import terms


def brute(records, max_n):
    occurrences, seen = Counter(), Counter()
    for r in records:
        grams = [(n, " ".join(r[i : i + n])) for n in range(1, max_n + 1) for i in range(len(r) - n + 1)]
        occurrences.update(grams)
        seen.update(set(grams))
    return {k: (occurrences[k], seen[k]) for k in occurrences}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=8), st.integers(1, 12))
def test_intervals_equal_counting(records, max_n):
    got = {}
    for n, names, occ, rec in terms.suffix_counts(records, range(1, max_n + 1)):
        for t, o, r in zip(names, occ, rec):
            got[n, t] = (int(o), int(r))
    assert got == brute(records, max_n)


def test_words():
    assert terms.words("Été, ABC-12\tßx") == ["été", "abc", "12", "ßx"]
    assert terms.words(" \t") == []


def test_marks_and_edges(spark):
    rows = [(f"common w{i % 7} {'twice ' * 2}", "yes" if i < 15 else None) for i in range(20)] + [(None, ""), (" \n", "odd"), ("x" * 100_000, "odd")]
    df = spark.createDataFrame(rows, "cv_text string, category string").repartition(5)
    got = {(r.field, r.term): r for r in terms.term_counts(df.withColumnRenamed("zz", "term"), {"cv_text": "text", "category": "value"}).collect()}
    assert got["cv_text", "common"].records == 20 and got["cv_text", "common"].mark == "common"
    assert got["cv_text", "twice"].occurrences == 40 and got["cv_text", "twice"].records == 20
    assert got["cv_text", "w3"].mark is None or got["cv_text", "w3"].records < 3
    assert got["cv_text", "x" * 100_000].mark == "rare"
    assert got["cv_text", "common"].of_records == 21 and got["category", "yes"].of_records == 18
    assert got["category", ""].mark == "rare" and got["category", "yes"].mark == "common"
    assert terms.term_counts(df.limit(0), {"cv_text": "text", "category": "value"}).count() == 0


def test_blocks_do_not_change_counts(spark, monkeypatch):
    df = spark.createDataFrame([("a b a",), ("b",), ("a",)] * 30, "t string").repartition(3)
    count = lambda: sorted(map(tuple, terms.term_counts(df, {"t": "text"}, lengths=(1, 2)).collect()))
    whole = count()
    monkeypatch.setattr(terms, "BLOCK_TOKENS", 4)
    assert count() == whole


def test_latest(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (1, "b", 6), (2, None, None), (2, "z", 1)], "k int, v string, t int")
    assert {r.k: r.v for r in terms.latest(df, "k", ["v"], ["t"]).collect()} == {1: "b", 2: "z"}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_suffix_array_and_prefixes(values):
    import numpy as np

    ids = np.array([*values, 9], dtype=np.int64)
    order, ranks = terms.suffix_array(ids)
    plain = list(map(int, ids))
    assert list(order) == sorted(range(len(plain)), key=lambda i: plain[i:])
    for a, b in zip(order[:-1], order[1:]):
        want = next(k for k in range(len(plain)) if plain[a + k] != plain[b + k])
        assert terms.common_prefix(ranks, np.array([a]), np.array([b]))[0] == want


def test_long_repeats_have_counts():
    text = [str(i) for i in range(3_000)]
    got = list(terms.suffix_counts([text, text, text + text], (3_000,)))
    (n, names, occurrences, records) = got[0]
    best = int(occurrences.argmax())
    assert (n, names[best], int(occurrences[best]), int(records[best])) == (3_000, " ".join(text), 4, 3)
