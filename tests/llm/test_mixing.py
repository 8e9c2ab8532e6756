import os

import pytest

from plumbline.llm import mixing
from plumbline.llm.tokens import DEFAULT_DIR, DEFAULT_NAME

pytestmark = pytest.mark.skipif(not os.path.exists(f"{DEFAULT_DIR}/{DEFAULT_NAME}.json"), reason="no vocabulary files here")
TARGETS = "source string, target_share double, max_repeats bigint"


def mixed(spark, docs, targets, **k):
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    mix, shares = mixing.mix_sources(df, spark.createDataFrame(targets, TARGETS), **k)
    return mix.collect(), {r.source: r for r in shares.collect()}


def test_budgets_caps_and_hot_source(spark):
    docs = [(i, "big", "one two three four five") for i in range(3000)]  # most rows are one source
    docs += [(10_000 + i, "mid", "one two three") for i in range(300)] + [(20_000 + i, "small", "one two") for i in range(10)]
    docs += [(30_000, None, "lost"), (None, "big", "lost"), (30_001, "other", "lost"), (30_002, "mid", None), (30_003, "mid", "")]
    mix, shares = mixed(spark, docs, [("big", 0.5, 1), ("mid", 0.3, 9), ("small", 0.1, 3), ("none", 0.1, 5)])
    total = sum(r.available_tokens for r in shares.values())
    assert sum(r.copies * r.n_tokens for r in mix) == sum(r.reached_tokens for r in shares.values())
    for s in ("big", "mid"):
        assert shares[s].served and 0 <= shares[s].budget_tokens - shares[s].reached_tokens < 5
        assert abs(shares[s].share_of_total - shares[s].target_share) < 5 / total + 1e-3
    assert not shares["small"].served and {r.copies for r in mix if r.source == "small"} == {3}
    assert shares["none"].reached_tokens == 0 and abs(sum(r.reached_share for r in shares.values()) - 1) < 1e-9
    copies = {r.copies for r in mix if r.source == "mid"}
    assert max(copies) - min(copies) <= 1 and max(copies) <= 9
    assert {r.source for r in mix} == {"big", "mid", "small"} and all(r.doc_id < 30_000 for r in mix)


def test_nested_budgets(spark):
    docs = [(i, "a", "word " * (i % 13 + 1)) for i in range(500)]
    targets = [("a", 1.0, 2)]
    few = {r.doc_id for r in mixed(spark, docs, targets, total_tokens=700)[0]}
    more = {r.doc_id for r in mixed(spark, docs, targets, total_tokens=1400)[0]}
    assert few < more


def test_empty_tables(spark):
    mix, shares = mixed(spark, [], [("a", 0.5, 1)])
    assert mix == [] and shares["a"].reached_share == 0.0
    mix, shares = mixed(spark, [(1, "a", "x")], [])
    assert mix == [] and shares == {}
    _, shares = mixed(spark, [(1, "a", "x")], [("a", None, 1), (None, 0.5, 1)])
    assert shares["a"].reached_tokens == 0


def test_one_id_on_a_third_of_the_rows(spark):
    docs = [(1, "a", "one two three")] * 500 + [(i, "a", "one two three") for i in range(2, 1000)]
    mix, shares = mixed(spark, docs, [("a", 0.7, 1), ("b", 0.3, 1)])
    told = shares["a"]
    one = mix[0].n_tokens
    assert told.served and 0 <= told.budget_tokens - told.reached_tokens < one
    assert sum(r.copies * r.n_tokens for r in mix) == told.reached_tokens
    every = [(1, "a", "one two three")] * 300
    mix, shares = mixed(spark, every, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert shares["a"].served and len(mix) == 150
