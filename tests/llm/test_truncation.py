import math

import numpy as np

from plumbline.llm import truncation as tr


def test_censored_lengths_are_recovered():
    draw = np.random.default_rng(1)
    x = draw.lognormal(5.5, 0.5, 20_000)
    cut = draw.random(20_000) < 0.7
    free = [(math.log(v), 1.0) for v, c in zip(x, cut) if v < 300 or not c]
    held = sum(1 for v, c in zip(x, cut) if v >= 300 and c)
    m, s = tr.fit_lengths(free, [(math.log(300), float(held))])
    naive = np.mean([v for v, _ in free])
    assert abs(m - 5.5) < 0.06 and abs(s - 0.5) < 0.06 and abs(m - 5.5) < abs(naive - 5.5)
    assert tr.fit_lengths([], []) == (6.0, 1.0)


def test_whole_endings():
    assert tr.ends_whole("All is done.") and tr.ends_whole('He said "no!" ') and tr.ends_whole("処理時間を短縮しました。")
    assert not tr.ends_whole("All is do") and not tr.ends_whole("All is…") and not tr.ends_whole("All [truncated]") and not tr.ends_whole("")


def sentence(draw):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()
    return " ".join(draw.choice(words, size=draw.integers(5, 12))).capitalize() + "."


def test_finds_planted_cuts(spark):
    draw = np.random.default_rng(2)
    rows, want = [], set()
    for i in range(3000):
        text = " ".join(sentence(draw) for _ in range(draw.integers(3, 12)))
        source = "limited" if i % 3 else "free"  # one source holds two thirds
        if source == "limited" and len(text) > 200 and draw.random() < 0.8:
            text = text[:200]
        elif draw.random() < 0.04:
            text = text[: len(text) // 2] + str(draw.choice(["", "…", " [truncated]"]))
        elif i % 10 == 0:
            text = text + "\nSkills: Go, R, Spark"
        if not tr.ends_whole(text) and not text.endswith("Spark"):
            want.add(i)
        rows.append((i, text, source))
    rows += [(9001, None, "free"), (9002, "", "free"), (9003, "  ", None), (9004, "x" * 100_000 + ".", "free"), (9004, "x" * 100_000 + ".", "free")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    told = tr.truncated(df)
    assert told.count() == len(rows)
    got = {r.doc_id for r in told.filter("cut").collect()}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95
    odds = {r.n_chars for r in told.filter("source = 'limited' and limit_odds > 5").collect()}
    assert 200 in odds


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert tr.truncated(df).count() == 0


def test_ratios_rise_and_find_the_mix():
    draw = np.random.default_rng(5)
    cut = draw.normal(3, 1, 20_000)
    mixed = np.concatenate([draw.normal(-3, 1, 9_500), draw.normal(3, 1, 500)])
    sums, ratios = tr.likelihood_ratio(mixed, cut)
    assert (np.diff(ratios) >= -1e-9).all()
    assert np.interp(4.0, sums, ratios) > 4 and np.interp(-4.0, sums, ratios) < -4
    assert list(tr.likelihood_ratio(np.zeros(5), np.zeros(5))[1]) == [0.0]


def test_copies_of_a_cut_text_do_not_teach_that_it_is_whole(spark):
    draw = np.random.default_rng(8)
    rows = [(i, " ".join(sentence(draw) for _ in range(6)), "a") for i in range(1500)]
    rows += [(10_000 + i, "Alpha bravo charlie. Delta echo foxtrot golf ho", "a") for i in range(800)]  # one text holds a third of the rows
    told = tr.truncated(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), sample_rows=1000)
    assert told.filter("doc_id >= 10000 and not cut").count() == 0 and told.filter("doc_id < 10000 and cut").count() == 0


def test_byte_limits_have_their_own_law(spark):
    draw = np.random.default_rng(4)
    sizes = np.rint(draw.lognormal(5.5, 0.4, 4000)).astype(int)
    rows = [("a", "chars", int(n), 1, 1) for n in sizes] + [("a", "bytes", int(3 * n), 1, 1) for n in sizes]
    rows += [("a", "bytes", 700, 90, 0)]
    df = spark.createDataFrame(rows, "source string, unit string, length int, rows bigint, whole bigint").groupBy("source", "unit", "length").sum("rows", "whole")
    limits = tr.find_limits(df.withColumnsRenamed({"sum(rows)": "rows", "sum(whole)": "whole"}))
    assert limits["a", "bytes"][700] > 5 and ("a", "chars") not in limits
