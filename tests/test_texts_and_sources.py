import gzip
import json

import pytest

from plumbline.functions import keywords, text as tx
from plumbline.operators import extras, term_scores, vectors
from plumbline.sources import readers, writers
from plumbline.streaming import first_seen, read_jsonl, run_to_table, running_counts
from pyspark.sql import functions as F


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


def test_keyword_rules(spark):
    rows = [("Machine-Learning candidate",), ("html only",), (None,), ("RL and customer",), ("Reinforcement learning, doctor",)]
    got = keywords.keyword_flags(spark.createDataFrame(rows, "t string"), "t", ["t"]).collect()
    assert [(r.ml_match, r.broad_match, r.strict_no_match) for r in got] == [(1, 1, 1), (0, 0, 1), (0, 0, 1), (1, 0, 0), (1, 1, 1)]
    assert [r.filter_broad_yes_strict_no for r in got] == [1, 0, 0, 0, 1]


def test_scores_with_empty_lists(spark):
    df = spark.createDataFrame([("ml c++ team",), ("ml",), (None,)], "t string")
    lists = {"strict_yes": ["c++"], "broad_yes": [], "strict_no": ["team"], "broad_no": []}
    got = keywords.score_columns(df, "t", [], lists).collect()
    assert got[0].strict_yes_only == 1 and got[0].strict_yes_strict_no == 0 and got[0].broad_yes_only == 0
    assert got[1].broad_no_only == 1 and got[2].broad_no_only == 0


@pytest.mark.parametrize("value, want", [("11-50", 30.5), ("1,001 to 5,000", 3000.5), ("10,001+ employees", 10001.0), ("7", 7.0), ("none", None), (None, None)])
def test_range_midpoint(spark, value, want):
    assert one(spark, tx.range_midpoint(F.col("v")), value) == want


@pytest.mark.parametrize("value, want", [("2014-03-02", 2014), ("founded 1999", 1999), ("3021", None), (None, None), ("12", None)])
def test_year(spark, value, want):
    assert one(spark, tx.year_of(F.col("v")), value) == want


@pytest.mark.parametrize("value, want", [("5%", 0.05), ("0,5", 0.5), ("7", 0.07), ("x", None), (None, None)])
def test_share(spark, value, want):
    assert one(spark, tx.to_share(F.col("v")), value) == want


def test_formats(spark):
    row = spark.createDataFrame([(1234567.9, 12.0, None)], "a double, b double, c double").select(
        tx.spaced_integer(F.col("a")), tx.interval_text(F.col("a"), F.col("b"), F.col("a")), tx.interval_text(F.col("c"), F.col("b"), F.col("a")), tx.number_list([F.col("b"), F.col("c")]), tx.percent_text(F.col("b") / 100)
    ).first()
    assert tuple(row) == ("1 234 567", "1 234 567 (12 - 1 234 567)", "-", "[12, -]", "12.0 %")


def test_addresses(spark):
    rows = [("https://www.linkedin.com/company/ab-c/", "ab-c", "ab-c"), ("https://x.com/showcase/q", "q", "q"), ("https://x.com/school/u%20v", None, "u v"), ("https://x.com/edu/school?id=12", None, "12"), ("https://x.com/in/person", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "u string, s string, r string")
    for r in df.select("s", "r", tx.company_slug(F.col("u")).alias("a"), tx.any_route_id(F.col("u")).alias("b")).collect():
        assert (r.a, r.b) == (r.s, r.r)


def test_split_and_academic(spark):
    df = spark.createDataFrame([("A, B",), ("A/B",), ("A,",), (None,), (",",), ("MIT",), ("Stanford University",)], "a string")
    assert sorted(map(str, (r.a for r in tx.split_rows(df, "a").collect()))) == sorted(["A", "B", "A", "B", "A,", "None", ",", "MIT", "Stanford University"])
    kept = [r.a for r in df.filter(~keywords.is_academic(F.col("a"))).collect()]
    assert "MIT" in kept and "Stanford University" not in kept and None not in kept


def test_preprocess_and_ngrams(spark):
    assert one(spark, tx.preprocess(F.col("v")), "  A  12 b123\n7") == "a  b123 "
    assert one(spark, tx.preprocess(F.col("v")), None) == ""
    assert one(spark, tx.ngrams(tx.tokens(F.col("v")), [1, 2]), "the Red fox and b2 fox") == ["red", "fox", "fox", "red fox", "fox fox"]
    assert one(spark, tx.ngrams(tx.tokens(F.col("v")), [2]), "") == []


def test_discriminative_terms(spark):
    df = spark.createDataFrame([(1, "y", ["a", "a", "c"]), (2, "y", ["a"]), (3, "n", ["b", "c"]), (4, "n", ["b"]), (5, None, ["a"])], "d int, k string, t array<string>")
    got = {(r.k, r.term) for r in term_scores.discriminative(df, "d", "k", "t", least=0.6).collect()}
    assert got == {("y", "a"), ("n", "b")}


def test_readers(spark, tmp_path):
    profile = lambda i, **k: {"linkedin_id": i, "about": "a", "headline": "h", "current_company": {"company_id": "c", "name": "n"}, "experience": [{"description": f"d{j}"} for j in range(5)]} | k
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write(json.dumps(profile("p1")) + "\n{broken\n" + json.dumps(profile("", id="p2", headline=None)) + "\n" + json.dumps(profile("p3", current_company=None)) + "\n")
    (tmp_path / "b.jsonl").write_text(json.dumps(profile("p1", about="later")) + "\n")
    got = {r.public_identifier: r.profile_summary for r in readers.read_profiles(spark, [str(tmp_path / "a.jsonl.gz"), str(tmp_path / "b.jsonl")]).collect()}
    assert got == {"p1": "a h d0 d1 d2", "p2": "a d0 d1 d2"}
    (tmp_path / "batch_results_1.jsonl").write_text(json.dumps({"batch": 1, "results": [{"linkedin_id": "p1", "evaluation": "ACCEPT"}, {"linkedin_id": "p1", "evaluation": "REJECT"}, {"linkedin_id": "p2", "evaluation": "RETRY_FAILED"}]}))
    verdicts = readers.read_verdicts(spark, str(tmp_path), "m")
    assert {r.public_identifier: r.llm_m for r in verdicts.collect()} == {"p1": 1, "p2": 0}
    (tmp_path / "flags.csv").write_text("id,ml_match,broad_match,strict_no_match\np1,1,1,0\np1,0,0,0\n")
    flags = readers.read_flags(spark, [str(tmp_path / "flags.csv")])
    assert [tuple(r) for r in flags.collect()] == [("p1", 1, 0, 0)]
    profiles = readers.read_profiles(spark, [str(tmp_path / "a.jsonl.gz")])
    row = {r.public_identifier: r for r in readers.assemble(profiles, flags, [verdicts]).collect()}
    assert row["p1"].llm_m == 1 and row["p2"].filter_broad_yes is None
    (tmp_path / "t.tsv").write_text("Unnamed: 0\tprofile_summary\tcategory\n0\thello\tyes\n")
    assert [tuple(r) for r in readers.read_labelled_texts(spark, str(tmp_path / "t.tsv")).collect()] == [("hello", "yes")]
    for name, content in {"arr": '[{"a": 1}, {"a": 2}]', "field": '{"profiles": [{"a": 1}, {"a": 2}]}', "lines": '{"a": 1}\n{"a": 2}'}.items():
        (tmp_path / f"{name}.json").write_text(content)
        assert sorted(r.a for r in readers.read_json_any(spark, str(tmp_path / f"{name}.json"), "struct<a int>").collect()) == [1, 2]


def test_company_master(spark):
    raw = spark.createDataFrame([("1", "1,200", "TRUE", " ", "https://l.com/company/x"), ("2", "n/a", "0", "Oslo", None)], "id string, heads string, max_headcount string, country string, linkedin_url string")
    a, b = readers.company_master(raw, {"heads": "total_headcount"}, numeric_fallback=True).orderBy("id").collect()
    assert (a.total_headcount, a.max_headcount, a.country, a.linkedin_id) == (1200.0, True, "Unknown", "x")
    assert (b.total_headcount, b.max_headcount, b.country, b.linkedin_id) == (None, False, "Oslo", "2")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("k", [1.0, 2.0]), ("j", [3.0])], "k string, s array<double>")
    long = writers.samples_long(df, "k", "s")
    assert {r.k: r.samples for r in writers.samples_wide(long, "k", 3).collect()} == {"k": [1.0, 2.0, None], "j": [3.0, None, None]}
    for kind in ("csv", "tsv", "json", "parquet", "orc"):
        writers.save(long, str(tmp_path / kind), kind)
    with pytest.raises(ValueError):
        writers.save(long, str(tmp_path / "x"), "xlsx")
    lists = writers.split_lists(spark.createDataFrame([("a, b,,c",)], "l string"), ["l"])
    assert lists.first().l == ["a", "b", "c"]


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    assert {r.id: r.keeper for r in vectors.near_duplicates(df, "id", "v").collect()} == {1: None, 2: 1, 3: None, 4: 1, 5: None}
    top = vectors.top_neighbours(df, "id", "v", df.filter("id = 1"), k=2).orderBy("place").collect()
    assert [r.neighbour for r in top] == [4, 2]


def test_extras(spark):
    names = spark.createDataFrame([("Acme Ltd",), ("Globex",), ("zzz",)], "n string")
    known = spark.createDataFrame([("acme-ltd", 1), ("Globex Corporation", 2)], "m string, id int")
    assert {r.n: r.id for r in extras.loose_lookup(names, "n", known, "m", "id").collect()} == {"Acme Ltd": 1, "Globex": 2, "zzz": None}
    line = spark.createDataFrame([(float(i), 3.0 * i + 1 + (500 if i % 10 == 0 else 0)) for i in range(200)], "x double, y double")
    slope, intercept = extras.theil_sen(line, "x", "y")
    assert abs(slope - 3) < 0.5 and abs(intercept - 1) < 30


def test_streams(spark, tmp_path):
    place = tmp_path / "in"
    place.mkdir()
    (place / "1.json").write_text('{"k": "a", "v": 1}\n{"k": "a", "v": 2}\n')
    (place / "2.json").write_text('{"k": "b", "v": 3}\n{"k": "a", "v": 4}\n')
    stream = read_jsonl(spark, str(place), "k string, v int", 1)
    assert sorted(r.k for r in run_to_table(first_seen(stream, "k")).collect()) == ["a", "b"]
    assert {r.k: r.n for r in run_to_table(running_counts(stream, ["k"]), "complete").collect()} == {"a": 3, "b": 1}


def test_windows_leave_out_late_rows(spark, tmp_path):
    from plumbline.streaming import windowed_counts

    place = tmp_path / "w"
    place.mkdir()
    row = '{{"t": "{}", "k": "a", "value": {}}}\n'
    (place / "1.json").write_text(row.format("2024-01-01T10:00:00", 1) + row.format("2024-01-01T11:00:00", 2))
    stream = read_jsonl(spark, str(place), "t timestamp, k string, value double", 1)
    got = run_to_table(windowed_counts(stream, "t", ["k"]), "complete").collect()
    assert [(r.k, r.n, r.total) for r in got] == [("a", 2, 3.0)]
