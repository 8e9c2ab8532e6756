import json

from plumbline.operators.nested_records import ShapeAutomaton, VariantTables, flatten_records, parse_deep, write_json


def nodes(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "raw_id bigint, profile string")
    return flatten_records(df, "raw_id", "profile")


def found(spark, *texts):
    return sorted((r.raw_id, r.kind, r.child_path) for r in nodes(spark, *texts).collect())


def test_places_and_blank_elements(spark):
    record = {"experiences": [None, "x", {"title": " ", "positions": [{"t": None}]}, {"title": "a", "positions": [{}, {"projects": {"name": "p"}}]}]}
    assert found(spark, json.dumps(record)) == [(0, "experience", "experience:3"), (0, "position", "experience:3/position:1"), (0, "project", "experience:3/position:1/project:0")]


def test_storages(spark):
    child = {"name": "c"}
    texts = [
        json.dumps({"certifications": child}),
        json.dumps({"certifications": {"0": None, "1": child}}),
        json.dumps({"certifications": json.dumps([child])}),
        json.dumps(json.dumps({"certifications": [child]})),
    ]
    assert [(i, p) for i, _, p in found(spark, *texts)] == [(0, "certification:0"), (1, "certification:1"), (2, "certification:0"), (3, "certification:0")]
    assert [r.storage for r in nodes(spark, *texts[:3]).orderBy("raw_id").collect()] == ["single", "numbered", "encoded"]


def test_no_valid_record_gives_nothing(spark):
    deep = "[" * 100_000 + "]" * 100_000
    assert found(spark, None, "", "null", "[1]", "{'a': 1}", '{"experiences": [', '{"a": NaN}', deep, '{"experiences": null}') == []


def test_layouts_unite(spark):
    texts = [json.dumps({"education": [{"degree_name": "BSc"}]}), json.dumps({"educations_details": [{"degree": "MSc"}]})]
    got = {r.raw_id: (r.degree, r.degree_field) for r in VariantTables(nodes(spark, *texts), "raw_id").kind("education").collect()}
    assert got == {0: ("BSc", "degree_name"), 1: ("MSc", "degree")}


def test_dates_in_both_variants(spark):
    text = json.dumps({"experience": [{"title": "t", "start_date": {"year": 2010, "month": 3}, "end_date": "Mar 2014"}, {"title": "u", "start_date": "2001-07"}]})
    a, b = VariantTables(nodes(spark, text), "raw_id").kind("experience").orderBy("place").collect()
    assert (a.start_date_year, a.start_date_month, a.start_date_text) == (2010, 3, None)
    assert (a.end_date_year, a.end_date_month, a.end_date_text) == (2014, 3, "Mar 2014")
    assert (b.start_date_year, b.start_date_month) == (2001, 7)


def test_repeats_long_texts_and_clashing_columns(spark):
    long = json.dumps({"experiences": [{"title": "x" * 200_000}] * 50})
    df = spark.createDataFrame([(1, long, "k", "s"), (1, long, "k", "s")], "raw_id bigint, profile string, kind string, shape string")
    assert flatten_records(df, "raw_id", "profile").count() == 100
    assert flatten_records(df.limit(0), "raw_id", "profile").count() == 0
    clash = df.withColumnRenamed("profile", "payload").select("raw_id", "payload")
    assert flatten_records(clash, "raw_id", "payload").count() == 100


def test_deep_records_are_read(spark):
    deep = "[" * 100_000 + "1" + "]" * 100_000
    text = '{"experiences": [{"title": "a", "odd": ' + deep + "}]}"
    (row,) = nodes(spark, text).collect()
    assert row.child_path == "experience:0" and row.rest == '{"odd": ' + deep + "}"


def test_stack_parser_equals_library():
    for text in ['{"a": [1, -2.5e3, {"b": null, "c": [true, false, ""]}], "d": "x\\u00e9\\n"}', "[]", "{}", " [ {} , [ ] ] ", '"s"', "3"]:
        assert parse_deep(text) == json.loads(text)
        assert write_json(json.loads(text)) == json.dumps(json.loads(text))
    for text in ["", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", "]", "[}", '{"a":1]', "1 2", "[", '{"a":', "nul", "[1]]"]:
        try:
            parse_deep(text)
        except ValueError:
            continue
        raise AssertionError(text)


def test_variants_are_routed(spark):
    record = {
        "experiences": [
            {"title": "a", "start_date": "2001-02"},
            {"title": "b"},
            {"company": "c", "start_date": {"year": 2001}},
            {"title": ["odd"], "start_date": 7, "more": 1},
        ],
        "education": [{"degree": "x"}, {"school": "y"}],
    }
    tables = VariantTables(nodes(spark, json.dumps(record)), "raw_id")
    own = {v: sorted(r.place for r in t.collect()) for v, t in tables.tables["experience"].items()}
    assert own == {
        "experience.start_date-text.end_date-text": [0, 1],
        "experience.start_date-parts.end_date-text": [2],
        "experience.title-other.start_date-text.end_date-text": [3],
    }
    odd = tables.kind("experience").filter("place = 3").first()
    assert odd.title is None and json.loads(odd.rest) == {"title": ["odd"], "more": 1} and odd.start_date_text == "7"
    assert {(r.place, r.degree, r.degree_field) for r in tables.kind("education").collect()} == {(0, "x", "degree"), (1, None, None)}
    assert tables.kind("certification").count() == 0 and "authority" in tables.kind("certification").columns
    assert tables.keys().count() == 6


def test_states():
    node = {"a": [None, " "], "b": {"year": 1}, "c": ["x", 1], "d": [{}], "e": [["x"]]}
    told = ShapeAutomaton().states(node)
    assert [told[id(node[k])] for k in "abcde"] == ["blank", "parts", "list", "blank", "other"]
    assert told[id(node)] == "other"
