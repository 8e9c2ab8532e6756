import pytest

from plumbline.llm import names, variants
from plumbline.llm.names import jaro_winkler, parse_name, similarity


@pytest.mark.parametrize(
    "text, kind, core",
    [
        ("Inst. for Applied Computing, Fujachár Máhufu", "institute", ("fujachar", "mahufu")),
        ("Dept. of Informatics, Hefanir Godutrel University", "university", ("hefanir", "godutrel")),
        ("JapuduZibovux  Bank", "bank", ("japudu", "zibovux")),
        ("Jasemil Roripar Robotics G.m.b.H., Cork", "robotics", ("jasemil", "roripar")),
        ("Natl. Manodix Romihe Obs.", "observatory", ("manodix", "romihe")),
        ("Bokefa Nejutax Robotics GmbH", "robotics", ("bokefa", "nejutax")),
    ],
)
def test_parsing(text, kind, core):
    name = parse_name(text)
    assert name.found and name.kind == kind and name.core == core


@pytest.mark.parametrize("text", [None, "", "  ", "-", "N/A", "Freelance", "A B University / C D Bank", "Ab Cd Bank & Ef Gh Hospital", "Ab Cd Bank; Ef Gh Bank"])
def test_no_organisation_or_two(text):
    assert not parse_name(text).found


def test_short_forms():
    assert parse_name("Japadin Chukiches Bank - Japachuki").nick == "japachuki"
    assert parse_name("Kechafax Gochafu Research Laboratory (Kechagocha)").nick == "kechagocha"
    assert names.short_forms(("japadin", "chukiches")) == ["japachuki"]
    assert names.short_forms(("silver", "loom", "50")) == []


def test_jaro_winkler_literals():
    assert abs(jaro_winkler("martha", "marhta") - 0.9611) < 1e-4
    assert abs(jaro_winkler("dwayne", "duane") - 0.84) < 1e-4
    assert jaro_winkler("", "a") == 0.0 and jaro_winkler("abc", "abc") == 1.0


def test_similarity():
    assert similarity(("johvi", "trokonal"), ("johavi", "trokoval")) > 0.85
    assert similarity(("joj", "nomobrul"), ("jojamor", "nomobrul")) >= 0.9
    assert similarity(("dijofoshitremun",), ("dijofo", "shitremun")) == 1.0
    assert similarity(("nomobrul", "jojamor"), ("jojamor", "nomobrul")) == 1.0
    assert similarity(("silver", "loom", "50"), ("silver", "loom", "18")) == 0.0
    assert similarity(("vashamu", "tohahen"), ("tohahen", "lepekel")) == 0.0


def test_spellings_share_a_block():
    base = ("jojamor", "nomobrul")
    for other in [("jojamr", "nomobrul"), ("joajmor", "nomobrl"), ("nomobrul", "jojamor"), ("jojamornomobrul",), ("joj", "nomobrul"), ("jojator", "nomibrul")]:
        assert set(names.blocking_keys(base)) & set(names.blocking_keys(other)), other


def test_components(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "x"), ("z", "z")], "a string, b string")
    got = {r.node: r.component for r in variants.connected_components(edges).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and got["y"] == "x" and "z" not in got


def test_groups(spark):
    same = ["Jojamor Nomobrul University", "JOJAMOR-NOMOBRUL UNIV.", "University of Joj. Nomobrul", "Nomobrul Jojamor Univ", "Jojamor Nombrul University, Cork", "Jojamor Nomobrul University - Jojanomo", "Jojanomo", "Jojamor Nomobrul"]
    other = ["Jojamor Kidifu University", "Teduhan Hospital", None, "N/A", "A Bcd Bank & E Fgh Bank"]
    hot = ["Jojamor Nomobrul University"] * 200  # one spelling holds most rows
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(same + other + hot)], "affiliation_id bigint, affiliation string, name string")
    got = {r.key: r.organisation for r in variants.name_groups(df, "affiliation_id", "affiliation").collect()}
    assert len({got[i] for i in range(len(same))} | {got[i] for i in range(len(same + other), len(df.columns) + 200)}) == 1
    assert got[8] != got[0] and got[9] != got[0] and not {10, 11, 12} & set(got)
    assert variants.name_groups(df.limit(0), "affiliation_id", "affiliation").count() == 0


def test_kinds_stay_apart(spark):
    rows = ["Jojamor Nomobrul Bank", "Jojamor Nomobrul Hospital", "Jojamor Nomobrul", "Jojanomo"]
    got = variants.name_groups(spark.createDataFrame(list(enumerate(rows)), "i bigint, t string"), "i", "t").collect()
    assert len({r.organisation for r in got if r.key < 2}) == 2
    assert {r.organisation for r in got if r.key >= 2}.isdisjoint({r.organisation for r in got if r.key < 2})


@pytest.mark.parametrize("word, kind", [("bnk", "bank"), ("hosptal", "hospital"), ("analytix", "analytics"), ("robotik", "robotics"), ("sw", "software"), ("dig", "digital"), ("clinics", "clinic"), ("nomobrul", None), ("co", None), ("s", None)])
def test_words_that_stand_for_kinds(word, kind):
    assert names.kind_of_word(word) == kind


def test_vocabulary_is_learned(spark):
    import itertools

    starts = ["".join(p) for p in itertools.product("bdfglm", "aou", "krst", "ei")]
    proper = [f"{starts[i % 144]}nax {starts[i * 7 % 144]}vol" for i in range(300)]
    endings = ["Hosptal", "Bank", "Dispensary", "Hospital Zweig"]
    rows = [f"{p} {endings[i % 4]}" for i, p in enumerate(proper)] + [f"silver loom {i}" for i in range(80)] + [None, "", "word " * 5000]
    known = variants.learn_vocabulary(spark.createDataFrame([(r,) for r in rows], "t string"), "t")
    assert known.kinds["hosptal"] == "hospital" and known.kinds["dispensary"] == "dispensary" and "zweig" in known.fillers
    assert not {"silver", "loom", "banax"} & (set(known.kinds) | known.fillers)
    assert variants.learn_vocabulary(spark.createDataFrame([], "t string"), "t") == names.PLAIN


def test_split_blocks_give_the_same_pairs(spark, monkeypatch):
    rows = [(i, i % 3, "l" if i % 2 else "r") for i in range(60)] + [(0, 1, "r"), (100, 9, "l")]
    keyed = spark.createDataFrame(rows, "id bigint, block bigint, side string")
    plain = lambda: (sorted(map(tuple, variants.block_pairs(keyed.drop("side")).collect())), sorted(map(tuple, variants.block_pairs(keyed, "l", "r").collect())))
    whole = plain()
    monkeypatch.setattr(variants, "SPLIT_BLOCK", 4)
    assert plain() == whole and len(whole[0]) > 500


def test_nicknames(spark):
    rows = [("bank|a b", "bank", "jojamor nomobrul", False, "jono"), ("bank|a b", "bank", "jojamor nomobrul", False, None), ("c", None, "x", True, "y")]
    got = {(r.form, r.given) for r in variants.nickname_table(spark.createDataFrame(rows, "name string, kind string, core string, weak boolean, nick string")).collect()}
    assert got == {("jono", True), ("jojanomo", False)}


def test_components_that_do_not_settle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(variants, "MOST_ROUNDS", 1)
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)], "a string, b string")
    with pytest.raises(RuntimeError):
        variants.connected_components(edges)
