from plumbline.__main__ import main
from plumbline.operators import design, keyphrases, prompts
from pyspark.sql import functions as F
import numpy as np
import pytest


def test_prompt_leaves_out_empty_sections(spark):
    schema = "about string, headline string, e array<struct<title string, company string, description string>>, d array<struct<degree string, field string, description string>>"
    df = spark.createDataFrame([("x" * 400, "", [("t", "c", None), (None, None, "")], None), (None, None, None, None)], schema)
    a, b = [r[0] for r in df.select(prompts.profile_prompt(F.col("about"), F.col("headline"), F.col("e"), F.col("d"))).collect()]
    assert a == "About: " + "x" * 300 + "...\nExperience: t, c" and b == ""


def test_answers_are_settled(spark):
    df = spark.createDataFrame([(["ACCEPT"], 2), (["A", "B", "C"], 2), (["A", "B"], 2), (None, 1)], "a array<string>, n int")
    got = [(r.a, r.complete) for r in prompts.settle_answers(df, "a", "n").collect()]
    assert got == [(["ACCEPT", "RETRY_FAILED"], False), (["A", "B"], False), (["A", "B"], True), (["RETRY_FAILED"], False)]


def test_batches_keep_order(spark):
    df = spark.createDataFrame([(i, f"id{i}", f"t{i}") for i in range(1, 6)], "nr int, id string, t string").repartition(3)
    got = {r.batch: r.prompt for r in prompts.batch_prompts(df, "nr", "id", "t", 2, "P").collect()}
    assert got[0] == "P\n\n[id1]\nt1\n\n[id2]\nt2" and got[2] == "P\n\n[id5]\nt5"


def test_design(spark):
    assert design.grid(spark, a=[1, 2], b=["x", "y", "z"]).count() == 6
    assert design.fractions_to_layers([0.0, 0.5, 1.0], 10) == [0, 5, 9]
    assert np.allclose(design.geometric(1, 100, 3), [1, 10, 100])
    x, y = map(np.array, zip(*design.beta_density(2.0, 5.0, 2000)))
    assert abs(y.mean() - 1) < 1e-3
    assert design.flatten({"a": {"b": 1, "c": {"d": 2}}, "e": 3}) == {"a.b": 1, "a.c.d": 2, "e": 3}
    assert design.find_column(["ID", "Affiliation Name"], "affiliation") == "Affiliation Name" and design.find_column(["x"], "y") is None


def test_keyphrases_are_diverse(spark):
    df = spark.createDataFrame([(1, "red fox red fox jumps", ["red fox", "red fox", "red foxes", "jumps"]), (2, None, ["a"]), (3, "x", [])], "id int, t string, w array<string>")
    got = [r.keyword for r in keyphrases.keyphrases(df, "id", "t", "w", top=2, diversity=0.7).collect()]
    assert len(got) == 2 and got[0] == "red fox" and "jumps" in got


def test_command_line(capsys):
    assert main(["list"]) == 0 and "log_debias" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["explain", "nothing", "/tmp"])
