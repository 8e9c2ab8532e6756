import numpy as np
import pytest

from plumbline.llm import language as lang
from pyspark.sql import functions as F

SAMPLES = {
    "en": ["The work covered testing of the large models and the team was happy.", "She wrote the handbook for the whole company last year.", "They moved from one house to another with their friends."],
    "de": ["Die Arbeit umfasste die Prüfung von großen Modellen und das Team war froh.", "Sie schrieb im letzten Jahr das Handbuch für die ganze Firma.", "Sie zogen mit ihren Freunden von einem Haus in ein anderes."],
    "es": ["El trabajo incluyó la prueba de los grandes modelos y el equipo estaba contento.", "Ella escribió el manual para toda la empresa el año pasado.", "Se mudaron de una casa a otra con sus amigos."],
    "ja": ["彼女は去年、会社全体のための手引きを書きました。", "彼らは友人と一緒に家を移りました。", "作業は大きなモデルの検証を含んでいました。"],
}

LONG = " ".join(SAMPLES["de"] * 400)


@pytest.fixture(scope="module")
def model():
    draw = np.random.default_rng(0)
    parts, labels = [], []
    for _ in range(1200):
        code = list(SAMPLES)[draw.integers(4)]
        parts.append(SAMPLES[code][draw.integers(3)] if code == "ja" else " ".join(draw.permutation(SAMPLES[code][draw.integers(3)].split(" "))))
        labels.append(lang.CODES.index(code if draw.random() > 0.05 else "en"))  # some labels are wrong
    return lang.train(parts, labels)


def test_labels(spark):
    rows = [("German", "de"), ("deu", "de"), ("de-DE", "de"), (" EN ", "en"), ("en_US", "en"), ("pt-BR", "pt"), ("chi", "zh"), ("mul", None), ("und", None), ("xx", None), ("-", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "l string, want string")
    assert all(r.got == r.want for r in df.select("want", lang.canonical(F.col("l")).alias("got")).collect())


def test_segments():
    got = lang.segments('Jo Na\n\nI work here («el manual de la casa»). <p>Ich bin hier. / Yo vivo aqui​.</p>\nSkills: Go, R')
    assert [s for s, w in got if w] == ["I work here .", "Ich bin hier.", "Yo vivo aqui ."] or [s for s, w in got if w][1:] == ["Ich bin hier.", "Yo vivo aqui."]
    assert ("Jo Na", False) in got and ("Skills: Go, R", False) in got


def test_segments_by_language(spark, model):
    mixed = SAMPLES["en"][0] + " " + SAMPLES["de"][1] + "\n" + SAMPLES["ja"][0]
    rows = [(1, mixed, "a"), (2, SAMPLES["es"][0], "a"), (3, None, "a"), (4, "", "a"), (5, "Go, R.", "a"), (6, LONG, "a"), (6, LONG, "a")]
    df = spark.createDataFrame(rows, "id bigint, text string, main string")
    out = lang.identify(df, model)
    got = {r.id: r for r in out.collect()}
    assert out.count() == 7 and out.columns == ["id", "main", "confidence", "langs", "n_letters"]
    assert got[1].langs == ["de", "en", "ja"] and got[2].langs == ["es"] and got[6].langs == ["de"]
    assert got[3].main is None and got[4].langs == [] and got[5].langs == []
    segs = lang.identify_segments(df, model, "id").filter("id = 1").orderBy("place").collect()
    assert [s.lang for s in segs] == ["en", "de", "ja"] and all(s.confidence > 0.5 for s in segs)
    assert lang.identify(df.limit(0), model).count() == 0


def test_held_out_accuracy(model):
    draw = np.random.default_rng(9)
    parts, want = [], []
    for code in ("en", "de", "es"):
        for s in SAMPLES[code]:
            for _ in range(20):
                parts.append(" ".join(draw.permutation(s.split(" "))[2:]))
                want.append(lang.CODES.index(code))
    assert (model.predict(parts).argmax(axis=1) == np.array(want)).mean() > 0.97


def test_cases(spark):
    rows = [("cv", 1, "en", "en", ["en"], 5), ("cv", 2, "de", "en", ["en"], 5), ("cv", 3, None, "de", ["de"], 5), ("cv", 4, "en", "en", ["de", "en"], 5), ("cv", 5, None, None, [], 5), ("cv", 6, "German", "de", ["de"], 5), ("cv", 7, "fr", "fr", ["fr"], 5), ("cv", 7, "fr", "fr", ["fr"], 5)]
    told = spark.createDataFrame(rows, "rec_kind string, rec_id bigint, lang string, main string, langs array<string>, comparator_id bigint")
    assert sorted((r.rec_id, r.lang) for r in lang.label_cases(told).collect()) == [(2, "en"), (3, "de"), (4, "de"), (4, "en")]
    companies = spark.createDataFrame([(5, 0), (5, 0), (6, 3), (7, None), (8, 2)], "id bigint, filter_non_english_keywords_cv bigint")
    assert sorted(r.rec_id for r in lang.count_cases(told, companies).collect()) == [5, 6]


def test_training_edges():
    assert lang.train([], []).level > 1
    assert lang.train(["a b c d"], [1]).predict(["x"]).argmax() == 1


def test_one_text_on_half_the_rows_does_not_fill_the_sample(spark):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike".split()
    texts = ["The work covered testing of the large models and the team was happy."] * 3000
    texts += [f"The team wrote the {words[i % 13]} {words[i // 13 % 13]} {words[i // 169 % 13]} handbook last year." for i in range(1500)]
    df = spark.createDataFrame([(t, "en" if i % 2 else "de") for i, t in enumerate(texts)], "text string, lang string")
    seen = []
    keep = lang.train
    lang.train = lambda parts, labels, owners: seen.append(owners) or keep([], [])
    try:
        lang.learn(df, sample_texts=300)
    finally:
        lang.train = keep
    assert 200 <= len(seen[0]) <= 300 and len(set(seen[0])) >= len(seen[0]) - 1


def test_segments_of_a_long_text_come_from_all_of_it(spark):
    text = " ".join(f"Sentence number {i} tells of another long morning." for i in range(500))
    df = spark.createDataFrame([(text, "en", 1)], "text string, code string, h bigint")
    parts = [r.part for r in df.mapInArrow(lang._learned, "part string, label int, owner bigint").collect()]
    at = sorted(int(p.split()[2]) for p in parts)
    assert len(parts) == lang.SEGMENTS_PER_TEXT and at[0] < 100 and at[-1] > 400


def test_other_languages_are_rejected(spark, model):
    foreign = [
        "A könyvtár új épülete tavasszal nyílt meg a város látogatói előtt.",
        "Kirjasto avattiin viime keväänä ja se on ollut suosittu kävijöiden keskuudessa.",
        "Kütüphane geçen bahar açıldı ve ziyaretçiler tarafından çok sevildi.",
    ]
    own = SAMPLES["en"] + SAMPLES["de"] + SAMPLES["es"] + SAMPLES["ja"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(foreign + own)], "id int, text string")
    got = {r.id: (r.main, r.langs) for r in lang.identify(df, model).collect()}
    assert all(got[i] == (None, []) for i in range(len(foreign)))
    accepted = sum(got[i][0] is not None for i in range(len(foreign), len(got)))
    assert accepted >= len(own) - 1
    assert lang.label_cases(lang.identify(df.withColumn("rec_kind", F.lit("cv")).withColumn("rec_id", F.col("id")).withColumn("lang", F.lit(None).cast("string")), model)).count() == accepted


def test_wrong_labels_are_not_held_against_the_model():
    draw = np.random.default_rng(1)
    guess = np.full((2000, len(lang.CODES)), 0.001)
    y = draw.integers(0, len(lang.CODES), 2000)
    guess[np.arange(2000), y] = 0.9
    wrong = draw.random(2000) < 0.1
    y = np.where(wrong, (y + 1) % len(lang.CODES), y)
    assert 0.07 < lang.wrong_labels(guess, y) < 0.13
