from plumbline.llm import truncation as tr


def test_words_come_from_all_texts(spark, monkeypatch):
    seen = []
    count = tr.known_words
    monkeypatch.setattr(tr, "known_words", lambda texts, *rest: seen.append(count(texts, *rest)) or seen[-1])
    rows = [(i, f"The team of word{chr(97 + i % 20) * 3} was happy with all of it.", "a") for i in range(80)]
    tr.truncated(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), sample_rows=10)
    assert {seen[0].state(f"word{chr(97 + k) * 3}") for k in range(20)} == {"known"}
    assert seen[0].state("wor") == "begun" and seen[0].state("zzz") == "new" and seen[0].state("12") == "-"


def test_words_before_a_sign_of_a_cut_are_not_known(spark):
    rows = [(f"The team was happy with maint{sign}",) for sign in ("", "…", "...", " [truncated]", " …see more", "<br", "\n")] * 4
    known = tr.known_words(spark.createDataFrame(rows, "text string"))
    assert known.state("with") == "known" and known.state("maint") == "new"
