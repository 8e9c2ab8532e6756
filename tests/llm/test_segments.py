from plumbline.llm import language


def test_segments_of_cvs_and_documents(spark, tmp_path):
    cvs = [(1, "She wrote the handbook. They moved house.", "en", 5), (2, None, "en", 5), (3, "Sie schrieb das Handbuch.", None, None)]
    docs = [(1, "The team was happy.", "en"), (4, "", "en")]
    spark.createDataFrame(cvs, "cv_id bigint, cv_text string, lang string, comparator_id bigint").write.parquet(str(tmp_path / "cv_data.parquet"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = language.p6_segments(spark, str(tmp_path))
    assert got.columns == ["rec_kind", "rec_id", "place", "segment", "whole", "lang", "confidence"]
    assert {(r.rec_kind, r.rec_id, r.place, r.segment) for r in got.collect()} == {
        ("cv", 1, 0, "She wrote the handbook."),
        ("cv", 1, 1, "They moved house."),
        ("cv", 3, 0, "Sie schrieb das Handbuch."),
        ("doc", 1, 0, "The team was happy."),
    }
