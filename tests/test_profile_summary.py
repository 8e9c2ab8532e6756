import json

from plumbline.plans import profiles


def test_descriptions_of_every_layout(spark, tmp_path):
    jobs = [{"title": "a", "description": f"d{i}"} for i in range(4)]
    rows = [
        (1, json.dumps({"summary": "s", "headline": "h", "experiences": jobs})),
        (2, json.dumps({"summary": "s", "experience": jobs})),
        (3, json.dumps({"experience": jobs[0]})),
        (4, json.dumps({"experiences": {str(i): j for i, j in enumerate(jobs)}})),
        (5, json.dumps({"experiences": json.dumps(jobs)})),
        (6, json.dumps({"headline": "h"})),
        (7, "{broken"),
        (1, json.dumps({"summary": "s", "headline": "h", "experiences": jobs})),
    ]
    spark.createDataFrame(rows, "raw_id bigint, profile_data string").write.parquet(str(tmp_path / "raw_profiles.parquet"))
    got = [(r.raw_id, r.profile_summary) for r in profiles.profile_summary(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(1, "s h d0 d1 d2"), (2, "s d0 d1 d2"), (3, "d0"), (4, "d0 d1 d2"), (5, "d0 d1 d2"), (6, "h")]
