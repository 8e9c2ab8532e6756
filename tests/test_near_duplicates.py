import duckdb
import numpy as np

import __spark_entry__ as entry
from plumbline.operators import vectors


def test_near_duplicates_loses_no_pair(spark):
    draw = np.random.default_rng(4)
    v = draw.normal(size=(2500, 16))
    v[2000:2400] = 0.75 * v[draw.integers(0, 2000, 400)] + 0.5 * v[2000:2400]  # most at a cosine of 0.75 to 0.9
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[2400:] = v[:100]
    v[7] *= 0.1  # too short to be near anything, even itself
    order = draw.permutation(2500)
    near = np.tril(np.round(v @ v.T, 9) >= 0.6, -1)
    want = {i: int(near[i].argmax()) if near[i].any() else None for i in range(2500)}
    df = spark.createDataFrame([(int(i), v[i].tolist()) for i in order], "id bigint, v array<double>")
    assert {r.id: r.keeper for r in vectors.near_duplicates(df, "id", "v", 0.6, cosine=False).collect()} == want
    assert {(r.a, r.b) for r in vectors.near_pairs(df, "id", "v", 0.6, cosine=False).collect()} == {(int(j), int(i)) for i, j in np.argwhere(near)}


def test_registered_duplicates_match_brute_force(spark, tmp_path):
    draw = np.random.default_rng(6)
    v = draw.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    spark.createDataFrame([(i, v[i].tolist()) for i in range(300)], "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for name, columns in (("embedding_dedup", ["vec_id", "keeper"]), ("embedding_pairs", ["a", "b"])):
        want = con.sql(entry.oracle_sql()[name]).fetchall()
        got = entry.queries()[name](spark, str(tmp_path)).select(*columns).collect()
        assert len(want) > 100 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))
