"""What the first advice found missing in the engine: each test failed before."""

import duckdb

from voxlake import catalogue

SF = "/root/testdata/sf0.001"


def test_deep_mean_has_the_whole_vector(spark):
    e = f"(SELECT label, UNNEST(embedding)::DOUBLE v, UNNEST(RANGE(LEN(embedding))) k FROM '{SF}/embeddings.parquet')"
    expected = {(label, k): v for label, k, v in duckdb.sql(f"SELECT label, k, AVG(v) FROM {e} GROUP BY 1, 2").fetchall()}
    df = catalogue.QUERIES["agg_lesion_deep_mean"](spark, SF)
    found = {(r.image_id, k): r[f"deep_feature_{k}"] for r in df.collect() for k in range(len(df.columns) - 1)}
    assert len(df.columns) == 65 and found.keys() == expected.keys()
    assert all(abs(found[c] - expected[c]) < 1e-6 for c in expected)
