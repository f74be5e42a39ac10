"""The engine's queries against their SQL on small tables, and hand-checked miniatures."""

import duckdb
import pytest

from voxlake import catalogue
from voxlake.operators import prep, rois, texture
from voxlake.plans.registry import select_columns

SF = "/root/testdata/sf0.001"
M1 = ((1, 1, 2), (1, 2, 3), (3, 3, 3))


@pytest.fixture(scope="session")
def engine():
    con = duckdb.connect()
    for t in ("lineitem", "part", "events", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def told(v):
    return f"{v + 0.0:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["disc_fbs", "disc_fbn", "outlier_3sigma", "resample_linear", "stat_features", "ivh_features", "glcm_matrix_3d", "glrlm_matrix_3d", "roi_components_26", "agg_lesion_per_region", "pair_positional_zip", "nearest_slice_join", "report_parse"])
def test_query_equals_sql(spark, engine, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(told(r[c]) for c in columns) for r in df.collect())
    found = engine.execute(catalogue.ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert ours == sorted(tuple(told(r[i]) for i in at) for r in found.fetchall())


@pytest.fixture(scope="session")
def slice_(spark):
    rows = [(1, "a", x, y, 0, M1[y][x]) for y in range(3) for x in range(3)]
    return spark.createDataFrame(rows, "image_id int, roi string, x int, y int, z int, level int")


def test_cooccurrence_of_a_slice(slice_):
    cells = {(r.i, r.j): r.n for r in texture.cooccurrence(slice_, ["2D_comb"]).collect()}
    assert [[cells[i, j] for j in (1, 2, 3)] for i in (1, 2, 3)] == [[6, 4, 3], [4, 2, 5], [3, 5, 8]]
    f = texture.cooccurrence_features(slice_, ["2D_comb"]).first()
    assert (round(f.contrast, 6), round(f.energy, 6), round(f.joint_avg, 6), round(f.dissimilarity, 6)) == (1.05, 0.1275, 2.075, 0.75)


def test_zones_and_dependence_of_a_slice(slice_):
    zones = sorted((r.i, r.size, r.distance) for r in texture.zones(slice_).where("flat").select("i", "distance", texture.F.col("size")).collect() for r in [r.asDict()] for r in [type("Z", (), r)])
    assert zones == [(1, 3, 1), (2, 2, 1), (3, 4, 1)]
    cells = {(r.i, r.k): r.n for r in texture.dependence_matrix(slice_, ["2D"]).collect()}
    assert cells == {(1, 3): 3, (2, 2): 2, (3, 2): 1, (3, 3): 2, (3, 4): 1}


def test_corner_contact_is_one_component(spark):
    mask = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 1, 1, 1, 1), (1, 5, 5, 5, 1)], "image_id int, x int, y int, z int, label int")
    assert sorted(r.volume for r in rois.volumes(rois.components(mask)).collect()) == [1, 2]


def test_constant_region_has_one_level(spark):
    vox = spark.createDataFrame([(1, "a", x, 0, 0, 4.0) for x in range(3)], "image_id int, roi string, x int, y int, z int, intensity double")
    assert {r.level for r in prep.fixed_bin_number(vox, 8).collect()} == {1}


def test_all_columns_are_named_once():
    names = select_columns()
    assert len(names) == len(set(names)) == 557
