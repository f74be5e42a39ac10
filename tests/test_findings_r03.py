"""What the findings of round 3 ask of the engine's queries: work and memory of a task that do not grow faster than the input."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake import catalogue
from voxlake.operators import batches, firstorder, prep, shape

SF = "/root/testdata/sf0.001"
VOX = "image_id int, roi string, x int, y int, z int, intensity double"
#: Taller than a slab, so that its border runs through.
TALL = range(batches.SLAB - 6, batches.SLAB + 6)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def tall(spark):
    rng = np.random.default_rng(3)
    return [(1, "a", x, y, z, float(rng.integers(1, 50))) for x, y, z in itertools.product(range(4), range(5), TALL) if rng.random() < 0.6]


def test_hull_of_many_points_takes_seconds():  # F2
    place = np.array([p for p in itertools.product(range(-24, 25), repeat=3) if 23**2 < sum(c * c for c in p) <= 24**2])
    began = time.time()
    faces = np.array(shape.hull_faces(place))
    assert time.time() - began < 4
    normals = np.cross(place[faces[:, 1]] - place[faces[:, 0]], place[faces[:, 2]] - place[faces[:, 0]])
    assert (place @ normals.T <= (normals * place[faces[:, 0]]).sum(1)).all()  # no point lies outside
    assert len(faces) == 2 * len(np.unique(faces)) - 4  # a closed surface


def test_hull_of_a_box_and_of_flat_points():  # F2
    box = np.array(list(itertools.product(range(5), range(4), range(3))))
    faces = shape.hull_faces(box)
    volume = sum(float(np.linalg.det(box[list(f)])) for f in faces) / 6
    assert (round(volume, 9), shape.hull_faces(box[box[:, 2] == 1]), shape.hull_faces(box[:1])) == (24.0, [], [])


@pytest.mark.parametrize("name", [f"{f}_{m}" for f in ("glrlm", "glcm") for m in ("2d_avg", "2d_comb", "25d_avg", "25d_comb", "3d_avg", "3d_comb")] + ["glrlm_matrix_3d", "glcm_matrix_3d"]
                         + [f"{f}_{m}" for f in ("gldzm", "glszm", "ngldm", "ngtdm") for m in ("2d", "25d", "3d")])
def test_no_voxel_becomes_many_rows(spark, name):  # F4 to F10, F12, F13, F18 to F21, F23
    told = plan(catalogue.QUERIES[name](spark, SF))
    assert not any(node in told for node in ("Generate", "Window", "Join")) and told.count("RepartitionByExpression") == 2  # lines by place, voxels by region


@pytest.mark.parametrize("name", ["peak_features", "morph_mesh", "morph_autocorr", "resample_linear", "pv_threshold"])
def test_sums_stay_where_their_slab_is(spark, name):  # F11, F14 to F17
    """Nothing is dealt out by place, apart from the voxels when they are made."""
    told = plan(catalogue.QUERIES[name](spark, SF))
    dealt = [line for line in told.split("\n") if "RepartitionByExpression" in line]
    lines = told.count("Relation [")
    assert sum("x#" in line for line in dealt) == lines < len(dealt)
    assert all("slab" in line or "block_" in line for line in dealt if "x#" not in line)


def test_batches_are_bounded_and_groups_whole(spark):  # the step of all
    df = spark.range(300_000).select((F.col("id") % 1000).alias("k"), F.lit(1).alias("v"))

    def work(g, c):
        yield {"group": np.arange(g.max() + 1), "n": np.bincount(g), "batch": np.full(g.max() + 1, len(g))}

    rows = batches.streamed(df, ["k"], work, "n int, batch int").collect()
    assert len(rows) == 1000 and {r.n for r in rows} == {300} and max(r.batch for r in rows) <= batches.ROWS + 10_000


def test_tasks_grow_with_the_tables(spark, tmp_path):
    spark.range(4_000_000).select(F.rand(1).alias("v")).write.parquet(f"{tmp_path}/t")  # 32 MB
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    large = batches.tasks(spark.read.parquet(f"{tmp_path}/t").groupBy("v").count())
    assert batches.tasks(spark.range(10)) == few and large >= few
    assert large == max(few, sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet")) // batches.TASK_BYTES)


def test_autocorrelation_shared_by_tasks_is_the_same(spark, tall):  # F17
    df = spark.createDataFrame(tall, VOX)
    place, v = np.array([(r[2], r[3], 2 * r[4]) for r in tall], float), np.array([r[5] for r in tall])
    n, dev = len(v), v - v.mean()
    gap = np.sqrt(((place[:, None] - place) ** 2).sum(2)) + np.diag([np.inf] * n)
    w = 1 / gap
    moran = n / w.sum() * (w * np.outer(dev, dev)).sum() / (dev @ dev)
    geary = (n - 1) / (2 * w.sum()) * (w * (dev[:, None] - dev) ** 2).sum() / (dev @ dev)
    for own in (20, shape.OWN):
        r = shape.autocorrelation(df, (1.0, 1.0, 2.0), own).first()
        assert math.isclose(r.morph_moran_i, moran, abs_tol=1e-12) and math.isclose(r.morph_geary_c, geary, abs_tol=1e-12)


def test_mesh_over_slabs(spark):  # F16, F22
    box = spark.createDataFrame([(1, "a", x, y, z, 1.0) for x, y, z in itertools.product(range(4), range(5), TALL)], VOX)
    low = spark.createDataFrame([(1, "a", x, y, z - TALL[0], 1.0) for x, y, z in itertools.product(range(4), range(5), TALL)], VOX)
    (a,), (b,) = (shape.mesh(df, (1.0, 1.0, 2.0)).collect() for df in (box, low))
    assert math.isclose(a.area, b.area, rel_tol=1e-12) and math.isclose(a.volume, b.volume, rel_tol=1e-12)


def test_peak_over_slabs(spark, tall):  # F11
    spacing = (3.0, 3.0, 3.0)
    image = {(x, y, z): v for _, _, x, y, z, v in tall}
    regions = [r for r in tall if r[2] < 3] + [(1, "b", *r[2:]) for r in tall if r[2] == 3]
    found = {r.roi: r for r in firstorder.intensity_peak(spark.createDataFrame(regions, VOX), spark.createDataFrame(tall, VOX).drop("roi"), spacing).collect()}
    for roi in ("a", "b"):
        rows = []
        for _, name, x, y, z, v in regions:
            ball = [image[p] for a, b, c in firstorder.sphere(spacing) if (p := (x + a, y + b, z + c)) in image]
            rows += [(v, sum(ball) / len(ball))] * (name == roi)
        assert math.isclose(found[roi].loc_peak_loc, max(rows)[1]) and math.isclose(found[roi].loc_peak_glob, max(b for _, b in rows))


def test_linear_resampling_over_slabs(spark, tall):  # F14, F15
    vox = spark.createDataFrame(tall, VOX).drop("roi")
    size, new, old = (4, 5, TALL[-1] + 1), (1.5, 2.0, 1.0), (1.0, 1.0, 2.0)
    images = spark.createDataFrame([(1, *size)], "image_id int, nx int, ny int, nz int")
    found = {(r.x, r.y, r.z): r.intensity for r in prep.resample_linear(vox, prep.target_grid(images, new, old)).collect()}
    block = np.zeros(size)
    for _, _, x, y, z, v in tall:
        block[x, y, z] = v
    for axis, (t, s) in enumerate(zip(new, old, strict=True)):
        n, m = size[axis], math.ceil(size[axis] * s / t)
        at = np.clip((np.arange(m) - (m - 1) / 2) * t / s + (n - 1) / 2, 0, n - 1)
        block = np.apply_along_axis(lambda line, at=at, n=n: np.interp(at, np.arange(n), line), axis, block)
    assert found.keys() == set(np.ndindex(block.shape))
    assert all(math.isclose(v, block[p], abs_tol=1e-9) for p, v in found.items())
