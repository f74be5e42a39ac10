"""What the findings of round 2 ask of the engine's queries."""

from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from voxlake import catalogue

SF = "/root/testdata/sf0.01"


def half_up(x: Fraction) -> float:
    return int(x * 10**6 + Fraction(1, 2)) / 10**6


def test_sums_a_last_bit_beside_a_tie_round_up(spark):
    values = [3.7640624999999996, 0.10468749999999999, 0.123456499, 0.1234565]
    df = catalogue.tidy(catalogue.settled(spark.createDataFrame([(v,) for v in values], "v double")))
    assert [r.v for r in df.collect()] == [3.764063, 0.104688, 0.123456, 0.123457]


def test_exact_ties_of_glcm_25d_avg(spark, tmp_path):
    """Both regions have a mean that is an exact tie in the sixth decimal: 2409/640 and 67/640."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").where(F.col("l_suppkey").isin(3, 54))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r.image_id: r for r in catalogue.QUERIES["glcm_25d_avg"](spark, str(tmp_path)).where("roi = 'label_2'").collect()}
    voxels = catalogue.quantised(spark, str(tmp_path)).where("roi = 'label_2'").collect()
    for image in (3, 54):
        level = {(r.x, r.y, r.z): r.level for r in voxels if r.image_id == image}
        averages, most = [], []
        for dx, dy in ((1, -1), (1, 0), (1, 1), (0, 1)):
            near = [(a, level.get((x + dx, y + dy, z))) for (x, y, z), a in level.items()]
            counts = Counter(p for a, b in near if b is not None for p in ((a, b), (b, a)))
            averages.append(Fraction(sum(i * n for (i, _), n in counts.items()), counts.total()))
            most.append(Fraction(max(counts.values()), counts.total()))
        assert (found[image].joint_avg, found[image].joint_max) == (half_up(sum(averages) / 4), half_up(sum(most) / 4))
