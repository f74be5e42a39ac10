"""First-order features of regions: statistics, histogram, intensity-volume histogram, intensity peak, moments, diagnostics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxlake.operators.batches import SLAB, Places, in_slabs, streamed
from voxlake.operators.texture import ROI, entropy

STAT = ("mean", "var", "skew", "kurt", "median", "min", "p10", "p90", "max", "iqr", "range", "mad", "rmad", "medad", "cov", "qcod", "energy", "rms")


def statistics(vox: DataFrame) -> DataFrame:
    """18 statistics of the intensities that are left (null ones do not count)."""
    v, w = F.col("intensity"), Window.partitionBy(*ROI)
    known = vox.where(v.isNotNull()).select(*ROI, "intensity")
    known = known.withColumn("q", F.expr("percentile(intensity, array(0.1, 0.25, 0.5, 0.75, 0.9))").over(w)).withColumn("mu", F.avg(v).over(w))
    middle = v.between(F.col("q")[0], F.col("q")[4])
    known = known.withColumn("rmu", F.avg(F.when(middle, v)).over(w))
    d = v - F.col("mu")
    s = known.groupBy(*ROI).agg(
        F.first("mu").alias("mean"), F.avg(d * d).alias("var"), F.avg(d * d * d).alias("m3"), F.avg(d * d * d * d).alias("m4"), F.first("q").alias("q"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(F.abs(d)).alias("mad"), F.avg(F.when(middle, F.abs(v - F.col("rmu")))).alias("rmad"),
        F.avg(F.abs(v - F.col("q")[2])).alias("medad"), F.sum(v * v).alias("energy"), F.sqrt(F.avg(v * v)).alias("rms"),
    )
    var, mean = F.col("var"), F.col("mean")
    low, high = F.col("q")[1].cast("int").cast("double"), F.col("q")[3].cast("int").cast("double")
    return s.withColumns({
        "skew": F.when(var > 0, F.col("m3") / F.pow(F.when(var > 0, var), F.lit(1.5))).otherwise(0.0),
        "kurt": F.when(var > 0, F.col("m4") / F.when(var > 0, var * var) - 3).otherwise(0.0),
        "median": F.col("q")[2], "p10": F.col("q")[0], "p90": F.col("q")[4], "iqr": F.col("q")[3] - F.col("q")[1], "range": F.col("max") - F.col("min"),
        "cov": F.when((var > 0) & (mean != 0), F.sqrt(var) / F.when(mean != 0, mean)).otherwise(0.0),
        # The quartiles are cut to whole numbers first; a sum of zero counts as the machine epsilon.
        "qcod": (high - low) / F.when(high + low == 0, 2.220446049250313e-16).otherwise(high + low),
    }).select(*ROI, *[F.col(m).alias(f"stat_{m}") for m in STAT])


IH = ("mean", "var", "skew", "kurt", "median", "min", "p10", "p90", "max", "mode", "iqr", "range", "mad", "rmad", "medad", "cov", "qcod", "entropy", "uniformity", "max_grad", "max_grad_g", "min_grad", "min_grad_g")


def histogram(q: DataFrame) -> DataFrame:
    """(image_id, roi, g, n): counts of the levels 1 .. highest, empty ones too."""
    level = F.greatest(F.col("level"), F.lit(1))
    counts = q.where("level IS NOT NULL").groupBy(*ROI, level.alias("g")).agg(F.count("*").alias("n"))
    dense = counts.groupBy(*ROI).agg(F.explode(F.sequence(F.lit(1), F.max("g"))).alias("g"))
    return dense.join(counts, [*ROI, "g"], "left").fillna(0, ["n"])


def histogram_features(q: DataFrame) -> DataFrame:
    """23 features of the histogram of levels."""
    w = Window.partitionBy(*ROI)
    up = w.orderBy("g")
    g, n, p, mu = F.col("g"), F.col("n"), F.col("p"), F.col("mu")
    h = histogram(q).withColumn("p", n / F.sum("n").over(w))
    running = F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w)
    h = h.withColumn("cum", running).withColumn("mu", F.sum(g * p).over(w))
    before, after = F.lag("n").over(up), F.lead("n").over(up)
    h = h.withColumn("grad", F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), (after - n).cast("double")).when(after.isNull(), (n - before).cast("double")).otherwise((after - before) / 2))
    first = lambda q: F.min(F.when(F.col("cum") >= q, g)).over(w)
    h = h.withColumns({"q10": first(0.1), "q25": first(0.25), "q50": first(0.5), "q75": first(0.75), "q90": first(0.9)})
    inside = g.between(F.col("q10"), F.col("q90"))
    h = h.withColumn("rmu", F.sum(F.when(inside, g * p)).over(w) / F.sum(F.when(inside, p)).over(w))
    d = g - mu
    s = h.groupBy(*ROI).agg(
        F.first("mu").alias("mean"), F.sum(p * d * d).alias("var"), F.sum(p * d * d * d).alias("m3"), F.sum(p * d * d * d * d).alias("m4"),
        *[F.first(c).alias(c) for c in ("q10", "q25", "q50", "q75", "q90")], F.min(F.when(n > 0, g)).alias("min"), F.max("g").alias("max"),
        F.min(F.struct(-n, F.abs(d), g)).getField("g").alias("mode"), F.sum(p * F.abs(d)).alias("mad"),
        (F.sum(F.when(inside, p * F.abs(g - F.col("rmu")))) / F.sum(F.when(inside, p))).alias("rmad"), F.sum(p * F.abs(g - F.col("q50"))).alias("medad"),
        entropy(p).alias("entropy"), F.sum(p * p).alias("uniformity"), F.max("grad").alias("max_grad"), F.min("grad").alias("min_grad"),
        F.min(F.struct(-F.col("grad"), g)).getField("g").alias("max_grad_g"), F.min(F.struct("grad", g)).getField("g").alias("min_grad_g"),
    )
    var, mean = F.col("var"), F.col("mean")
    total = F.col("q75") + F.col("q25")
    return s.withColumns({
        "skew": F.when(var > 0, F.col("m3") / F.pow(F.when(var > 0, var), F.lit(1.5))).otherwise(0.0),
        "kurt": F.when(var > 0, F.col("m4") / F.when(var > 0, var * var) - 3).otherwise(0.0),
        "median": F.col("q50"), "p10": F.col("q10"), "p90": F.col("q90"), "iqr": F.col("q75") - F.col("q25"), "range": F.col("max") - F.col("min"),
        "cov": F.when((var > 0) & (mean != 0), F.sqrt(var) / F.when(mean != 0, mean)).otherwise(0.0),
        "qcod": F.when(total == 0, 1e6).otherwise((F.col("q75") - F.col("q25")) / F.when(total != 0, total)),
    }).select(*ROI, *[F.col(m).cast("double").alias(f"ih_{m}") for m in IH])


IVH = ("v10", "v90", "i10", "i90", "diff_v10_v90", "diff_i10_i90", "auc")


def volume_histogram(vox: DataFrame, width: float = 1.0) -> DataFrame:
    """7 features of the share of voxels at or above each threshold floor(min), ... in steps of `width` up to ceil(max)."""
    known = vox.where("intensity IS NOT NULL")
    span = known.groupBy(*ROI).agg(F.floor(F.min("intensity")).cast("double").alias("t0"), F.ceil(F.max("intensity")).cast("double").alias("t1"), F.count("*").alias("total"))
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col("t1") - F.col("t0")) / width))
    grid = span.withColumn("b", F.explode(steps))
    # A value counts for every threshold up to it: the first bin above it is where it stops to count.
    stops = known.join(span, ROI).groupBy(*ROI, (F.floor((F.col("intensity") - F.col("t0")) / width) + 1).alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*ROI).orderBy("b")
    curve = grid.join(stops, [*ROI, "b"], "left").withColumn("below", F.sum(F.coalesce("n", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    curve = curve.withColumns({"frac": 1 - F.col("below") / F.col("total"), "t": F.col("t0") + F.col("b") * width})
    last = F.max("t").over(Window.partitionBy(*ROI))
    curve = curve.withColumn("norm", F.when(last > F.col("t0"), (F.col("t") - F.col("t0")) / F.when(last > F.col("t0"), last - F.col("t0"))).otherwise(0.0))
    curve = curve.withColumn("area", (F.lead("norm").over(w) - F.col("norm")) * (F.lead("frac").over(w) + F.col("frac")) / 2)
    at = lambda x: F.coalesce(F.min_by("frac", F.when(F.col("norm") >= x, F.col("b"))), F.max_by("frac", "b"))
    under = lambda x: F.min(F.when(F.col("frac") <= x, F.col("t")))
    s = curve.groupBy(*ROI).agg(at(0.1).alias("v10"), at(0.9).alias("v90"), under(0.1).alias("i10"), under(0.9).alias("i90"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("auc"))
    s = s.withColumns({"diff_v10_v90": F.col("v10") - F.col("v90"), "diff_i10_i90": F.col("i10") - F.col("i90")})
    return s.select(*ROI, *[F.col(m).alias(f"ivh_{m}") for m in IVH])


def sphere(spacing: Sequence[float]) -> list[tuple[int, int, int]]:
    """Offsets of the voxel centres within a ball of 1 cubic centimetre."""
    from math import pi

    radius = 10 * (3 / (4 * pi)) ** (1 / 3)
    reach = [int(radius / s) for s in spacing]
    return [
        (a, b, c)
        for a in range(-reach[0], reach[0] + 1) for b in range(-reach[1], reach[1] + 1) for c in range(-reach[2], reach[2] + 1)
        if (a * spacing[0]) ** 2 + (b * spacing[1]) ** 2 + (c * spacing[2]) ** 2 <= radius * radius
    ]


def intensity_peak(vox: DataFrame, image: DataFrame, spacing: Sequence[float]) -> DataFrame:
    """Local and global peak: the largest mean over a 1 cubic centimetre ball, of the image's voxels, inside the region or not.

    Slabs of an image with the slices around them are looked at apart; the values of a ball are looked up by place."""
    ball = sphere(spacing)
    reach = [max(o[a] for o in ball) for a in range(3)]
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    given = in_slabs(image.select("image_id", F.lit("").alias("name"), F.lit(False).alias("centre"), "x", "y", "z", number("intensity").alias("v")), "z", 2 * reach[2])
    slab = F.floor((F.col("z") + reach[2]) / SLAB).cast("int")
    centres = vox.select("image_id", F.col("roi").alias("name"), F.lit(True).alias("centre"), "x", "y", "z", number("intensity").alias("v"), slab.alias("slab"), slab.alias("slab_"))

    def work(g: np.ndarray, c: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        rows = np.flatnonzero(c["centre"])
        at = Places(g, [c[a] for a in "xyz"], max(reach))
        key = np.empty(len(g), np.int64)
        key[at.order] = at.key
        # Centres and voxels share one grid of places; values are looked up among the voxels only.
        image_rows = np.flatnonzero(~c["centre"])
        order = image_rows[np.argsort(key[image_rows], kind="stable")]
        places, values, centre = key[order], c["v"][order], key[rows]
        known = np.where(np.isnan(values), 0.0, 1.0)
        values = np.where(known > 0, values, 0.0)
        table = None
        if at.table is not None:
            table = np.full(len(at.table), -1, np.int32)
            table[places] = np.arange(len(places), dtype=np.int32)
        count, total, met = np.zeros((3, len(rows)))
        for offset in ball:
            to = centre + at.step(offset)
            if table is not None:
                found = table[to]
                hit = np.flatnonzero(found >= 0)
            else:
                found = np.minimum(np.searchsorted(places, to), max(0, len(places) - 1))
                hit = np.flatnonzero(places[found] == to) if len(places) else np.zeros(0, np.int64)
            found = found[hit]
            met[hit] += 1
            count[hit] += known[found]
            total[hit] += values[found]
        keep = np.flatnonzero(met)
        ball_mean = np.where(count > 0, total / np.maximum(count, 1), np.nan)[keep]
        yield {"group": g[rows[keep]], "roi": c["name"][rows[keep]], "own": c["v"][rows[keep]], "ball": ball_mean}

    means = streamed(given.unionByName(centres), ["image_id", "slab_"], work, "roi string, own double, ball double")
    # Values of the highest intensity come last in the order of (own, ball), and of those the one of the highest mean.
    return means.groupBy(*ROI).agg(F.max(F.when(F.col("own").isNotNull(), F.struct("own", "ball"))).getField("ball").alias("loc_peak_loc"), F.max("ball").alias("loc_peak_glob"))


def moment_invariants(vox: DataFrame) -> DataFrame:
    """Five invariants each of the intensity field, (v - min) / (mean - min), and of the shape; coordinates in voxels."""
    w = Window.partitionBy(*ROI)
    low, mean = F.min("intensity").over(w), F.avg("intensity").over(w)
    rows = vox.withColumn("f", F.when(mean > low, (F.col("intensity") - low) / F.when(mean > low, mean - low)).otherwise(0.0))
    rows = rows.withColumn("t", F.explode(F.array(F.struct(F.lit("intensity").alias("field"), F.coalesce("f", F.lit(0.0)).alias("m")), F.struct(F.lit("shape").alias("field"), F.lit(1.0).alias("m")))))
    rows = rows.select(*ROI, "x", "y", "z", "t.*")
    u = Window.partitionBy(*ROI, "field")
    for a in "xyz":
        rows = rows.withColumn(f"c{a}", F.col(a) - F.sum(F.col(a) * F.col("m")).over(u) / F.nullif(F.sum("m").over(u), F.lit(0.0)))
    powers = [(a, b, c) for a in range(4) for b in range(4) for c in range(4) if a + b + c in (2, 3)]
    mono = lambda a, b, c: F.sum(_product([F.col("m")] + [F.col("cx")] * a + [F.col("cy")] * b + [F.col("cz")] * c))
    sums = rows.groupBy(*ROI, "field").agg(F.sum("m").alias("m000"), *[mono(*k).alias("m%d%d%d" % k) for k in powers])
    mass = F.nullif(F.col("m000"), F.lit(0.0))
    e = {k: F.col("m%d%d%d" % k) / F.pow(mass, F.lit(5 / 3 if sum(k) == 2 else 2.0)) for k in powers}
    xx, yy, zz, xy, xz, yz = e[2, 0, 0], e[0, 2, 0], e[0, 0, 2], e[1, 1, 0], e[1, 0, 1], e[0, 1, 1]
    cube = [e[3, 0, 0], e[0, 3, 0], e[0, 0, 3]]
    mixed = [e[2, 1, 0], e[2, 0, 1], e[1, 2, 0], e[0, 2, 1], e[1, 0, 2], e[0, 1, 2]]
    values = {
        "i1": xx + yy + zz, "f2": xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz),
        "i2": xx * yy + xx * zz + yy * zz - xy * xy - xz * xz - yz * yz,
        "i3": xx * yy * zz + 2 * xy * xz * yz - xx * yz * yz - yy * xz * xz - zz * xy * xy,
        "f3": _total([c * c for c in cube]) + 3 * _total([m * m for m in mixed]) + 6 * e[1, 1, 1] * e[1, 1, 1],
    }
    tall = sums.select(*ROI, "field", *[v.alias(k) for k, v in values.items()])
    return tall.groupBy(*ROI).agg(*[F.max(F.when(F.col("field") == f, F.col(k))).alias(f"moment_{k}_{f}") for f in ("intensity", "shape") for k in values])


def _product(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out * c
    return out


def _total(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def diagnostics(raw: DataFrame, raw_image: DataFrame, vox: DataFrame, image: DataFrame, old: Sequence[float], new: Sequence[float]) -> DataFrame:
    """60 diagnostic columns. raw and vox: voxels of regions before and after preparation (null intensity: re-segmented away);
    raw_image and image: all voxels of the images before and after resampling; old and new: their spacing."""

    def of_image(df: DataFrame, spacing: Sequence[float], tag: str) -> DataFrame:
        s = df.groupBy("image_id").agg(
            *[(F.max(a) + 1).cast("int").alias(f"img_dim_{a}_{tag}_img") for a in "xyz"],
            *[F.round(f("intensity"), 3).alias(f"{n}_int_{tag}_img") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))],
        )
        return s.withColumns({f"vox_dim_{a}_{tag}_img": F.round(F.lit(float(d)), 3) for a, d in zip("xyz", spacing, strict=True)})

    def of_roi(df: DataFrame, tag: str, value: str) -> DataFrame:
        box = {a: (F.max(a) - F.min(a) + 1).cast("int") for a in "xyz"}
        return df.groupBy(*ROI).agg(
            *[box[a].alias(f"{m}_mask_bb_dim_{a}_{tag}_roi") for m in ("int", "morph") for a in "xyz"],
            (F.count(value) if tag == "reseg" else F.count("*")).alias(f"int_mask_vox_count_{tag}_roi"), F.count("*").alias(f"morph_mask_vox_count_{tag}_roi"),
            *[F.round(f(value), 3).alias(f"int_mask_{n}_int_{tag}_roi") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))],
        )

    out = of_roi(raw, "init", "intensity").join(of_roi(vox, "interp", "raw"), ROI).join(of_roi(vox, "reseg", "intensity"), ROI)
    out = out.join(of_image(raw_image, old, "init"), "image_id").join(of_image(image, new, "interp"), "image_id")
    return out.withColumns({f"int_mask_dim_{a}_{tag}_roi": F.col(f"img_dim_{a}_{'init' if tag == 'init' else 'interp'}_img") for tag in ("init", "interp", "reseg") for a in "xyz"})
