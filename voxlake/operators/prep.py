"""Preparation of regions: rounding, re-segmentation, discretisation, resampling. Missing intensities are null, never NaN."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from voxlake.operators.batches import SLAB, in_slabs, tasks

ROI = ["image_id", "roi"]


def over_region():
    return Window.partitionBy(*ROI)


def rounded(vox: DataFrame) -> DataFrame:
    """Intensities to the nearest whole number, halves to even."""
    return vox.withColumn("intensity", F.rint("intensity"))


def in_range(vox: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """Range re-segmentation: intensities outside become missing, the morphological mask stays."""
    keep = F.lit(True)
    if low is not None:
        keep &= F.col("intensity") >= low
    if high is not None:
        keep &= F.col("intensity") <= high
    return vox.withColumn("intensity", F.when(keep, F.col("intensity")))


def without_outliers(vox: DataFrame, deviations: float = 3.0) -> DataFrame:
    """Intensities further than so many population deviations from the region's mean become missing."""
    w = over_region()
    mean, dev = F.avg("intensity").over(w), F.stddev_pop("intensity").over(w)
    return vox.withColumn("intensity", F.when(F.abs(F.col("intensity") - mean) <= deviations * dev, F.col("intensity")))


def or_unmasked(vox: DataFrame, raw: str = "raw") -> DataFrame:
    """A region whose intensities are all missing falls back to column `raw`."""
    return vox.withColumn("intensity", F.when(F.count("intensity").over(over_region()) == 0, F.col(raw)).otherwise(F.col("intensity")))


def fixed_bin_size(vox: DataFrame, width: float, anchor: float | None = None) -> DataFrame:
    """level = floor((v - anchor) / width) + 1, at least 1; without an anchor the region's least intensity is it."""
    origin = F.min("intensity").over(over_region()) if anchor is None else F.lit(anchor)
    return vox.withColumn("level", F.greatest(F.floor((F.col("intensity") - origin) / width) + 1, F.when(F.col("intensity").isNotNull(), 1)).cast("int"))


def fixed_bin_number(vox: DataFrame, bins: int) -> DataFrame:
    """level = floor(bins * (v - min) / (max - min)) + 1 within 1..bins; a constant region has level 1."""
    w = over_region()
    low, high = F.min("intensity").over(w), F.max("intensity").over(w)
    scaled = F.floor(bins * (F.col("intensity") - low) / F.when(high > low, high - low)) + 1
    level = F.when(high > low, F.least(F.greatest(scaled, F.lit(1)), F.lit(bins))).otherwise(1)
    return vox.withColumn("level", F.when(F.col("intensity").isNotNull(), level).cast("int"))


def lloyd(vox: DataFrame, bins: int, rounds: int = 50) -> DataFrame:
    """Levels by one-dimensional Lloyd clustering of each region, numbered by rising centre (deterministic)."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    def clustered(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.intensity.to_numpy(float)
        ok = ~np.isnan(v)
        level = np.full(len(v), np.nan)
        distinct, inverse, n = np.unique(v[ok], return_inverse=True, return_counts=True)
        if len(distinct):
            centres = np.quantile(distinct, (np.arange(min(bins, len(distinct))) + 0.5) / min(bins, len(distinct)))
            for _ in range(rounds):
                nearest = np.searchsorted((centres[1:] + centres[:-1]) / 2, distinct, side="right")
                mass = np.bincount(nearest, n, len(centres))
                moved = np.where(mass > 0, np.bincount(nearest, n * distinct, len(centres)) / np.maximum(mass, 1), centres)
                if np.array_equal(moved, centres):
                    break
                centres = np.sort(moved)
            nearest = np.searchsorted((centres[1:] + centres[:-1]) / 2, distinct, side="right")
            level[ok] = (np.unique(nearest, return_inverse=True)[1] + 1)[inverse]
        return pdf.assign(level=pd.array(level, dtype="Int32"))

    schema = StructType([f for f in vox.schema.fields if f.name != "level"] + [StructField("level", IntegerType())])
    return vox.drop("level").groupBy(*ROI).applyInPandas(clustered, schema)


# --- resampling -------------------------------------------------------------------------------------------------------

def target_grid(images: DataFrame, new: tuple[float, float, float], old: tuple[float, float, float]) -> DataFrame:
    """(image_id, x, y, z, sx, sy, sz, slab): the places of the new grid, and where they lie in the old one (centres aligned).

    `images` has image_id and the grid's size nx, ny, nz; the new size is ceil(n * old / new). Slices are dealt by image and slab
    of the old grid before the places in them are made."""
    out = images.select("image_id", "nx", "ny", "nz")
    for axis, t, s in reversed(list(zip("xyz", new, old, strict=True))):
        out = out.withColumn(f"m{axis}", F.ceil(F.col(f"n{axis}") * s / t).cast("int"))
        out = out.withColumn(axis, F.explode(F.sequence(F.lit(0), F.col(f"m{axis}") - 1)))
        place = (F.col(axis) - (F.col(f"m{axis}") - 1) / 2.0) * (t / s) + (F.col(f"n{axis}") - 1) / 2.0
        out = out.withColumn(f"s{axis}", F.greatest(F.lit(0.0), F.least(place, F.col(f"n{axis}") - 1.0)))
        if axis == "z":
            out = out.withColumn("slab", F.floor((F.floor("sz") + 1) / SLAB).cast("int")).repartition(tasks(images), "image_id", "slab")
    return out.select("image_id", "x", "y", "z", "sx", "sy", "sz", "slab")


def resample_nearest(vox: DataFrame, grid: DataFrame) -> DataFrame:
    """Value of the old voxel nearest to each new place (halves up); places without a voxel have no row."""
    at = grid.select("image_id", "x", "y", "z", *[F.floor(F.col(f"s{a}") + 0.5).cast("int").alias(f"o{a}") for a in "xyz"])
    old = vox.select("image_id", *[F.col(a).alias(f"o{a}") for a in "xyz"], "intensity")
    return at.join(old, ["image_id", "ox", "oy", "oz"]).select("image_id", "x", "y", "z", "intensity")


def resample_linear(vox: DataFrame, grid: DataFrame, empty: float = 0.0) -> DataFrame:
    """Trilinear interpolation by an equi-join with the eight corners; a missing voxel counts as `empty`.

    Voxels go to the slabs of the places they are corners of, so the join and the sums stay where the slab is: neither corners nor
    products move, and a task holds the voxels of its slabs."""
    corners = F.expr("array(" + ",".join(f"named_struct('a',{k & 1},'b',{k >> 1 & 1},'c',{k >> 2})" for k in range(8)) + ")")
    each = grid.withColumn("c", F.explode(corners))
    weight = F.lit(1.0)
    for axis, bit in zip("xyz", "abc", strict=True):
        fraction = F.col(f"s{axis}") - F.floor(f"s{axis}")
        weight = weight * F.when(F.col(f"c.{bit}") == 1, fraction).otherwise(1 - fraction)
        each = each.withColumn(f"o{axis}", (F.floor(f"s{axis}") + F.col(f"c.{bit}")).cast("int"))
    each = each.withColumn("w", weight).where("w > 0").select("image_id", "slab", "x", "y", "z", "ox", "oy", "oz", "w")
    old = in_slabs(vox, "z", 1).select("image_id", "slab", *[F.col(a).alias(f"o{a}") for a in "xyz"], "intensity")
    old = old.repartition(tasks(grid), "image_id", "slab").hint("shuffle_hash")
    joined = each.join(old, ["image_id", "slab", "ox", "oy", "oz"], "left")
    sums = joined.groupBy("image_id", "slab", "x", "y", "z").agg(F.sum(F.col("w") * F.coalesce("intensity", F.lit(empty))).alias("intensity"))
    return sums.drop("slab")


def spline_coefficients(line: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients along the first axis, mirrored at the ends."""
    pole = np.sqrt(3.0) - 2
    n = len(line)
    if n < 2:
        return line.astype(float)
    c = line.astype(float) * 6
    powers = pole ** np.arange(n)
    c[0] = (c * powers.reshape(-1, *[1] * (c.ndim - 1))).sum(axis=0) if n > 20 else _mirrored_start(c, pole)
    for k in range(1, n):
        c[k] += pole * c[k - 1]
    c[-1] = pole / (pole * pole - 1) * (c[-1] + pole * c[-2])
    for k in range(n - 2, -1, -1):
        c[k] = pole * (c[k + 1] - c[k])
    return c


def _mirrored_start(c: np.ndarray, pole: float) -> np.ndarray:
    n = len(c)
    total, z, back, step = c[0] + pole ** (n - 1) * c[-1], pole, pole ** (2 * n - 3), 1 / pole
    for k in range(1, n - 1):
        total = total + (z + back) * c[k]
        z, back = z * pole, back * step
    return total / (1 - pole ** (2 * n - 2))


def resample_cubic(vox: DataFrame, images: DataFrame, new: tuple, old: tuple, empty: float = 0.0) -> DataFrame:
    """Tricubic spline interpolation, image by image in numpy (the prefilter runs along whole lines)."""
    joined = vox.select("image_id", "x", "y", "z", F.col("intensity").cast("double").alias("intensity")).join(images, "image_id")

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        size = [int(pdf[c].iloc[0]) for c in ("nx", "ny", "nz")]
        block = np.full(size, empty)
        block[pdf.x, pdf.y, pdf.z] = pdf.intensity
        for axis, (t, s) in enumerate(zip(new, old, strict=True)):
            n, m = size[axis], int(np.ceil(size[axis] * s / t))
            lines = spline_coefficients(np.moveaxis(block, axis, 0))
            place = np.clip((np.arange(m) - (m - 1) / 2) * (t / s) + (n - 1) / 2, 0, n - 1)
            base = np.floor(place).astype(int)
            f = (place - base).reshape(-1, *[1] * (block.ndim - 1))
            weights = ((1 - f) ** 3 / 6, (3 * f**3 - 6 * f**2 + 4) / 6, (-3 * f**3 + 3 * f**2 + 3 * f + 1) / 6, f**3 / 6)
            out = 0.0
            for k, w in enumerate(weights):
                i = np.abs(base + k - 1)
                i = np.where(i > n - 1, np.maximum(2 * (n - 1) - i, 0), i) if n > 1 else np.zeros_like(i)
                out = out + w * lines[i]
            block = np.moveaxis(out, 0, axis) if n > 1 else np.moveaxis(np.repeat(np.moveaxis(block, axis, 0), m, 0), 0, axis)
        x, y, z = np.indices(block.shape).reshape(3, -1)
        return pd.DataFrame({"image_id": pdf.image_id.iloc[0], "x": x, "y": y, "z": z, "intensity": block.ravel()})

    kind = dict(vox.dtypes)["image_id"]
    return joined.groupBy("image_id").applyInPandas(made, f"image_id {kind}, x int, y int, z int, intensity double")


def partial_volume(mask: DataFrame, threshold: float = 0.5, linear: bool = True) -> DataFrame:
    """Voxels of a resampled mask that stay: share at least the threshold when linear, else more than one half."""
    return mask.where(F.col("intensity") >= threshold if linear else F.col("intensity") > 0.5)
