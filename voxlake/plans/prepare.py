"""Preparation of images and regions as one plan: resampling, partial volume, rounding, re-segmentation, outliers, fallback.

`vox` has all voxels (image_id, x, y, z, intensity) of images on the grids `sizes` (image_id, nx, ny, nz); `regions` the voxels
(image_id, roi, x, y, z) of the chosen regions. All images of a call have one spacing; `by_spacing` cuts a batch up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from voxlake.operators import prep
from voxlake.plans.settings import Settings


def target_spacing(s: Settings, spacing: Sequence[float]) -> tuple[float, float, float]:
    """The new spacing: isotropic, or in the plane only; the old one without scaling."""
    if not s.isScale:
        return tuple(map(float, spacing))
    if s.isIsot2D:
        return (float(s.isotVoxSize2D), float(s.isotVoxSize2D), float(spacing[2]))
    return (float(s.isotVoxSize),) * 3


def resampled(vox: DataFrame, sizes: DataFrame, method: str, new: Sequence[float], old: Sequence[float]) -> DataFrame:
    if method.lower() == "cubic":
        return prep.resample_cubic(vox, sizes, tuple(new), tuple(old))
    grid = prep.target_grid(sizes, tuple(new), tuple(old))
    return prep.resample_linear(vox, grid) if method.lower() == "linear" else prep.resample_nearest(vox, grid)


def prepared(vox: DataFrame, regions: DataFrame, sizes: DataFrame, spacing: Sequence[float], s: Settings) -> tuple[DataFrame, DataFrame, tuple[float, float, float]]:
    """(voxels of regions with intensity and raw, all voxels of the images, their spacing) after preparation.

    Missing intensities of the images count as 0 when resampling. Where re-segmentation and the outlier rule leave no intensity
    of a region, it keeps those it had before."""
    new = target_spacing(s, spacing)
    image = vox.select("image_id", "x", "y", "z", F.col("intensity").cast("double").alias("intensity"))
    if any(abs(a - b) > 1e-9 for a, b in zip(new, spacing, strict=True)):
        image = resampled(image.fillna(0.0, ["intensity"]), sizes, s.VoxInterp, new, spacing)
        # Each region is a mask of its own: its key takes the place of the image's.
        key = F.struct("image_id", "roi").alias("image_id")
        mask = regions.select(key, "x", "y", "z", F.lit(1.0).alias("intensity"))
        grids = regions.select("image_id", "roi").distinct().join(sizes, "image_id").select(key, "nx", "ny", "nz")
        method = "linear" if s.ROIInterp.lower() == "linear" else "nearest"
        kept = prep.partial_volume(resampled(mask, grids, method, new, spacing), s.ROI_PV, method == "linear")
        regions = kept.select("image_id.image_id", "image_id.roi", "x", "y", "z")
    if s.isGLround:
        image = prep.rounded(image)
    rows = regions.select("image_id", "roi", "x", "y", "z").join(image, ["image_id", "x", "y", "z"]).withColumn("raw", F.col("intensity"))
    if s.isReSegRng:
        rows = prep.in_range(rows, s.ReSegIntrvl01, s.ReSegIntrvl02)
    if s.isOutliers:
        rows = prep.without_outliers(rows)
    return prep.or_unmasked(rows).select("image_id", "roi", "x", "y", "z", "intensity", "raw"), image, new
