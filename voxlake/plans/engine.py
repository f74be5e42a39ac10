"""The full feature plan over regions: each selected family is one plan over shared voxel relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from voxlake.operators import firstorder, prep, shape, texture
from voxlake.operators.aggregate import by_mode
from voxlake.operators.texture import MODES3, MODES6, ROI
from voxlake.plans.registry import CATEGORIES, DIMENSIONS, FAMILIES, parse, select_columns
from voxlake.plans.storage import stored


def modes_of(dims: Sequence[str], modes: Sequence[str]) -> list[str]:
    return [m for m in modes if m.removesuffix("_avg").removesuffix("_comb").lower() in dims]


def extract(
    vox: DataFrame, image: DataFrame, spacing: Sequence[float], *, width: float | None = 8.0, bins: int | None = None, anchor: float | None = None,
    categories: str = "all", dimensions: str = "all", raw_vox: DataFrame | None = None, raw_image: DataFrame | None = None, raw_spacing: Sequence[float] | None = None,
    lloyd: bool = False,
) -> DataFrame:
    """One row per region with every selected feature column.

    vox: (image_id, roi, x, y, z, intensity, raw) after re-segmentation; image: all voxels (image_id, x, y, z, intensity)."""
    cats, dims = parse(categories, CATEGORIES, "category"), parse(dimensions, DIMENSIONS, "dimension")
    if lloyd:
        q = prep.lloyd(vox, bins or 25)
    else:
        q = prep.fixed_bin_number(vox, bins) if bins else prep.fixed_bin_size(vox, width or 25.0, anchor)
    # All families read the voxels with their levels from here, so what makes them runs once.
    q = stored(q, "levels")
    vox = q.drop("level")
    six, three = modes_of(dims, MODES6), modes_of(dims, MODES3)
    first = "1st" in dims
    parts = []
    if "diag" in cats:
        parts.append(firstorder.diagnostics(raw_vox if raw_vox is not None else vox.withColumn("intensity", F.col("raw")), raw_image if raw_image is not None else image, vox, image, raw_spacing or spacing, spacing))
    if "morph" in cats and first:
        parts.append(shape.all_features(vox, spacing))
    if "ip" in cats and first:
        parts.append(firstorder.intensity_peak(vox.withColumn("intensity", F.col("raw")), image, spacing))
    if "stat" in cats and first:
        parts.append(firstorder.statistics(vox))
    if "ih" in cats and first:
        parts.append(firstorder.histogram_features(q))
    if "ivh" in cats and first:
        parts.append(firstorder.volume_histogram(vox))
    if "glcm" in cats and six:
        parts.append(by_mode(texture.cooccurrence_features(q, six), "glcm", texture.GLCM, six))
    if "glrlm" in cats and six:
        parts.append(by_mode(texture.run_features(q, six), "glrlm", texture.NAMES["glrlm"], six))
    if "glszm" in cats and three:
        parts.append(by_mode(texture.zone_features(q, "size", three), "szm", texture.NAMES["szm"], three))
    if "gldzm" in cats and three:
        parts.append(by_mode(texture.zone_features(q, "distance", three), "dzm", texture.NAMES["dzm"], three))
    if "ngtdm" in cats and three:
        parts.append(by_mode(texture.tone_features(q, three), "ngtdm", texture.NGTDM, three))
    if "ngldm" in cats and three:
        parts.append(by_mode(texture.dependence_features(q, three), "ngl", texture.NAMES["ngl"], three))
    if "mi" in cats:
        parts.append(firstorder.moment_invariants(vox))
    # A family without a row for a region (too few voxels) leaves its columns null; the region stays.
    out = vox.select(*ROI).distinct()
    for p in parts:
        # Each family is written once: a join of all their plans would be planned for longer than it runs.
        out = out.join(stored(p, "family"), ROI, "left")
    return out.select(*ROI, *select_columns(categories, dimensions))


__all__ = ["FAMILIES", "extract"]
