"""Lesion aggregation, union and pivot of feature rows, report parsing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

#: Columns that add up over the lesions of a group; other features are means weighted by voxel counts.
SUMMED = (
    "morph_volume_count", "morph_volume_mesh", "morph_surface_area", "morph_least_axis_length", "morph_minor_axis_length",
    "morph_major_axis_length", "morph_max_3d_diameter",
)
DIAGNOSTIC = ("_init_img", "_interp_img", "_init_roi", "_interp_roi", "_reseg_roi")


def region_group(roi) -> F.Column:
    return F.split(roi, "_lesion_")[0]


def lesions(rows: DataFrame, features: Sequence[str], per: str = "per_Img", weight: str = "volume", deep: Iterable[str] = (), order: str | None = None) -> DataFrame:
    """One row per image, or per image and label: deep features are averaged, diagnostics take the first value in `order`
    (the region's name by default), SUMMED ones add up, the others are weighted means; nulls never count."""
    keys = ["image_id"] if per.lower() == "per_img" else ["image_id", "group"]
    grouped = rows.withColumn("group", region_group(F.col("roi")))
    deep = set(deep)
    out = []
    for c in features:
        v = F.col(c)
        if c in deep:
            agg = F.avg(v)
        elif c.endswith(DIAGNOSTIC):
            agg = F.min_by(v, F.when(v.isNotNull(), F.struct(F.col(order or "roi"))))
        elif c in SUMMED:
            agg = F.sum(v)
        else:
            agg = F.sum(v * F.col(weight)) / F.nullif(F.sum(F.when(v.isNotNull(), F.col(weight))), F.lit(0))
        out.append(agg.alias(c))
    result = grouped.groupBy(*keys).agg(*out)
    return result if len(keys) == 1 else result.withColumnRenamed("group", "roi")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are null in it."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tall(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(image_id, roi, feature, value)."""
    return rows.select("image_id", "roi", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])).alias("f")).select("image_id", "roi", "f.*")


def wide(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The inverse of tall: one column for each named feature, so the schema is known before any row is read."""
    return rows.groupBy("image_id", "roi").pivot("feature", list(features)).agg(F.first("value"))


def by_mode(rows: DataFrame, family: str, metrics: Sequence[str], modes: Sequence[str]) -> DataFrame:
    """From rows by (image_id, roi, mode) one row with columns family_metric_mode."""
    return rows.groupBy("image_id", "roi").agg(*[F.max(F.when(F.col("mode") == mode, F.col(m))).alias(f"{family}_{m}_{mode}") for m in metrics for mode in modes])


def report(lines: DataFrame) -> DataFrame:
    """(image_id, roi, level, message) from log lines `time - LEVEL - [id] message about ROI 'name'`."""
    line = F.col("line")
    return lines.select(
        F.regexp_extract(line, r"\[([^\]]+)\]", 1).alias("image_id"), F.regexp_extract(line, r"ROI '([^']+)'", 1).alias("roi"),
        F.regexp_extract(line, r"\b(DEBUG|INFO|WARNING|ERROR|CRITICAL)\b", 1).alias("level"), F.trim(F.regexp_replace(line, r"^.*?\] ?", "")).alias("message"),
    )


def at_level(rows: DataFrame, level: str) -> DataFrame:
    """Rows of a report: all, none, or those of one level."""
    level = level.lower()
    return rows if level == "all" else rows.where(F.lit(False) if level == "none" else F.lower("level") == level)
