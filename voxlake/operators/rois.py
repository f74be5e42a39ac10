"""From label masks to regions: connected components, volume filter, the largest regions per image or per label."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from voxlake.operators.texture import DIRECTIONS, least_labels, packed


def labels(mask: DataFrame) -> DataFrame:
    """(image_id, label): the distinct labels, background 0 is none."""
    return mask.where("label <> 0").select("image_id", "label").distinct()


def label_volumes(mask: DataFrame) -> DataFrame:
    return mask.where("label <> 0").groupBy("image_id", "label").agg(F.count("*").alias("volume"))


def components(mask: DataFrame) -> DataFrame:
    """(image_id, x, y, z, label, comp): 26-connected components of each label, numbered from 1 by their first voxel in the
    order z, y, x. One exchange by image; an image's mask is labelled as a whole in numpy."""
    kind = dict(mask.dtypes)["image_id"]

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        key, (sx, sy, sz) = packed(pdf, pdf.label.to_numpy())
        order = np.argsort(key, kind="stable")
        root = least_labels(key[order], [a * sx + b * sy + c * sz for a, b, c in DIRECTIONS])
        rows = pdf.iloc[order].assign(comp=np.unique(root, return_inverse=True)[1])
        rows["comp"] = rows.comp - rows.groupby("label").comp.transform("min")
        rows["comp"] = rows.groupby("label").comp.rank(method="dense").astype(int)
        return rows[["image_id", "x", "y", "z", "label", "comp"]]

    return mask.where("label <> 0").select("image_id", "x", "y", "z", "label").groupBy("image_id").applyInPandas(
        found, f"image_id {kind}, x int, y int, z int, label int, comp int"
    )


def volumes(comps: DataFrame) -> DataFrame:
    """(image_id, label, comp, roi, volume)."""
    sizes = comps.groupBy("image_id", "label", "comp").agg(F.count("*").alias("volume"))
    return sizes.withColumn("roi", F.format_string("label_%d_lesion_%d", "label", "comp"))


def select_regions(sizes: DataFrame, min_volume: int = 10, most: int | None = 10, per: str = "per_Img") -> DataFrame:
    """Regions of at least min_volume voxels, the `most` largest of each image or of each label; ties by label and number."""
    kept = sizes.where(F.col("volume") >= min_volume)
    if most is None:
        return kept
    keys = ["image_id"] if per.lower() == "per_img" else ["image_id", "label"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("volume"), "label", "comp"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def region_voxels(vox: DataFrame, comps: DataFrame, chosen: DataFrame) -> DataFrame:
    """(image_id, roi, x, y, z, intensity, raw) of the chosen regions."""
    inside = comps.join(chosen.select("image_id", "label", "comp", "roi"), ["image_id", "label", "comp"])
    values = vox.select("image_id", "x", "y", "z", F.col("intensity").cast("double").alias("intensity"))
    joined = inside.join(values, ["image_id", "x", "y", "z"])
    return joined.select("image_id", "roi", "x", "y", "z", "intensity", F.col("intensity").alias("raw"))
