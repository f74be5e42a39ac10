"""From files of images and masks to sheets of features: the entry point of a whole run, and its command line."""

from __future__ import annotations

import argparse
import time
from collections.abc import Mapping
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxlake.operators import aggregate, pairing, rois
from voxlake.plans import settings as config
from voxlake.plans.engine import extract
from voxlake.plans.prepare import prepared
from voxlake.plans.registry import select_columns
from voxlake.plans.storage import shared_dir, stored
from voxlake.sources import volumes


def paired(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(image, mask): files with equal stems; without any, one image with every mask, or one mask with every image, or the files in
    order when there are as many of each. Otherwise none."""
    found = pairing.by_key(images, masks).select("image", "mask")
    if not found.isEmpty():
        return found
    n, m = images.count(), masks.count()
    if n == 1:
        return pairing.one_to_many(images, masks)
    if m == 1:
        return pairing.one_to_many(masks, images).select(F.col("mask").alias("image"), F.col("image").alias("mask"))
    return pairing.positional(images, masks).select("image", "mask") if n == m else found.limit(0)


def features(spark: SparkSession, image_input: str, mask_input: str, s: config.Settings) -> tuple[DataFrame, DataFrame]:
    """(features, report): a row of features for each region; the report tells of files that were left out.

    Images are read once and staged in the shared folder; those of one spacing are prepared in one plan."""
    image_files, mask_files = volumes.files(spark, image_input), volumes.files(spark, mask_input)
    heads, mask_heads = stored(volumes.headers(image_files), "headers"), stored(volumes.headers(mask_files), "mask_headers")
    known = ("format IS NOT NULL AND error IS NULL")
    pairs = stored(paired(heads.where(known).select("path"), mask_heads.where(known).select("path")), "pairs")
    named = heads.join(pairs.select(F.col("image").alias("path"), "mask"), "path").select(F.concat_ws("|", "image_id", pairing.stem(F.col("mask"))).alias("pair"), "image_id", "path", "mask", "shape", "spacing")
    report = heads.unionByName(mask_heads).where("error IS NOT NULL").select("image_id", F.lit("").alias("roi"), F.lit("ERROR").alias("level"), F.concat("path", F.lit(": "), "error").alias("message"))
    report = report.unionByName(heads.where(known).join(pairs.select(F.col("image").alias("path")), "path", "left_anti").select("image_id", F.lit("").alias("roi"), F.lit("WARNING").alias("level"), F.concat(F.lit("no mask for "), "path").alias("message")))
    each = named.select("path", "pair")
    vox = stored(volumes.voxels(image_files).join(each, "path").select(F.col("pair").alias("image_id"), "x", "y", "z", "intensity"), "voxels")
    shapes = mask_heads.select(F.col("path").alias("mask"), F.col("shape").alias("own"))
    turned = named.select("pair", "mask", "shape").join(shapes, "mask").select("mask", "pair", ((F.col("own") != F.col("shape")) & (F.reverse("own") == F.col("shape"))).alias("turned"))
    labels = volumes.voxels(mask_files, zero=False).withColumnRenamed("path", "mask").join(turned, "mask")
    x, z = F.when(F.col("turned"), F.col("z")).otherwise(F.col("x")), F.when(F.col("turned"), F.col("x")).otherwise(F.col("z"))
    mask = stored(labels.select(F.col("pair").alias("image_id"), x.alias("x"), "y", z.alias("z"), F.rint("intensity").cast("int").alias("label")).where("label <> 0"), "mask")
    comps = stored(rois.components(mask), "components")
    chosen = rois.select_regions(rois.volumes(comps), s.min_roi_volume, s.roi_num, s.roi_selection_mode)
    inside = stored(comps.join(chosen, ["image_id", "label", "comp"]).select("image_id", "roi", "x", "y", "z", "volume"), "regions")
    grids = named.select(F.col("pair").alias("image_id"), *[F.col("shape")[k].alias(f"n{a}") for k, a in enumerate("xyz")], F.transform("spacing", lambda v: F.round(v, 6)).alias("spacing"))
    parts = []
    for (spacing,) in sorted(grids.select("spacing").distinct().collect()):  # a handful of scanners' settings, not of images
        own = grids.where(F.col("spacing") == F.array(*[F.lit(v) for v in spacing]))
        pick = lambda df, own=own: df.join(own.select("image_id"), "image_id", "left_semi")
        rows, image, new = prepared(pick(vox), pick(inside), own, spacing, s)
        raw = pick(inside).select("image_id", "roi", "x", "y", "z").join(pick(vox), ["image_id", "x", "y", "z"])
        parts.append(stored(extract(
            stored(rows, "prepared"), stored(image, "image"), new, width=float(s.BinSize) if s.DiscType.upper() == "FBS" else None, bins=int(s.BinSize) if s.DiscType.upper() == "FBN" or s.qntz == "Lloyd" else None,
            anchor=s.anchor() if s.DiscType.upper() == "FBS" else None, categories=s.categories, dimensions=s.dimensions, raw_vox=raw, raw_image=pick(vox), raw_spacing=spacing, lloyd=s.qntz == "Lloyd",
        ), "features"))
    names = select_columns(s.categories, s.dimensions)
    if not parts:
        empty = ", ".join(["PatientID string", "ROI string", *[f"{n} double" for n in names]])
        return spark.createDataFrame([], empty), report
    out = aggregate.union_all(parts)
    if s.aggregation_lesion:
        sizes = inside.select("image_id", "roi", "volume").distinct()
        out = aggregate.lesions(out.join(sizes, ["image_id", "roi"]), names, s.roi_selection_mode)
        out = out if "roi" in out.columns else out.withColumn("roi", F.lit("all"))
    if s.feature_value_mode.upper() == "APPROXIMATE_VALUE":
        out = out.select("image_id", "roi", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    return out.select(F.split("image_id", r"\|")[0].alias("PatientID"), F.col("roi").alias("ROI"), *names), report


def process_batch(spark: SparkSession, image_input: str, mask_input: str, output_path: str | None = None, parameters: Mapping | str | None = None, **overrides) -> dict:
    """Writes three sheets under output_path (Parquet, and CSV with a header): features, report and parameters; tells how it went."""
    began, out = time.time(), output_path or f"{shared_dir(spark)}/features"
    s = config.settings(parameters, **overrides)
    told = {"success": False, "output_path": out, "processed_files": 0, "features_extracted": 0, "error": None}
    try:
        found, report = features(spark, image_input, mask_input, s)
        found = stored(found, "sheet")
        for name, sheet in (("features", found), ("report", aggregate.at_level(report, s.report)), ("parameters", spark.createDataFrame(config.rows(s), "name string, value string"))):
            sheet.write.mode("overwrite").parquet(f"{out}/{name}")
            sheet.write.mode("overwrite").option("header", True).csv(f"{out}/{name}_csv")
        n = found.agg(F.countDistinct("PatientID"), F.count("*")).first()
        told |= {"success": n[1] > 0, "processed_files": n[0], "features_extracted": n[1] * (len(found.columns) - 2)}
    except Exception as e:  # noqa: BLE001  the caller gets the reason
        told["error"] = f"{type(e).__name__}: {e}"
    return told | {"processing_time": time.time() - began}


def main(args: list[str] | None = None) -> int:
    """voxlake.plans.batch --image-input DIR --mask-input DIR [--output DIR] [--parameters FILE] [--<parameter> VALUE ...]"""
    parser = argparse.ArgumentParser(prog="voxlake", description="Feature sheets of images and masks")
    parser.add_argument("--image-input", required=True)
    parser.add_argument("--mask-input", required=True)
    parser.add_argument("--output")
    parser.add_argument("--parameters", help="a JSON file of parameters")
    for f in fields(config.Settings):
        kind = {"int": int, "bool": lambda x: x.lower() in ("1", "true", "yes")}.get(f.type, str if f.type == "str" else float)
        parser.add_argument(f"--{f.name.replace('_', '-')}", dest=f.name, type=kind, default=None)
    given = vars(parser.parse_args(args))
    fixed = {k: given.pop(k) for k in ("image_input", "mask_input", "output", "parameters")}
    result = process_batch(SparkSession.builder.getOrCreate(), fixed["image_input"], fixed["mask_input"], fixed["output"], fixed["parameters"], **{k: v for k, v in given.items() if v is not None})
    print(result)
    return 0 if result["success"] else 1


if __name__ == "__main__":
    raise SystemExit(main())
