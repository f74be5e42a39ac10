"""Pairing of images with masks, and nearest matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EXTENSIONS = {
    "nii": "nifti", "nii.gz": "nifti", "dcm": "dicom", "dicom": "dicom", "nrrd": "nrrd", "nhdr": "nrrd", "npy": "npy",
    "png": "raster", "jpg": "raster", "jpeg": "raster",
}
EXTENSION = r"(?i)\.(nii\.gz|nii|dcm|dicom|nrrd|nhdr|npy|png|jpg|jpeg)$"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), EXTENSION, "")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]+$", 1)


def format_of(path: Column) -> Column:
    """Format by extension, else null."""
    found = F.lower(F.regexp_extract(path, EXTENSION, 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.nullif(found, F.lit("")))


def format_by_content(content: Column) -> Column:
    """Format by the first bytes of a file, else null."""
    head = F.hex(F.substring(content, 1, 352))
    at = lambda byte, n: F.substring(head, 2 * byte + 1, 2 * n)
    return (
        F.when(at(128, 4) == "4449434D", "dicom").when(at(344, 3).isin("6E2B31", "6E6931"), "nifti").when(at(0, 2) == "1F8B", "nifti")
        .when(at(0, 4) == "4E525244", "nrrd").when(at(0, 6) == "934E554D5059", "npy").when(at(0, 4).isin("89504E47"), "raster").when(at(0, 2) == "FFD8", "raster")
    )


def directory_formats(files: DataFrame) -> DataFrame:
    """(dir, format): the one format of a folder's files, or mixed."""
    each = files.select(F.regexp_replace("path", r"[/\\][^/\\]+$", "").alias("dir"), format_of(F.col("path")).alias("format")).where("format IS NOT NULL")
    found = each.groupBy("dir").agg(F.collect_set("format").alias("s"))
    return found.select("dir", F.when(F.size("s") == 1, F.col("s")[0]).otherwise("mixed").alias("format"))


def patient_id(name: Column) -> Column:
    """The first token of a name that looks like an identifier."""
    return F.regexp_extract(name, r"(\d+|[A-Za-z0-9_-]+)", 1)


def _last(files: DataFrame, key: str) -> DataFrame:
    """Of several files with one key the last path counts."""
    return files.groupBy(key).agg(F.max("path").alias("path"))


def by_key(images: DataFrame, masks: DataFrame, key=stem) -> DataFrame:
    """(key, image, mask): inner join on the file stem, or on another key of the path."""
    left = _last(images.select(key(F.col("path")).alias("key"), "path"), "key").withColumnRenamed("path", "image")
    right = _last(masks.select(key(F.col("path")).alias("key"), "path"), "key").withColumnRenamed("path", "mask")
    return left.join(right, "key").select("key", "image", "mask")


def unmatched(images: DataFrame, masks: DataFrame, key=stem) -> DataFrame:
    """Images without a mask, for the report."""
    return images.select(key(F.col("path")).alias("key"), F.col("path").alias("image")).join(masks.select(key(F.col("path")).alias("key")), "key", "left_anti")


def one_to_many(one: DataFrame, many: DataFrame) -> DataFrame:
    """(image, mask): a single file with every file of the other side; more than one row on the single side is an error."""
    single = one.agg(F.count("*").alias("n"), F.max("path").alias("image"))
    checked = single.select(F.when(F.col("n") == 1, F.col("image")).otherwise(F.raise_error(F.lit("exactly one file is needed here"))).alias("image"))
    return many.select(F.col("path").alias("mask")).join(F.broadcast(checked), F.lit(True)).select("image", "mask")


def numbered(files: DataFrame, name: str) -> DataFrame:
    """(position, name): paths numbered in order without one task that sorts all: ranges first, then places within ranges."""
    ranged = files.select(F.col("path").alias(name)).repartitionByRange(name).withColumn("part", F.spark_partition_id())
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    base = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(name))
    return ranged.withColumn("place", place).join(F.broadcast(base), "part").select((F.col("base") + F.col("place")).alias("position"), name)


def positional(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(position, image, mask): the n-th path of one side with the n-th of the other."""
    return numbered(images, "image").join(numbered(masks, "mask"), "position")


def nearest(left: DataFrame, right: DataFrame, position: str, tolerance: float, keys: list[str] | None = None) -> DataFrame:
    """For each left row the right row with the nearest position, if nearer than the tolerance; ties to the smaller position.

    Positions fall into bins as wide as the tolerance, so a row meets only its own bin and the two beside it. Right columns
    get the prefix near_."""
    keys = keys or []
    cell = F.floor(F.col(position) / tolerance)
    a = left.withColumn("row_", F.monotonically_increasing_id()).withColumn("bin_", F.explode(F.array(cell - 1, cell, cell + 1)))
    b = right.select(*keys, cell.alias("bin_"), *[F.col(c).alias(f"near_{c}") for c in right.columns if c not in keys])
    gap = F.abs(F.col(position) - F.col(f"near_{position}"))
    found = a.join(b, [*keys, "bin_"]).withColumn("gap", gap).where(F.col("gap") < tolerance)
    names = [c for c in left.columns]
    best = found.groupBy("row_").agg(*[F.first(c).alias(c) for c in names], F.min(F.struct("gap", f"near_{position}", *[f"near_{c}" for c in right.columns if c not in keys and c != position])).alias("m"))
    return best.select(*names, *[F.col(f"m.near_{c}").alias(f"near_{c}") for c in right.columns if c not in keys], F.col("m.gap").alias("gap"))


def largest_series(slices: DataFrame) -> DataFrame:
    """(dir, series_id, n): the series of a folder with the most slices; ties to the smaller identifier."""
    counts = slices.groupBy("dir", "series_id").agg(F.count("*").alias("n"))
    return counts.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("m"), "series_id")).alias("s")).select("dir", "s.series_id", (-F.col("s.m")).alias("n"))
