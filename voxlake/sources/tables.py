"""Voxel relations made from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxlake.operators.batches import tasks


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, z, intensity, label): one sparse 16 x 16 x 7 volume for each supplier.

    Hardly any two lines share a place, so they are dealt out as they are, to tasks that grow in number with the table."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    place = [
        F.col("l_suppkey").cast("int").alias("image_id"), (F.col("l_partkey") % 16).cast("int").alias("x"),
        (F.col("l_orderkey") % 16).cast("int").alias("y"), (F.col("l_linenumber") - 1).cast("int").alias("z"),
    ]
    lines = items.select(*place, "l_quantity", F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("label"))
    keys = ["image_id", "x", "y", "z"]
    return lines.repartition(tasks(items), *keys).groupBy(*keys).agg(F.max("l_quantity").cast("int").alias("intensity"), F.max("label").cast("int").alias("label"))


def regions(vox: DataFrame) -> DataFrame:
    """(image_id, roi, x, y, z, intensity): every label of an image as one region."""
    return vox.select("image_id", F.concat(F.lit("label_"), F.col("label")).alias("roi"), "x", "y", "z", F.col("intensity").cast("double").alias("intensity"))


def embedding_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, z, intensity): the 64 values of a vector as an 8 x 8 slice."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cells = vectors.select(F.col("vec_id").cast("int").alias("image_id"), F.posexplode("embedding").alias("pos", "v"))
    return cells.select("image_id", (F.col("pos") % 8).alias("x"), F.expr("cast(pos div 8 AS int)").alias("y"), F.lit(0).alias("z"), F.col("v").cast("double").alias("intensity"))
