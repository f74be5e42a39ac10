"""All registered queries of the engine, each over its whole tables; `voxlake.oracles` has the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType

from voxlake.operators import aggregate, firstorder, pairing, prep, rois, shape, texture
from voxlake.oracles import ORACLES
from voxlake.plans.storage import stored, tuned
from voxlake.sources.tables import embedding_images, regions, voxels

__all__ = ["ORACLES", "QUERIES"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SPACING = (3.0, 3.0, 3.0)


def query(name: str, plan: Callable[[SparkSession, str], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(plan(tuned(spark), sf_dir))

    QUERIES[name] = run


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, since sums in another order differ in the last bits; no negative zero."""
    real = (DoubleType, FloatType)
    return df.select(*[(F.round(F.col(f.name).cast("double"), 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, real) else F.col(f.name) for f in df.schema.fields])


def settled(df: DataFrame) -> DataFrame:
    """Doubles to twelve decimals: a sum that ends a last bit beside a tie of the sixth decimal becomes the tie, which rounds up."""
    return df.select(*[F.round(f.name, 12).alias(f.name) if isinstance(f.dataType, DoubleType) else f.name for f in df.schema.fields])


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(voxels(spark, sf_dir))


def quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.fixed_bin_size(vox(spark, sf_dir), 8, 1)


def family(features: Callable, names: Sequence[str], mode: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: settled(features(quantised(s, d), modes=[mode]).select("image_id", "roi", *names))


query("scan_voxelize", voxels)
query("mask_labels_distinct", lambda s, d: rois.labels(voxels(s, d)))
query("roi_volume_count", lambda s, d: rois.label_volumes(voxels(s, d)))
query("roi_components_26", lambda s, d: rois.volumes(rois.components(voxels(s, d))).groupBy("image_id", "label").agg(
    F.count("*").alias("n_components"), F.max("volume").alias("largest"), F.sum(F.col("volume") * F.col("volume")).alias("sum_squares")))
query("roi_min_volume_filter", lambda s, d: rois.select_regions(rois.volumes(rois.components(voxels(s, d))), 10, None).groupBy("image_id", "label").agg(
    F.count("*").alias("n"), F.sum("volume").alias("volume")))
query("roi_topn_per_image", lambda s, d: rois.select_regions(rois.volumes(rois.components(voxels(s, d))), 1, 5).select("image_id", "label", "volume"))
query("roi_topn_per_region", lambda s, d: rois.select_regions(rois.volumes(rois.components(voxels(s, d))), 1, 5, "per_region").select("image_id", "label", "volume"))

query("disc_fbs", lambda s, d: prep.fixed_bin_size(vox(s, d), 8))
query("disc_fbs_pet_anchor", lambda s, d: prep.fixed_bin_size(vox(s, d), 8, 0))
query("disc_fbn", lambda s, d: prep.fixed_bin_number(vox(s, d), 8))
query("disc_fbn_reals", lambda s, d: prep.fixed_bin_number(embedding_images(s, d).withColumn("roi", F.lit("all")), 32).select("image_id", "x", "y", "level"))
query("disc_lloyd", lambda s, d: prep.lloyd(vox(s, d), 8))
query("reseg_range", lambda s, d: prep.in_range(vox(s, d), 5, 40))
query("outlier_3sigma", lambda s, d: prep.without_outliers(vox(s, d), 1.5))
query("round_gl", lambda s, d: prep.rounded(vox(s, d).withColumn("intensity", F.col("intensity") / 4)))


def sizes(v: DataFrame) -> DataFrame:
    return v.groupBy("image_id").agg(*[(F.max(a) + 1).cast("int").alias(f"n{a}") for a in "xyz"])


def resampled(s: SparkSession, d: str, method: Callable) -> DataFrame:
    v = voxels(s, d)
    return method(v, prep.target_grid(sizes(v), (2.0, 2.0, 2.0), (1.0, 1.0, 3.0)))


query("resample_nearest", lambda s, d: resampled(s, d, prep.resample_nearest))
query("resample_linear", lambda s, d: resampled(s, d, prep.resample_linear))
query("resample_cubic", lambda s, d: prep.resample_cubic(voxels(s, d), sizes(voxels(s, d)), (2.0, 2.0, 2.0), (1.0, 1.0, 3.0)))


def mask_grid(s: SparkSession, d: str) -> DataFrame:
    v = voxels(s, d)
    mask = v.select("image_id", "x", "y", "z", (F.col("label") == 1).cast("double").alias("intensity"))
    return prep.partial_volume(prep.resample_linear(mask, prep.target_grid(sizes(v), (2.0, 2.0, 2.0), (1.0, 1.0, 3.0))), 0.5).select("image_id", "x", "y", "z")


query("pv_threshold", mask_grid)
query("stat_features", lambda s, d: firstorder.statistics(vox(s, d)))
query("ih_features", lambda s, d: firstorder.histogram_features(quantised(s, d)).drop("ih_max_grad", "ih_max_grad_g", "ih_min_grad", "ih_min_grad_g"))
query("ih_gradients", lambda s, d: firstorder.histogram_features(quantised(s, d)).select("image_id", "roi", "ih_max_grad", "ih_max_grad_g", "ih_min_grad", "ih_min_grad_g"))
query("ivh_features", lambda s, d: firstorder.volume_histogram(vox(s, d)))
query("peak_features", lambda s, d: firstorder.intensity_peak(vox(s, d), voxels(s, d), SPACING))
query("moment_invariants", lambda s, d: firstorder.moment_invariants(vox(s, d)))


def diag(s: SparkSession, d: str) -> DataFrame:
    v = vox(s, d)
    out = prep.in_range(v.withColumn("raw", F.col("intensity")), 5, 40)
    image = voxels(s, d)
    return firstorder.diagnostics(v, image, out, image, (1.0, 1.0, 3.0), (1.0, 1.0, 3.0))


query("diag_features", diag)
query("glcm_matrix_3d", lambda s, d: texture.cooccurrence(quantised(s, d), ["3D_comb"]).select("image_id", "roi", "i", "j", "n"))
query("glrlm_matrix_3d", lambda s, d: texture.run_matrix(quantised(s, d), ["3D_comb"]).select("image_id", "roi", "i", F.col("k").alias("l"), "n"))
for _mode in texture.MODES6:
    _key = _mode.lower().replace("2_5d", "25d")
    query(f"glcm_{_key}", family(texture.cooccurrence_features, texture.GLCM, _mode))
    query(f"glrlm_{_key}", family(texture.run_features, texture.NAMES["glrlm"], _mode))
for _mode in texture.MODES3:
    _key = _mode.lower().replace("2_5d", "25d")
    query(f"glszm_{_key}", family(texture.zone_features, texture.NAMES["szm"], _mode))
    query(f"gldzm_{_key}", family(lambda q, modes: texture.zone_features(q, "distance", modes), texture.NAMES["dzm"], _mode))
    query(f"ngldm_{_key}", family(texture.dependence_features, texture.NAMES["ngl"], _mode))
    query(f"ngtdm_{_key}", family(texture.tone_features, texture.NGTDM, _mode))

_PCA = ("volume_count", "com_shift", "major_axis_length", "minor_axis_length", "least_axis_length", "elongation", "flatness")
query("morph_count_pca_com", lambda s, d: shape.principal_axes(vox(s, d), (1.0, 1.0, 3.0)).select("image_id", "roi", *[f"morph_{m}" for m in _PCA]))
query("morph_mesh", lambda s, d: shape.mesh(vox(s, d), (1.0, 1.0, 3.0)))
query("morph_shape", lambda s, d: shape.shape_features(vox(s, d), (1.0, 1.0, 3.0)))
query("morph_autocorr", lambda s, d: shape.autocorrelation(vox(s, d), (1.0, 1.0, 3.0)))
query("morph_hull", lambda s, d: shape.hull_features(vox(s, d), (1.0, 1.0, 3.0)))


def files(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parts = s.read.parquet(f"{d}/part.parquet")
    ending = F.element_at(F.array(*[F.lit(x) for x in (".nii.gz", ".nrrd", ".dcm")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    images = parts.select(F.concat(F.lit("/img/case_"), F.col("p_partkey"), ending).alias("path"))
    return images, parts.where("p_size <= 25").select(F.concat(F.lit("/seg/case_"), F.col("p_partkey"), F.lit(".nii.gz")).alias("path"))


query("pair_join_inner", lambda s, d: pairing.by_key(*files(s, d)))
query("pair_unmatched_anti", lambda s, d: pairing.unmatched(*files(s, d)))
query("pair_broadcast_one_to_many", lambda s, d: pairing.one_to_many(files(s, d)[0].agg(F.min("path").alias("path")), files(s, d)[1]))
query("pair_positional_zip", lambda s, d: pairing.positional(*files(s, d)))
query("format_by_extension", lambda s, d: files(s, d)[0].select("path", pairing.format_of(F.col("path")).alias("format"), pairing.patient_id(pairing.stem(F.col("path"))).alias("id")))


def nearest_events(s: SparkSession, d: str) -> DataFrame:
    events = s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("pos"))
    kinds = [*sorted(r[0] for r in events.select("event_type").where("event_type IS NOT NULL").distinct().collect()), None, None]
    left = events.where(F.col("event_type") == kinds[0]).select("user_id", "event_id", "pos")
    right = events.where(F.col("event_type") == kinds[1]).groupBy("user_id", "pos").agg(F.min("event_id").alias("event_id"))
    return pairing.nearest(left, right, "pos", 86400.0, ["user_id"]).select("event_id", "near_event_id", "gap")


query("nearest_slice_join", nearest_events)


def lesion_rows(s: SparkSession, d: str) -> DataFrame:
    v = voxels(s, d)
    comps = stored(rois.components(v), "components")
    chosen = rois.select_regions(rois.volumes(comps), 5, None)
    inside = rois.region_voxels(v, comps, chosen)
    # Regions are named by size and sum, not by component number, so that the order of the first value is the same anywhere.
    return inside.groupBy("image_id", "roi").agg(
        F.count("*").alias("volume"), F.avg("intensity").alias("stat_mean"), F.max("intensity").alias("stat_max"), F.count("*").cast("double").alias("morph_volume_count"),
        F.min("intensity").alias("int_mask_min_int_init_roi"), F.min(F.struct("z", "y", "x")).alias("first_voxel"),
    )


_LESION = ("stat_mean", "stat_max", "morph_volume_count", "int_mask_min_int_init_roi")
query("agg_lesion_per_img", lambda s, d: aggregate.lesions(lesion_rows(s, d), _LESION, order="first_voxel"))
query("agg_lesion_per_region", lambda s, d: aggregate.lesions(lesion_rows(s, d), _LESION, "per_region", order="first_voxel"))


def deep_mean(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet")
    width = e.agg(F.max(F.size("embedding"))).first()[0]
    names = [f"deep_feature_{k}" for k in range(64 if width is None else width)]
    rows = e.select(F.col("label").alias("image_id"), F.lit("r").alias("roi"), F.lit(1).alias("volume"), *[F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)])
    return aggregate.lesions(rows, names, deep=names)


query("agg_lesion_deep_mean", deep_mean)
query("agg_lesion_deep_mean_whole", deep_mean)
query("feature_union_by_name", lambda s, d: aggregate.union_all([
    vox(s, d).groupBy("image_id", "roi").agg(F.avg("intensity").alias("stat_mean")),
    vox(s, d).where("roi = 'label_1'").groupBy("image_id", "roi").agg(F.max("intensity").alias("stat_max")),
]))
query("feature_pivot_wide", lambda s, d: aggregate.wide(aggregate.tall(firstorder.statistics(vox(s, d)), ["stat_mean", "stat_max"]), ["stat_mean", "stat_max"]))


def best_slice(s: SparkSession, d: str) -> DataFrame:
    """The slice with the most mask voxels (ties: the lowest), intensities to 0..1 over the region."""
    v = vox(s, d)
    areas = v.groupBy("image_id", "roi", "z").agg(F.count("*").alias("area"))
    best = areas.groupBy("image_id", "roi").agg(F.min(F.struct((-F.col("area")).alias("m"), "z")).getField("z").alias("z"))
    span = v.groupBy("image_id", "roi").agg(F.min("intensity").alias("lo"), F.max("intensity").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("intensity") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))).otherwise(0.0)
    return v.join(best, ["image_id", "roi", "z"]).join(span, ["image_id", "roi"]).select("image_id", "roi", "x", "y", "z", scaled.alias("value"))


query("deep_prep_best_slice", best_slice)


def log_lines(s: SparkSession, d: str) -> DataFrame:
    c = s.read.parquet(f"{d}/conversations.parquet")
    level = F.element_at(F.array(*[F.lit(x) for x in ("INFO", "WARNING", "ERROR")]), (F.col("turn") % 3 + 1).cast("int"))
    return aggregate.report(c.select(F.concat(F.lit("2024-01-01 00:00:00 - "), level, F.lit(" - [case_"), F.col("conv_id"), F.lit("] failed on ROI 'label_1_lesion_"), F.col("turn"), F.lit("' again")).alias("line")))


query("report_parse", log_lines)


def selected(s: SparkSession, d: str) -> DataFrame:
    from voxlake.plans.registry import select_columns

    columns = select_columns("stat,ih", "1st")
    rows = firstorder.statistics(vox(s, d)).join(firstorder.histogram_features(quantised(s, d)), ["image_id", "roi"])
    return rows.select("image_id", "roi", *[c for c in columns if c in ("stat_mean", "stat_median", "ih_mean", "ih_entropy")])


query("select_category_dimension", selected)


def flagship(s: SparkSession, d: str) -> DataFrame:
    from voxlake.plans.engine import extract

    v = stored(voxels(s, d), "voxels")
    return settled(extract(regions(v).withColumn("raw", F.col("intensity")), v.select("image_id", "x", "y", "z", F.col("intensity").cast("double").alias("intensity")), (3.0, 3.0, 3.0)))


query("flagship_full_profile", flagship)
