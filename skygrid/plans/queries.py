"""The registered queries of the annotation engine, over the bindings of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrid.functions import names as N
from skygrid.operators import catalog, distributions, grid, ids, metrics, sampling, splits
from skygrid.plans import bindings as B
from skygrid.plans.oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "entry"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
GROUPS = [["src2", "src1"], ["src3", "src4", "src5"]]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiled annotations per image and species."""
    return B.pieces(spark, sf_dir).groupBy("om", "species").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


def key0(id_: Column) -> Column:
    return N.portable_key(id_, F.lit(0).cast("long"))


def assigned(spark: SparkSession, iterations: int) -> DataFrame:
    return splits.random_splits(B.tiles(spark), spark.range(iterations).withColumnRenamed("id", "iteration"), N.portable_key)


def counts(spark: SparkSession, sf_dir: str, iterations: int) -> DataFrame:
    per = B.pieces(spark, sf_dir, long_tail=True).groupBy("image_id", "species").agg(F.count("*").alias("n"))
    return splits.split_counts(assigned(spark, iterations), per)


def first_split(spark: SparkSession) -> DataFrame:
    return assigned(spark, 1).drop("iteration")


@query
def q_tile_grid(spark, sf):
    own = [grid.tile_grid(B.images(spark), s).withColumn("tile_size", F.lit(s).cast("long")) for s in (500, 512)]
    return own[0].unionByName(own[1])


@query
def q_tile_join(spark, sf):
    return grid.tile_join(B.detections(spark, sf), B.images(spark), 500)


@query
def q_tile_join_512(spark, sf):
    return grid.tile_join(B.detections(spark, sf), B.images(spark), 512).drop("annotation_id", "category_id")


@query
def q_tiling_stats(spark, sf):
    return grid.tiling_stats(B.images(spark), grid.tile_join(B.detections(spark, sf), B.images(spark), 512), 512)


@query
def q_category_ids(spark, sf):
    det = B.detections(spark, sf)
    local = ids.category_ids(det, by="om")
    return local.unionByName(ids.category_ids(det).withColumn("om", F.lit(0).cast("long")))


@query
def q_merge_ids(spark, sf):
    p = B.pieces(spark, sf).withColumn("category_id", F.when(F.col("det_idx") % 50 == 0, 999).otherwise(F.col("category_id")).cast("long"))
    tiles = B.tiles(spark).where("om % 7 != 0").select(F.col("om").alias("file"), F.col("tile_id").alias("image_id"))
    cats = ids.category_ids(B.detections(spark, sf), by="om").select(F.col("om").alias("file"), "category_id", F.col("species").alias("name"))
    return ids.merge_bundles(tiles, p.select(F.col("om").alias("file"), F.col("annotation_id").alias("pos"), F.col("tile_id").alias("image_id"), "category_id"), cats)


@query
def q_prepare(spark, sf):
    src = B.source_images(spark, sf).where(N.is_source_image(F.col("file_name")))
    own = src.join(B.annotation_entries(spark, sf), "file_name", "left").withColumn("detections", F.coalesce("detections", F.lit(0).cast("long")))
    from pyspark.sql import Window

    name = F.col("file_name")
    order = Window.orderBy(N.source_row(name), N.source_col(name), name)  # a row per source image
    own = own.withColumn("idx", F.row_number().over(order))
    new = N.image_name(F.col("idx"), name)
    return own.select(F.col("idx").cast("long").alias("idx"), "file_name", new.alias("new_name"), N.image_id_of(new).alias("om_id"), F.lit(10000).alias("width"), F.lit(10000).alias("height"), "detections")


@query
def q_missing_images(spark, sf):
    src = B.source_images(spark, sf).where(N.is_source_image(F.col("file_name")))
    return src.join(B.annotation_entries(spark, sf), "file_name", "left_anti").select("file_name")


@query
def q_crosstab(spark, sf):
    out = distributions.crosstab(B.detections(spark, sf), BRANDS)
    return out.select("om", "total", *[F.col(f"`{b}`").alias(b.replace("#", "_").lower()) for b in BRANDS])


def _freq(spark, sf, threshold=2400):
    det = B.detections(spark, sf).withColumn("pos", F.col("om") * 1_000_000_000 + F.col("det_idx"))
    labels = det.select("species").distinct().where(F.col("species").startswith("Brand#1")).withColumn("label", F.concat(F.lit("First "), F.substring("species", 7, 2)))
    return distributions.species_frequency(det, labels, threshold=threshold)


@query
def q_species_freq(spark, sf):
    return _freq(spark, sf)


@query
def q_count_extremes(spark, sf):
    return distributions.count_extremes(_freq(spark, sf))


@query
def q_om_summary(spark, sf):
    return distributions.image_summary(B.images(spark), B.detections(spark, sf))


@query
def q_dataset_summary(spark, sf):
    return distributions.dataset_summary(B.tiles(spark), B.pieces(spark, sf))


@query
def q_tile_species_counts(spark, sf):
    return B.pieces(spark, sf).groupBy("image_id", "category_id").agg(F.count("*").alias("n"))


@query
def q_distribution(spark, sf):
    n = B.pieces(spark, sf, True).groupBy("species").agg(F.count("*").alias("n"))
    return distributions.proportions(n).withColumn("p", F.round("p", 9))


@query
def q_median_variants(spark, sf):
    return distributions.medians(B.pieces(spark, sf, True).groupBy("species").agg(F.count("*").alias("n")))


def _tile_counts(spark, sf):
    return distributions.tile_counts(B.tiles(spark).select("image_id").join(first_split(spark), "image_id"), B.pieces(spark, sf))


@query
def q_density(spark, sf):
    return distributions.density(_tile_counts(spark, sf))


@query
def q_density_hist(spark, sf):
    return distributions.density_histogram(_tile_counts(spark, sf))


@query
def q_random_split(spark, sf):
    return assigned(spark, 2)


@query
def q_split_score(spark, sf):
    return splits.score_splits(counts(spark, sf, 4))


@query
def q_split_search(spark, sf):
    return splits.best_split(splits.score_splits(counts(spark, sf, 16)))


@query
def q_running_best(spark, sf):
    return splits.running_best(splits.score_splits(counts(spark, sf, 16)))


@query
def q_split_sizes(spark, sf):
    return splits.split_sizes(first_split(spark), distributions.tile_counts(B.tiles(spark).select("image_id"), B.pieces(spark, sf)))


@query
def q_split_species(spark, sf):
    return splits.species_shares(counts(spark, sf, 1).drop("iteration"))


@query
def q_imbalance_top10(spark, sf):
    return splits.imbalance_top(splits.species_shares(counts(spark, sf, 1).drop("iteration")))


@query
def q_missing_species(spark, sf):
    c = counts(spark, sf, 16)
    return splits.missing_species(c.withColumn("species", F.concat_ws(":", "iteration", "species")))


@query
def q_split_annotations(spark, sf):
    _, own = splits.split_bundles(first_split(spark), B.tiles(spark).select("om", "image_id", "file_name"), B.pieces(spark, sf).select("om", "image_id", "annotation_id", "category_id", "area"))
    return own.select("split", "om", "annotation_id", "new_image_id", "new_annotation_id", "category_id", "area")


@query
def q_tile_lists(spark, sf):
    own, _ = splits.split_bundles(first_split(spark), B.tiles(spark).select("om", "image_id", "file_name"), B.pieces(spark, sf).select("om", "image_id", "annotation_id"))
    return own.select("split", F.col("new_image_id").alias("pos"), "file_name")


@query
def q_split_invariants(spark, sf):
    return splits.split_invariants(first_split(spark), B.tiles(spark))


@query
def q_stratified_split(spark, sf):
    own = splits.stratified_split(B.labelled(spark, sf), "label", key0(F.col("row_id")))
    return own.groupBy("label", "split").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))


def _crop_inputs(spark, sf):
    p = B.pieces(spark, sf)
    cats = ids.category_ids(B.detections(spark, sf)).select(F.col("species").alias("name"), "category_id")
    p = p.drop("category_id").join(cats.withColumnRenamed("name", "species"), "species", "left")
    return p, B.tiles(spark).where("tile_id % 97 != 0"), cats


@query
def q_crop_catalog(spark, sf):
    return catalog.crop_catalog(*_crop_inputs(spark, sf))


@query
def q_crop_skipped(spark, sf):
    p, t, _ = _crop_inputs(spark, sf)
    return catalog.skipped(p, t).groupBy("om").agg(F.count("*").alias("skipped"))


@query
def q_crop_filter(spark, sf):
    p, _, cats = _crop_inputs(spark, sf)
    return catalog.species_filter(p, cats, ["Brand#11", "Brand#23"]).select("om", "annotation_id", "species")


@query
def q_crop_window(spark, sf):
    own = catalog.crop_windows(B.pieces(spark, sf).select("om", "annotation_id", "x", "y", "w", "h"), 500).withColumn("black", F.col("x1").isNull())
    return own.select("om", "annotation_id", "black", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query
def q_label_remap(spark, sf):
    det = B.detections(spark, sf)
    mapping = det.select(F.col("species").alias("raw")).distinct().where(F.col("raw") != "Brand#25").withColumn("label", F.concat(F.lit("CLASS_"), F.substring("raw", 7, 1)))
    return sampling.label_remap(det, mapping).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("species").alias("species"))


@query
def q_label_index(spark, sf):
    rows = B.labelled(spark, sf)
    return rows.join(sampling.label_index(rows.where("row_id % 10 < 8")), "label").groupBy("label", "class_id").agg(F.count("*").alias("n"))


@query
def q_cap_per_class(spark, sf):
    return sampling.cap_per_class(B.labelled(spark, sf), 20, key0)


@query
def q_merge_groups(spark, sf):
    return sampling.merge_groups(B.labelled(spark, sf), GROUPS, 30, key0)


@query
def q_loader_pipeline(spark, sf):
    out = [sampling.loader_pipeline(B.labelled(spark, sf), GROUPS, 40, key0, s).withColumn("split", F.lit(s)) for s in ("train", "val")]
    return out[0].unionByName(out[1])


@query
def q_class_weights(spark, sf):
    return sampling.class_weights(sampling.class_counts(B.labelled(spark, sf)))


@query
def q_sampler_weights(spark, sf):
    return sampling.sampler_weights(B.labelled(spark, sf), 0.5)


@query
def q_weighted_sample(spark, sf):
    return sampling.weighted_sample(sampling.sampler_weights(B.labelled(spark, sf), 0.5), 500)


@query
def q_split_composition(spark, sf):
    rows = splits.stratified_split(B.labelled(spark, sf), "label", key0(F.col("row_id")))
    return sampling.split_composition(rows.where("row_id % 3 != 0 or split = 'train'"), rows.select("label").distinct())


@query
def q_path_normalize(spark, sf):
    s = B.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("crops\\X\\"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("/abs/"), k.cast("string"))).otherwise(F.concat(F.lit("CROPS/crops/"), k.cast("string")))
    return s.select(k, N.crop_path(raw, "/d").alias("path"))


@query
def q_confusion(spark, sf):
    return metrics.confusion(B.predictions(spark, sf), 10)


@query
def q_class_report(spark, sf):
    return metrics.class_report(metrics.confusion(B.predictions(spark, sf), 10))


@query
def q_average_precision(spark, sf):
    return metrics.average_precision(B.predictions(spark, sf), 10)


@query
def q_misclassified(spark, sf):
    return metrics.misclassified(B.predictions(spark, sf))


def _history(spark, sf):
    e = B.table(spark, sf, "events")
    return metrics.epoch_metrics(e.select((F.col("user_id") % 30 + 1).alias("epoch"), (F.col("event_id") % 64 * 0.25).alias("loss"), (F.col("event_id") % 33).alias("correct"), F.lit(32).alias("n")))


@query
def q_epoch_metrics(spark, sf):
    return _history(spark, sf)


@query
def q_best_epoch(spark, sf):
    return metrics.best_epoch(_history(spark, sf), "accuracy")


@query
def q_lr_schedule(spark, sf):
    e = spark.range(1, 31).withColumnRenamed("id", "epoch")
    return e.select("epoch", F.round(N.lr_at(F.col("epoch"), 30, 10, 1e-4), 12).alias("lr"))
