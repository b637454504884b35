"""Crop catalogues: annotations with their tiles and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrid.functions.names import crop_window, py_list


def species_filter(pieces: DataFrame, categories: DataFrame, names: list[str]) -> DataFrame:
    """Pieces of the categories (category_id, name) that have one of the names."""
    wanted = categories.where(F.col("name").isin(names)).select("category_id")
    return pieces.join(wanted, "category_id", "left_semi")


def crop_catalog(pieces: DataFrame, tiles: DataFrame, categories: DataFrame, default: str = "UNKNOWN") -> DataFrame:
    """A row per crop: path, species, tile, image, box as text, annotation id.  Pieces without a tile are skipped; see ``skipped``."""
    own = pieces.join(tiles.select("image_id", "file_name", "om_id"), "image_id").join(categories, "category_id", "left")
    own = own.withColumn("species_name", F.coalesce("name", F.lit(default)))
    return own.select(
        F.format_string("crops/%s/%s_%06d.png", "species_name", "species_name", "annotation_id").alias("crop_path"),
        "species_name",
        F.col("file_name").alias("source_tile"),
        F.col("om_id").alias("orthomosaic_id"),
        py_list(F.array("x", "y", "w", "h")).alias("bbox_coco"),
        "annotation_id",
    )


def skipped(pieces: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pieces whose tile is missing."""
    return pieces.join(tiles, "image_id", "left_anti")


def catalog_summary(catalog: DataFrame, missing: DataFrame) -> DataFrame:
    """One row: crops, skipped ones, species, and a map of counts."""
    per = catalog.groupBy("species_name").agg(F.count("*").alias("n"))
    own = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_crops"), F.count("*").alias("num_species"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("species_name", "n")))).alias("species_counts"))
    return own.join(F.broadcast(missing.agg(F.count("*").alias("total_skipped"))))  # one row each


def crop_windows(pieces: DataFrame, size: int, pad: float = 0.25) -> DataFrame:
    """``pieces`` with x1, y1, x2, y2 of the crop window in a tile of ``size``, null where the crop is black."""
    side = F.lit(size)
    own = pieces.withColumn("__w", crop_window(F.col("x"), F.col("y"), F.col("w"), F.col("h"), side, side, pad))
    return own.select("*", "__w.*").drop("__w")
