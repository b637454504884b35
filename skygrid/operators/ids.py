"""Deterministic ids: categories by name, files by offset, rows by two-level numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def category_ids(rows: DataFrame, by: str | None = None, name: str = "species") -> DataFrame:
    """Ids from 1 by name over distinct names, of each ``by`` or of all; a dimension, so one window is enough."""
    keys = [by] if by else []
    w = Window.partitionBy(*keys).orderBy(name)
    return rows.select(*keys, name).where(F.col(name).isNotNull()).distinct().withColumn("category_id", F.row_number().over(w).cast("long"))


def two_level_ids(rows: DataFrame, block: str, order: list[str | Column], out: str, group: list[str] | None = None, total: str | None = None) -> DataFrame:
    """Number rows from 1 by (block, order), in each ``group``, without a global window: place in the block plus the sizes of blocks before.

    ``total`` names a column for the size of the group.  Sizes are taken after the shuffle that numbers the blocks, so ``rows`` is worked
    out once; only a row per block is gathered for a group.
    """
    group = group or []
    within = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*group, block).orderBy(*order)))
    sizes = within.groupBy(*group, block).agg(F.max("__at").alias("__n"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__n").over(whole.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumns({"__before": before, "__all": F.sum("__n").over(whole)}).drop("__n")
    own = within.join(offsets, [*group, block]).withColumn(out, (F.col("__at") + F.col("__before")).cast("long"))
    own = own.withColumn(total, F.col("__all")) if total else own
    return own.drop("__at", "__before", "__all")


def merge_bundles(images: DataFrame, annotations: DataFrame, categories: DataFrame, default: str = "UNKNOWN") -> DataFrame:
    """Annotations of many files under global ids.

    ``images`` (file, image_id), ``annotations`` (file, pos, image_id, category_id), ``categories`` (file, category_id, name).
    An image id is offset by the sum of the largest ids of the files before; files without images add nothing.
    Categories are numbered by name; an unknown one is ``default`` and has id 0 unless a category has that name.
    Annotations whose image is missing are left out; see ``orphans``.
    """
    tops = images.groupBy("file").agg(F.max("image_id").alias("top"))
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    offsets = tops.select("file", F.coalesce(F.sum("top").over(w), F.lit(0)).alias("offset"))
    names = category_ids(categories.select("name"), name="name").withColumnRenamed("category_id", "global_category_id")
    own = annotations.join(images.select("file", "image_id").distinct(), ["file", "image_id"], "left_semi").join(offsets, "file")
    own = own.join(categories, ["file", "category_id"], "left").withColumn("name", F.coalesce("name", F.lit(default))).join(names, "name", "left")
    own = own.withColumn("global_image_id", F.col("image_id") + F.col("offset")).withColumn("global_category_id", F.coalesce("global_category_id", F.lit(0).cast("long")))
    own = two_level_ids(own, "file", ["pos"], "global_annotation_id")
    return own.select("file", "pos", "global_image_id", "global_annotation_id", "global_category_id", "name")


def orphans(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations without an image in their file: none in a sound input."""
    return annotations.join(images, ["file", "image_id"], "left_anti")
