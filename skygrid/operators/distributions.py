"""Frequencies, summaries, medians and densities of annotations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def species_frequency(rows: DataFrame, labels: DataFrame | None = None, default: str = "UNKN", threshold: int = 50) -> DataFrame:
    """Counts by species of rows (species, pos), most frequent first, ties by first appearance; ``labels`` (species, label) is a dimension."""
    out = rows.groupBy(F.coalesce("species", F.lit(default)).alias("species")).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    if labels is not None:
        out = out.join(labels, "species", "left").withColumn("label", F.coalesce("label", "species"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "first_pos"))  # a row per species
    return out.withColumn("rank", rank.cast("long")).withColumn("included", F.col("n") >= threshold)


def image_summary(images: DataFrame, rows: DataFrame) -> DataFrame:
    """Per image of ``images`` (om): annotations, species, and the most frequent species, first seen on ties, N/A without any."""
    per = rows.groupBy("om", "species").agg(F.count("*").alias("n"), F.min("det_idx").alias("first"))
    per = per.groupBy("om").agg(
        F.sum("n").alias("total_annotations"), F.count("*").alias("num_species"), F.max_by("species", F.struct(F.col("n"), -F.col("first"))).alias("top_species")
    )
    return images.select("om").join(per, "om", "left").fillna(0, ["total_annotations", "num_species"]).fillna("N/A", ["top_species"])


def crosstab(rows: DataFrame, species: list[str]) -> DataFrame:
    """Image by species counts with a total, zeros filled; ``species`` are the columns."""
    out = rows.groupBy("om").pivot("species", species).count().na.fill(0)
    return out.withColumn("total", sum((F.col(f"`{s}`") for s in species), F.lit(0)).cast("long"))


def dataset_summary(tiles: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row over tiles (om, image_id) and pieces (image_id, species)."""
    full = pieces.select("image_id").distinct()
    t = tiles.join(full.withColumn("has", F.lit(True)), "image_id", "left")
    a = t.agg(F.count("*").alias("tiles"), F.count("has").alias("tiles_with"), F.countDistinct("om").alias("orthomosaics"))
    b = pieces.agg(F.count("*").alias("annotations"), F.countDistinct("species").alias("categories"))
    out = a.join(F.broadcast(b))  # one row each
    return out.select(
        "tiles",
        "tiles_with",
        (F.col("tiles") - F.col("tiles_with")).alias("tiles_without"),
        F.round(guarded_percent(F.col("tiles_with"), F.col("tiles")), 9).alias("pct_with"),
        "orthomosaics",
        F.when(F.col("orthomosaics") > 0, F.expr("tiles div orthomosaics")).otherwise(F.lit(0)).cast("long").alias("tiles_per_orthomosaic"),
        "annotations",
        "categories",
    )


def proportions(counts: DataFrame, n: str = "n", by: list[str] | None = None) -> DataFrame:
    """``counts`` with p, the share of n in its group; 0 where the group has none."""
    total = F.sum(n).over(Window.partitionBy(*(by or [])))
    return counts.withColumn("p", F.coalesce(F.col(n) / F.nullif(total, F.lit(0)), F.lit(0.0)))


def medians(counts: DataFrame, n: str = "n") -> DataFrame:
    """One row: interpolated, upper and lower median of n; the upper one is the lower one of the reversed order."""
    disc = lambda way: F.expr(f"percentile_disc(0.5) within group (order by {n} {way})").cast("long")
    return counts.agg(F.percentile(n, 0.5).alias("median"), disc("desc").alias("upper_median"), disc("asc").alias("lower_median"))


def tile_counts(tiles: DataFrame, pieces: DataFrame) -> DataFrame:
    """``tiles`` with c, its annotations, 0 for empty tiles."""
    n = pieces.groupBy("image_id").agg(F.count("*").alias("c"))
    return tiles.join(n, "image_id", "left").withColumn("c", F.coalesce("c", F.lit(0).cast("long")))


def density(tiles: DataFrame, by: str = "split") -> DataFrame:
    """Per ``by`` of tiles (c): mean, whole median, share of empty ones, largest."""
    return tiles.groupBy(by).agg(
        F.count("*").alias("tiles"),
        F.round(F.avg("c"), 9).alias("mean"),
        F.percentile("c", 0.5).cast("long").alias("median"),
        F.round(F.count_if(F.col("c") == 0) * 100.0 / F.count("*"), 9).alias("pct_empty"),
        F.max("c").alias("largest"),
    )


def density_histogram(tiles: DataFrame, by: str = "split", bins: int = 30) -> DataFrame:
    """Share per unit width in ``bins`` equal bins from least to largest c of non-empty tiles; the last bin is closed; a span of 0 widens by half to both sides."""
    own = tiles.where("c > 0")
    ends = own.groupBy(by).agg(F.min("c").cast("double").alias("lo"), F.max("c").cast("double").alias("hi"), F.count("*").alias("total"))
    ends = ends.select(by, F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "total")
    at = F.least(F.lit(bins), F.floor((F.col("c") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1)
    per = own.groupBy(by, "c").agg(F.count("*").alias("n")).join(ends, by).withColumn("bin", at.cast("long"))
    per = per.groupBy(by, "bin", "lo", "hi", "total").agg(F.sum("n").alias("n"))
    return per.select(by, "bin", "n", F.round(F.col("n") / (F.col("total") * (F.col("hi") - F.col("lo")) / bins), 9).alias("density"))


def count_extremes(freq: DataFrame) -> DataFrame:
    """Most and least common species, largest count, counts below 10 and 50."""
    return freq.agg(
        F.max_by("species", F.struct("n", -F.col("first_pos"))).alias("most_common"),
        F.min_by("species", F.struct("n", "first_pos")).alias("least_common"),
        F.max("n").alias("max_n"),
        F.count_if(F.col("n") < 10).alias("under_10"),
        F.count_if(F.col("n") < 50).alias("under_50"),
    )


def violin(tiles: DataFrame, by: str = "split", points: int = 100) -> DataFrame:
    """(by, x, density, median, least, largest) of non-empty tiles (c): a Gaussian kernel estimate at ``points`` places from least to largest c.

    The bandwidth is the standard deviation times n ** -0.2 (Scott); a group without spread has a null density.  Work is the number of
    different counts times the points, not the number of tiles.
    """
    own = tiles.where("c > 0")
    ends = own.groupBy(by).agg(F.count("*").alias("n"), F.stddev_samp("c").alias("s"), F.percentile("c", 0.5).alias("median"), F.min("c").alias("least"), F.max("c").alias("largest"))
    ends = ends.withColumn("h", F.nullif(F.col("s") * F.pow("n", F.lit(-0.2)), F.lit(0.0)))
    place = F.col("least") + F.col("k") * (F.col("largest") - F.col("least")) / (points - 1)
    grid = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", place)
    rows = own.groupBy(by, "c").agg(F.count("*").alias("m")).join(grid, by)
    kernel = F.exp(-F.pow((F.col("x") - F.col("c")) / F.col("h"), F.lit(2.0)) / 2) / (F.col("h") * math.sqrt(2 * math.pi))
    out = rows.groupBy(by, "k", "x", "n", "median", "least", "largest").agg(F.sum(F.col("m") * kernel).alias("total"))
    return out.select(by, "x", (F.col("total") / F.col("n")).alias("density"), "median", "least", "largest")


def stacked(counts: DataFrame, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """(species, split, n, base) of counts (species and a column per split): where each part of a stacked bar begins."""
    parts = F.posexplode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("n")) for s in splits])).alias("at", "p")
    before = F.sum("n").over(Window.partitionBy("species").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    rows = counts.select("species", parts).select("species", "at", "p.*")
    return rows.select("species", "split", "n", F.coalesce(before, F.lit(0)).alias("base"))


def split_map(tiles: DataFrame, size: int) -> DataFrame:
    """(om, column, row, split): the grid cell of each tile (om, tile_x, tile_y, split)."""
    return tiles.select("om", F.expr(f"tile_x div {size}").alias("column"), F.expr(f"tile_y div {size}").alias("row"), "split")


def guarded_percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)
