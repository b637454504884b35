"""Random train/val/test partitions of tiles, their scores and the search for the best."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygrid.functions.names import hashed_key, key_block
from skygrid.operators.ids import two_level_ids

SPLITS = ("train", "val", "test")
TARGETS = {"train": 0.8, "val": 0.1, "test": 0.1}


def _cut(rank: Column, n: Column) -> Column:
    train, val = (n * F.lit(0.8)).cast("int"), (n * F.lit(0.1)).cast("int")
    return F.when(rank <= train, "train").when(rank <= train + val, "val").otherwise("test")


def random_splits(tiles: DataFrame, iterations: DataFrame, key: Callable[[Column, Column], Column] = hashed_key, id_col: str = "image_id") -> DataFrame:
    """(iteration, image_id, split): for each row of ``iterations`` a seeded order of the tiles, cut at 80 and 90 percent."""
    rows = tiles.select(id_col).join(F.broadcast(iterations))  # the search's parameter: a row per iteration
    rows = rows.withColumn("__key", key(F.col(id_col), F.col("iteration"))).withColumn("__block", key_block(F.col("__key")))
    rows = two_level_ids(rows, "__block", ["__key", id_col], "__rank", ["iteration"], "__size")
    return rows.select("iteration", id_col, _cut(F.col("__rank"), F.col("__size")).alias("split"))


def stratified_split(rows: DataFrame, label: str, key: Column) -> DataFrame:
    """``rows`` with split, cut within each label in the order of ``key``, below 2**31; null labels are a label."""
    own = rows.withColumn("__key", key).withColumn("__block", key_block(F.col("__key"))).withColumn("__label", F.struct(F.col(label)))
    own = two_level_ids(own, "__block", ["__key"], "__rank", ["__label"], "__size")
    return own.select(*rows.columns, _cut(F.col("__rank"), F.col("__size")).alias("split"))


def split_counts(assigned: DataFrame, tile_species: DataFrame) -> DataFrame:
    """(iteration, species, train, val, test) from per-tile counts (image_id, species, n): one shuffle whatever the iterations."""
    own = assigned.join(tile_species, "image_id").groupBy("iteration", "species")
    return own.agg(*[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).cast("long").alias(s) for s in SPLITS])


def score_splits(counts: DataFrame) -> DataFrame:
    """Per iteration: distance of distributions, penalty for species missing in val or test, penalty for sizes off target, total."""
    w = Window.partitionBy("iteration")
    c = counts.withColumn("g", F.col("train") + F.col("val") + F.col("test"))
    for s in ("g", *SPLITS):
        c = c.withColumn(f"all_{s}", F.sum(s).over(w))
    share = lambda s: F.coalesce(F.col(s) / F.nullif(F.col(f"all_{s}"), F.lit(0)), F.lit(0.0))
    distance = sum((F.abs(share(s) - share("g")) for s in SPLITS), F.lit(0.0))
    missing = sum((F.when((F.col("g") > 0) & (F.col(s) == 0), F.sqrt(share("g"))).otherwise(0.0) for s in ("val", "test")), F.lit(0.0))
    off = sum((F.abs(F.coalesce(F.max(f"all_{s}") / F.nullif(F.max("all_g"), F.lit(0)), F.lit(0.0)) - TARGETS[s]) for s in SPLITS), F.lit(0.0))
    out = c.groupBy("iteration").agg(
        F.round(F.sum(distance), 9).alias("distribution_score"), F.round(2.0 * F.sum(missing), 9).alias("missing_penalty"), F.round(0.5 * off, 9).alias("imbalance_penalty")
    )
    return out.withColumn("total_score", F.round(F.col("distribution_score") + F.col("missing_penalty") + F.col("imbalance_penalty"), 9))


def best_split(scores: DataFrame) -> DataFrame:
    """One row: the earliest iteration of the least total, and mean and population deviation of all."""
    return scores.agg(
        F.min_by("iteration", F.struct("total_score", "iteration")).alias("best_iteration"),
        F.min("total_score").alias("best_score"),
        F.round(F.avg("total_score"), 9).alias("mean_score"),
        F.round(F.stddev_pop("total_score"), 6).alias("std_score"),
    )


def running_best(scores: DataFrame) -> DataFrame:
    """``scores`` with improved: whether no iteration before was as good; a row per iteration, so one window."""
    w = Window.orderBy("iteration").rowsBetween(Window.unboundedPreceding, -1)
    before = F.min("total_score").over(w)
    return scores.select("iteration", "total_score", (before.isNull() | (F.col("total_score") < before)).alias("improved"))


def split_sizes(assigned: DataFrame, per_tile: DataFrame) -> DataFrame:
    """Tiles and annotations by split, with a row for all, and the share of annotations; ``per_tile`` has image_id and c."""
    per = assigned.join(per_tile.select("image_id", "c"), "image_id").rollup("split").agg(F.count("*").alias("tiles"), F.sum("c").alias("annotations"), F.grouping("split").alias("g"))
    total = F.max(F.when(F.col("g") == 1, F.col("annotations"))).over(Window.partitionBy())  # four rows
    return per.select(
        F.coalesce("split", F.lit("total")).alias("split"), "tiles", "annotations", F.round(F.coalesce(F.col("annotations") * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0)), 9).alias("pct")
    )


def species_shares(counts: DataFrame) -> DataFrame:
    """(species, train, val, test, total, pct_*, deviation, rank) of one iteration's counts; zeros where a species is absent."""
    c = counts.withColumn("total", F.col("train") + F.col("val") + F.col("test"))
    for s in SPLITS:
        c = c.withColumn(f"pct_{s}", F.round(F.when(F.col("total") > 0, F.col(s) * 100.0 / F.col("total")).otherwise(0.0), 9))
    dev = sum((F.abs(F.col(f"pct_{s}") - TARGETS[s] * 100) for s in SPLITS), F.lit(0.0))
    c = c.withColumn("deviation", F.round(F.when(F.col("total") > 0, dev).otherwise(0.0), 6))
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "species")).cast("long"))  # a row per species


def imbalance_top(shares: DataFrame, k: int = 10, support: int = 10) -> DataFrame:
    return shares.where(F.col("total") >= support).orderBy(F.desc("deviation"), F.desc("total"), "species").limit(k).select("species", "total", "deviation")


def missing_species(counts: DataFrame) -> DataFrame:
    """Species that occur but are missing in val or test, with which."""
    own = counts.where((F.col("train") + F.col("val") + F.col("test") > 0) & ((F.col("val") == 0) | (F.col("test") == 0)))
    return own.select("species", (F.col("val") == 0).alias("missing_val"), (F.col("test") == 0).alias("missing_test"))


def split_bundles(assigned: DataFrame, tiles: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of each split under new ids in their old order.

    ``tiles`` (om, image_id, file_name), ``pieces`` (om, image_id, tile_id, annotation_id, ...), numbered image by image.
    """
    images = two_level_ids(tiles.join(assigned, "image_id"), "om", ["image_id"], "new_image_id", ["split"])
    own = pieces.join(images.select("image_id", "split", "new_image_id"), "image_id")
    return images, two_level_ids(own, "om", ["annotation_id"], "new_annotation_id", ["split"])


def split_invariants(assigned: DataFrame, tiles: DataFrame) -> DataFrame:
    """One row that tells whether the splits are disjoint and complete."""
    per = assigned.groupBy("image_id").agg(F.count("*").alias("n"))
    both = tiles.select("image_id").join(per, "image_id", "full")
    return both.agg(F.count("*").alias("ids"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("n").isNull()).alias("missing"))
