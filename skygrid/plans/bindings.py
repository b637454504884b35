"""Views of the driver's tables as the engine's inputs; operators never see these names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrid.operators.grid import tile_grid, tile_join
from skygrid.operators.ids import two_level_ids

IMAGES, SIDE, TILE = 24, 10_000, 500
PER_IMAGE = (SIDE // TILE) ** 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession) -> DataFrame:
    return spark.range(1, IMAGES + 1).select(F.col("id").alias("om"), F.lit(SIDE).cast("long").alias("width"), F.lit(SIDE).cast("long").alias("height"))


def detections(spark: SparkSession, sf_dir: str, long_tail: bool = False) -> DataFrame:
    """Boxes derived from lineitem and part; with ``long_tail`` a few species are rare."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    own = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    rare = F.when((F.col("l_orderkey") * 31 + F.col("l_partkey")) % 4001 < 2, F.concat(F.lit("RARE_"), (F.col("l_partkey") % 5).cast("string"))).otherwise(F.col("p_brand"))
    own = own.withColumn("om", F.col("l_suppkey") % 24 + 1)
    own = own.withColumn("block", F.expr("l_orderkey div 4096"))
    own = two_level_ids(own, "block", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "det_idx", ["om"])
    x = ((F.col("l_partkey") * 7919 + F.col("l_orderkey") * 31) % 10000).cast("double")
    y = ((F.col("l_orderkey") * 104729 + F.col("l_linenumber") * 577) % 10000).cast("double")
    return own.select(
        "om",
        "det_idx",
        x.alias("x_min"),
        y.alias("y_min"),
        (x + F.col("l_quantity")).alias("x_max"),
        (y + 1 + F.col("l_partkey") % 40 + F.col("l_linenumber") % 4 * 0.25).alias("y_max"),
        (rare if long_tail else F.col("p_brand")).alias("species"),
    )


def pieces(spark: SparkSession, sf_dir: str, long_tail: bool = False) -> DataFrame:
    """Tiled annotations with image_id, the tile's number over all images."""
    own = tile_join(detections(spark, sf_dir, long_tail), images(spark), TILE)
    return own.withColumn("image_id", (F.col("om") - 1) * PER_IMAGE + F.col("tile_id"))


def tiles(spark: SparkSession) -> DataFrame:
    return tile_grid(images(spark), TILE).withColumn("image_id", (F.col("om") - 1) * PER_IMAGE + F.col("tile_id")).withColumn("om_id", F.format_string("OM_%03d", "om"))


def source_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    name = F.format_string("20250510 10k-%02d-%02d.jpg", F.expr("s_suppkey div 10"), F.col("s_suppkey") % 10)
    return s.select("s_suppkey", F.when(F.col("s_suppkey") % 17 == 0, F.format_string("DJI_%04d.jpg", "s_suppkey")).otherwise(name).alias("file_name"))


def annotation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_name, detections) of the images that have an entry."""
    names = source_images(spark, sf_dir).where(F.col("s_suppkey") % 13 != 0)
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("detections"))
    return names.join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("file_name", F.coalesce("detections", F.lit(0).cast("long")).alias("detections"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("source").alias("label"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    scores = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    own = e.select(F.col("vec_id").alias("row_id"), F.col("label").alias("y_true"), scores.alias("scores"))
    from skygrid.operators.metrics import arg_max

    return own.withColumn("y_pred", arg_max(F.col("scores")))
