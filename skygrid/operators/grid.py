"""Tile grids over images and the spatial join of boxes with them.

Each box enumerates the grid cells it can touch, so the join is an explode and never a nested loop: its cost is the number of
cells touched, wherever boxes cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygrid.operators.ids import category_ids, two_level_ids

MIN_AREA = 4.0
PIECE = "om tile_id tile_x tile_y det_idx species category_id x y w h area is_clipped annotation_id".split()


def _cells(low: Column, high: Column, size: int, n: Column) -> Column:
    """Cells of ``size`` that [low, high) touches among the first ``n``; empty if there is none, as sequence() counts down."""
    first = F.greatest(F.floor(low / size), F.lit(0))
    last = F.least(F.ceil(high / size) - 1, n - 1)
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def tile_name(om: Column, x: Column, y: Column) -> Column:
    return F.format_string("OM_%03d_%05d_%05d.png", om, x, y)


def tile_grid(images: DataFrame, size: int) -> DataFrame:
    """(om, tile_id, tile_x, tile_y, file_name) of the whole tiles of images (om, width, height); edge strips have none."""
    nx, ny = F.expr(f"width div {size}"), F.expr(f"height div {size}")
    cells = images.where((nx > 0) & (ny > 0)).select("om", nx.alias("nx"), F.explode(F.sequence(F.lit(0).cast("long"), nx * ny - 1)).alias("k"))
    cells = cells.select("om", (F.col("k") + 1).alias("tile_id"), (F.col("k") % F.col("nx") * size).alias("tile_x"), (F.expr("k div nx") * size).alias("tile_y"))
    return cells.withColumn("file_name", tile_name(F.col("om"), F.col("tile_x"), F.col("tile_y")))


def tile_join(boxes: DataFrame, images: DataFrame, size: int, min_area: float = MIN_AREA, default: str = "UNKNOWN") -> DataFrame:
    """Boxes (om, det_idx, x_min, y_min, x_max, y_max, species) clipped to each tile they overlap.

    Touching edges don't overlap; pieces of less than ``min_area`` go, unclipped ones too; boxes with a null coordinate go.
    Gives om, tile_id, tile_x, tile_y, det_idx, species, category_id, x, y, w, h, area, is_clipped, annotation_id.
    """
    boxes = boxes.withColumn("species", F.coalesce("species", F.lit(default)))
    cats = category_ids(boxes.select("om", "species"), by="om")
    whole = boxes.where("x_min is not null and y_min is not null and x_max is not null and y_max is not null")
    whole = whole.join(images.select("om", "width", "height"), "om")
    nx, ny = F.expr(f"width div {size}"), F.expr(f"height div {size}")
    rows = whole.withColumn("tx", F.explode(_cells(F.col("x_min"), F.col("x_max"), size, nx)))
    rows = rows.withColumn("ty", F.explode(_cells(F.col("y_min"), F.col("y_max"), size, ny)))
    x0, y0 = F.col("tx") * size, F.col("ty") * size
    left, top = F.greatest(F.col("x_min"), x0), F.greatest(F.col("y_min"), y0)
    w, h = F.least(F.col("x_max"), x0 + size) - left, F.least(F.col("y_max"), y0 + size) - top
    clipped = (F.col("x_min") < x0) | (F.col("y_min") < y0) | (F.col("x_max") > x0 + size) | (F.col("y_max") > y0 + size)
    overlap = (F.col("x_max") > x0) & (F.col("x_min") < x0 + size) & (F.col("y_max") > y0) & (F.col("y_min") < y0 + size)
    rows = rows.where(overlap & (w * h >= min_area))
    rows = rows.select(
        "om",
        (F.col("ty") * nx + F.col("tx") + 1).alias("tile_id"),
        x0.alias("tile_x"),
        y0.alias("tile_y"),
        "det_idx",
        "species",
        (left - x0).alias("x"),
        (top - y0).alias("y"),
        w.alias("w"),
        h.alias("h"),
        (w * h).alias("area"),
        clipped.alias("is_clipped"),
    )
    rows = rows.join(cats, ["om", "species"], "left").withColumn("category_id", F.coalesce("category_id", F.lit(0).cast("long")))
    return two_level_ids(rows, "tile_id", ["det_idx"], "annotation_id", ["om"]).select(*PIECE)


def tiling_stats(images: DataFrame, pieces: DataFrame, size: int) -> DataFrame:
    """Per image: tiles, dropped edge tiles, annotations, clipped ones, empty tiles and tiles with a clipped box."""
    per_tile = pieces.groupBy("om", "tile_id").agg(F.count("*").alias("n"), F.count_if("is_clipped").alias("c"))
    per_image = per_tile.groupBy("om").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.count("*").alias("full"), F.count_if(F.col("c") > 0).alias("partial"))
    nx, ny = F.expr(f"width div {size}"), F.expr(f"height div {size}")
    rx, ry = (F.col("width") % size > 0).cast("long"), (F.col("height") % size > 0).cast("long")
    out = images.join(per_image, "om", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return out.select(
        "om",
        (nx * ny).alias("total_tiles"),
        (ny * rx + nx * ry + rx * ry).alias("dropped_edge_tiles"),
        zero(F.col("n")).alias("total_annotations"),
        zero(F.col("c")).alias("clipped_boxes"),
        (nx * ny - zero(F.col("full"))).alias("empty_tiles"),
        zero(F.col("partial")).alias("tiles_with_partial_boxes"),
    )
