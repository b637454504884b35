"""The stages of preparing training data, from source images and detections to splits and crops, each from files to files.

Names and forms of the files are fixed values, as other programs read them.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skygrid.functions import names as N
from skygrid.operators import catalog, distributions, grid, ids, raster, reports, sampling, splits
from skygrid.sources import coco, rasters, sinks


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def prepare(spark: SparkSession, images_dir: str, annotations_json: str, out: str, samples_dir: str | None = None, today: datetime.date | None = None) -> DataFrame:
    """Number the source images, copy them under their new names and write their annotations; returns (om, src, file_name, n)."""
    coco.existing(spark, images_dir, annotations_json)
    if _exists(spark, out):
        raise FileExistsError(out)
    files = coco.list_rasters(spark, images_dir, "*").where(N.is_source_image(F.col("file_name")))
    if files.isEmpty():
        raise FileNotFoundError(f"no source images in {images_dir}")
    name = F.col("file_name")
    order = Window.orderBy(N.source_row(name), N.source_col(name), name)  # a row per source image
    own = files.withColumn("om", F.row_number().over(order)).select("om", "path", F.col("file_name").alias("src"), N.image_name(F.col("om"), name).alias("file_name"))
    master = coco.read_master(spark, annotations_json).withColumnRenamed("file_name", "src")
    empty = F.array().cast(f"array<{coco.DETECTION}>")
    rows = own.join(master, "src", "left").select("om", "src", "path", "file_name", *[F.coalesce(c, F.lit(coco.SIDE)).alias(c) for c in ("width", "height")], F.coalesce("detections", empty).alias("detections"))
    rasters.copy_files(rows.select(F.col("path").alias("src"), F.concat(F.lit("images/"), "file_name").alias("dst")), out)
    one = F.to_json(F.struct(F.struct("file_name", "width", "height").alias("image"), F.col("detections").alias("annotations")))
    rasters.write_files(rows.select(F.format_string("annotations/OM_%03d_annotations.json", "om").alias("path"), F.encode(one, "UTF-8").alias("data")), out)
    sinks.write_combined(rows, f"{out}/annotations/all_annotations.json")
    if samples_dir and _exists(spark, samples_dir):
        samples = coco.list_rasters(spark, samples_dir, "*")
        rasters.copy_files(samples.select(F.col("path").alias("src"), F.concat(F.lit("samples/"), "file_name").alias("dst")), out)
    boxes = coco.boxes(rows.select("om", "detections"), default="UNKN")
    day = (today or datetime.date.today()).strftime("%Y%m%d")
    sinks.write_text(reports.master_summary(rows, boxes), f"{out}/metadata/CO-DETR - Master Summary {day}.txt", ["section", "at"])
    return rows.select("om", "src", "file_name", F.size("detections").alias("n"))


def _tile(spark: SparkSession, images: DataFrame, detections: DataFrame, out: str, size: int) -> DataFrame:
    """Write tiles, COCO documents and diagnostics of images (om, om_id, file_name, height, width, data) under out/om_id; returns diagnostics."""
    if size <= 0:
        raise ValueError("the tile size must be positive")
    sides = images.select("om", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))
    cells = grid.tile_grid(sides, size)
    pieces = grid.tile_join(coco.boxes(detections), sides, size)
    pixels = raster.slice_tiles(images, size).join(images.select("om", "om_id"), "om")
    name = grid.tile_name(F.col("om"), F.col("tile_x"), F.col("tile_y"))
    files = pixels.select(F.concat_ws("/", "om_id", F.lit("tiles"), name).alias("path"), F.lit(size).alias("height"), F.lit(size).alias("width"), "data")
    rasters.write_files(rasters.to_png(files), out)
    stats = grid.tiling_stats(sides, pieces, size).join(images.select("om", "om_id", "file_name"), "om")
    size_text = F.concat_ws("x", F.col("width"), F.col("height"))
    diagnostics = stats.join(sides, "om").select(
        "om", F.col("om_id").alias("orthomosaic_id"), size_text.alias("image_size"), F.lit(size).alias("tile_size"),
        "total_tiles", "dropped_edge_tiles", "total_annotations", "clipped_boxes", "empty_tiles", "tiles_with_partial_boxes",
    )
    texts = diagnostics.select(F.concat("orthomosaic_id", F.lit("/tiling_diagnostics.json")).alias("path"), F.encode(F.to_json(F.struct(*diagnostics.columns[1:])), "UTF-8").alias("data"))
    rasters.write_files(texts, out)
    categories = ids.category_ids(coco.boxes(detections).select("om", "species"), by="om")
    tiles = cells.select("om", F.col("tile_id").alias("id"), "file_name", F.lit(size).alias("width"), F.lit(size).alias("height"), F.col("tile_x").cast("int"), F.col("tile_y").cast("int"))
    for r in images.select("om", "om_id", "file_name", "width", "height").collect():  # a document per image
        at = F.col("om") == r["om"]
        info = {"description": f"Detections of {r['om_id']}, tiled", "version": "1.0", "tile_size": size, "source_image": r["file_name"], "source_dimensions": f"{r['width']}x{r['height']}"}
        own = tiles.where(at).select("id", "file_name", "width", "height", F.lit(r["om_id"]).alias("orthomosaic_id"), "tile_x", "tile_y")
        sinks.write_coco(own, coco_annotations(pieces.where(at)), categories.where(at).select(F.col("category_id").alias("id"), F.col("species").alias("name")), f"{out}/{r['om_id']}/annotations.json", info)
    return diagnostics


def coco_annotations(pieces: DataFrame, id_col: str = "annotation_id", image_col: str = "tile_id") -> DataFrame:
    """COCO annotations of tiled boxes: sides and area to two places, the area from the sides as they were."""
    box = F.array(*[F.round(c, 2) for c in ("x", "y", "w", "h")])
    area = F.round(F.col("w") * F.col("h"), 2)
    return pieces.select(F.col(id_col).alias("id"), F.col(image_col).alias("image_id"), "category_id", box.alias("bbox"), area.alias("area"), F.lit(0).alias("iscrowd"))


def _images(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = rasters.read_rasters(spark, paths).withColumn("om_id", N.image_id_of(F.col("file_name")))
    return rows.withColumn("om", F.coalesce(N.image_number(F.col("om_id")), F.lit(0).cast("long")))


def tile(spark: SparkSession, image: str, annotations: str, out: str, size: int = 512) -> DataFrame:
    """Tile one image; its annotations are a document of one image or a list of images."""
    paths = coco.existing(spark, image)
    coco.existing(spark, annotations)
    images = _images(spark, paths).cache()
    if not images.where("data is null").isEmpty():
        raise ValueError(f"could not load {image}")
    found = coco.read_image_annotations(spark, annotations, target=paths[0].rsplit("/", 1)[-1])
    return _tile(spark, images, images.select("om").crossJoin(found.select("detections")), out, size)  # one row each


def tile_all(spark: SparkSession, dataset_dir: str, out: str, size: int = 500) -> tuple[DataFrame, int]:
    """Tile every image OM_*.jpg of a prepared data set and merge; returns diagnostics and the number of images without annotations."""
    images = _images(spark, coco.existing(spark, f"{dataset_dir}/images/OM_*.jpg"))
    found, failed = coco.match_annotations(images.drop("om_id"), coco.read_om_annotations(spark, f"{dataset_dir}/annotations"))
    found = found.where("data is not null").cache()
    out_rows = _tile(spark, found.drop("detections"), found.select("om", "detections"), out, size)
    merge(spark, out, f"{out}/all_annotations.json", size)
    return out_rows, failed.first()["failed"]


def merge(spark: SparkSession, folder: str, path: str, size: int = 500) -> None:
    """One COCO document of all folder/OM_*/annotations.json, in the order of their names."""
    files = coco.existing(spark, f"{folder}/OM_*/annotations.json")
    images, annotations, categories = coco.read_coco(spark, files)
    own = annotations.select("file", "pos", "image_id", "category_id", "bbox", "area", "iscrowd")
    names = categories.select("file", F.col("id").alias("category_id"), "name")
    merged = ids.merge_bundles(images.select("file", F.col("id").alias("image_id")), own, names)
    rows = merged.join(own.select("file", "pos", "bbox", "area", "iscrowd"), ["file", "pos"])
    tops = images.groupBy("file").agg(F.max("id").alias("top"))
    offsets = tops.select("file", F.coalesce(F.sum("top").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))  # a row per file
    om_id = F.element_at(F.split("file", "/"), -2)
    tiles = images.join(offsets, "file").select((F.col("id") + F.col("offset")).alias("id"), N.tile_path(om_id, F.col("file_name")).alias("file_name"), "width", "height", "orthomosaic_id", "tile_x", "tile_y")
    info = {"description": "Detections of all images, tiled", "version": "1.0", "tile_size": size, "num_orthomosaics": len(files)}
    marks = rows.select(F.col("global_annotation_id").alias("id"), F.col("global_image_id").alias("image_id"), F.col("global_category_id").alias("category_id"), "bbox", "area", "iscrowd")
    sinks.write_coco(tiles, marks, ids.category_ids(names.select("name"), name="name").select(F.col("category_id").alias("id"), "name"), path, info)


def split(spark: SparkSession, tiles_dir: str | None, annotations: str, out: str, iterations: int = 3000, seed: int = 42) -> dict[str, object]:
    """The best of ``iterations`` random partitions of the tiles, with its report, tile lists, COCO documents and metadata."""
    coco.existing(spark, annotations, *([tiles_dir] if tiles_dir else []))
    images, marks, categories = coco.read_coco(spark, annotations)
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("species"))
    per = marks.join(names, "category_id").groupBy("image_id", "species").agg(F.count("*").alias("n"))
    rounds = spark.range(1, iterations + 1).withColumnRenamed("id", "iteration")
    assigned = splits.random_splits(images.select(F.col("id").alias("image_id")), rounds, lambda i, it: N.hashed_key(i, it, seed))
    counts = splits.split_counts(assigned, per)
    scores = splits.score_splits(counts).cache()
    best = splits.best_split(scores).first()
    score = scores.where(F.col("iteration") == best["best_iteration"]).first().asDict()
    one = assigned.where(F.col("iteration") == best["best_iteration"]).drop("iteration").cache()
    shares = splits.species_shares(counts.where(F.col("iteration") == best["best_iteration"])).cache()
    sizes = {s: 0 for s in splits.SPLITS} | {r["split"]: r["count"] for r in one.groupBy("split").count().collect()}
    lines = reports.split_report(shares, score, sizes, seed, iterations)
    sinks.write_text(spark.createDataFrame(list(enumerate(lines)), "at int, value string"), f"{out}/split_report.txt", ["at"])
    kept = images.select("id", "file_name", "width", "height", "orthomosaic_id", "tile_x", "tile_y").join(one.withColumnRenamed("image_id", "id"), "id")
    for s in splits.SPLITS:
        own = kept.where(F.col("split") == s).drop("split")
        sinks.write_lines(own, ["id"], "file_name", f"{out}/{s}_tiles.txt")
        within = marks.select("id", "image_id", "category_id", "bbox", "area", "iscrowd").join(own.select(F.col("id").alias("image_id")), "image_id")
        new = ids.two_level_ids(own.withColumn("block", F.expr("id div 100000")), "block", ["id"], "new_id").drop("block")
        images_out = new.select(F.col("new_id").alias("id"), "file_name", "width", "height", "orthomosaic_id", "tile_x", "tile_y")
        within = within.join(new.select(F.col("id").alias("image_id"), "new_id"), "image_id").drop("image_id")
        within = ids.two_level_ids(within.withColumn("block", F.expr("id div 100000")), "block", ["id"], "new_annotation").drop("block")
        marks_out = within.select(F.col("new_annotation").alias("id"), F.col("new_id").alias("image_id"), "category_id", "bbox", "area", "iscrowd")
        sinks.write_coco(images_out, marks_out, categories.select("id", "name"), f"{out}/{s}_annotations.json")
    sinks.write_text(reports.split_metadata(one, shares, score, seed, iterations), f"{out}/split_metadata.json", ["section", "at"])
    return best.asDict()


def crop(spark: SparkSession, annotations: str, tile_dir: str, out: str, pad: float = 0.25, size: int = 224, species: list[str] | None = None) -> dict[str, object]:
    """Square crops of all annotations, or of some species, in a folder per species, with their catalogue and summary."""
    coco.existing(spark, annotations, tile_dir)
    images, marks, categories = coco.read_coco(spark, annotations)
    side = [F.get("bbox", F.lit(k)).alias(c) for k, c in enumerate(("x", "y", "w", "h"))]
    pieces = marks.select(F.col("id").alias("annotation_id"), "image_id", "category_id", *side)
    names = categories.select(F.col("id").alias("category_id"), "name").dropDuplicates(["category_id"])
    if species:
        pieces = catalog.species_filter(pieces, names, species)
    tiles = images.select(F.col("id").alias("image_id"), "file_name", N.first_folder(F.col("orthomosaic_id"), F.col("file_name")).alias("om_id"))
    pixels = rasters.read_rasters(spark, _folders(spark, tile_dir))
    base = F.lit(tile_dir.rstrip("/") + "/")
    path = F.regexp_replace("path", "^file:/+", "/")
    pixels = pixels.where("data is not null").select(F.when(path.startswith(base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(F.col("file_name")).alias("file_name"), "height", "width", "data")
    readable = tiles.join(pixels.select("file_name"), "file_name", "left_semi")
    rows = catalog.crop_catalog(pieces, readable, names)
    own = pieces.join(readable, "image_id").join(pixels, "file_name")
    windows = own.withColumn("v", N.crop_window(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height"), pad)).select("annotation_id", "v.*", "height", "width", "data")
    rasters.write_files(rasters.species_folder(rows, raster.crop_tiles(windows, size), size), out)
    order = ["annotation_id"]
    sinks.write_csv(rows, f"{out}/annotations.csv", order)
    summary = catalog.catalog_summary(rows, catalog.skipped(pieces, readable))
    sinks.write_json_row(summary, f"{out}/species_distribution.json")
    return {k: v for k, v in summary.first().asDict().items() if k != "species_counts"}


def _folders(spark: SparkSession, tile_dir: str) -> list[str]:
    """The folders under ``tile_dir`` that hold PNG files, up to two levels down."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for pattern in ("*.png", "*/*.png", "*/*/*.png"):
        where = jvm.org.apache.hadoop.fs.Path(f"{tile_dir}/{pattern}")
        if where.getFileSystem(conf).globStatus(where):
            out.append(f"{tile_dir}/{pattern}")
    if not out:
        raise FileNotFoundError(f"no tiles in {tile_dir}")
    return out


def species_eda(spark: SparkSession, source: str, path: str, out: str, threshold: int = 50) -> DataFrame:
    """Counts by species of ``annotations`` (COCO), ``crops`` (crop summary) or ``csv`` (Species, Count, Name), written as CSV and returned."""
    coco.existing(spark, path)
    if source == "annotations":
        _, marks, categories = coco.read_coco(spark, path)
        rows = marks.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("species")), "category_id").select("species", F.col("id").alias("pos"))
        freq = distributions.species_frequency(rows, threshold=threshold).select("species", "n", "rank", "included")
    else:
        own = coco.read_species_counts(spark, path) if source == "crops" else spark.read.schema("species string, n long, label string").option("header", True).csv(path).select("species", "n")
        rank = F.row_number().over(Window.orderBy(F.desc("n"), "species"))  # a row per species
        freq = own.withColumn("rank", rank.cast("long")).withColumn("included", F.col("n") >= threshold)
    sinks.write_csv(freq.select("rank", "species", "n", "included"), f"{out}/species_distribution.csv", ["rank"])
    return freq


def image_eda(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """The summary of each image's annotations, as om_summary.csv."""
    rows = coco.read_om_annotations(spark, folder)
    found = coco.boxes(rows.withColumnRenamed("om_id", "om"), default="UNKN")
    summary = distributions.image_summary(rows.select(F.col("om_id").alias("om")), found).withColumnRenamed("om", "orthomosaic")
    sinks.write_csv(summary.select("orthomosaic", "total_annotations", "num_species", "top_species"), f"{out}/om_summary.csv", ["orthomosaic"])
    return summary


def tiled_eda(spark: SparkSession, annotations: str, out: str) -> DataFrame:
    """Summary and medians of a tiled data set, as one row of JSON."""
    coco.existing(spark, annotations)
    images, marks, categories = coco.read_coco(spark, annotations)
    tiles = images.select(F.col("id").alias("image_id"), F.col("orthomosaic_id").alias("om"))
    pieces = marks.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("species")), "category_id")
    row = distributions.dataset_summary(tiles, pieces).join(F.broadcast(distributions.medians(distributions.tile_counts(tiles, pieces.select("image_id")), "c")))  # one row each
    sinks.write_json_row(row, f"{out}/tiled_summary.json")
    return row


def split_eda(spark: SparkSession, folder: str, out: str, size: int = 500) -> dict[str, DataFrame]:
    """Chart data of a split: stacked counts, density, histogram, violins and the map of tiles, as Parquet tables."""
    images, marks, categories, _ = coco.read_split_bundle(spark, folder)
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("species")).dropDuplicates(["category_id"])
    own = marks.join(names, "category_id")
    per = own.groupBy("species").agg(*[F.count_if(F.col("split") == s).alias(s) for s in splits.SPLITS])
    n = marks.groupBy("split", "image_id").agg(F.count("*").alias("c"))
    tiles = images.select("split", F.col("id").alias("image_id"), F.col("orthomosaic_id").alias("om"), "tile_x", "tile_y")
    full = tiles.join(n, ["split", "image_id"], "left").withColumn("c", F.coalesce("c", F.lit(0).cast("long")))
    tables = {
        "species_shares": splits.species_shares(per),
        "stacked": distributions.stacked(per),
        "density": distributions.density(full),
        "histogram": distributions.density_histogram(full),
        "violin": distributions.violin(full),
        "split_map": distributions.split_map(tiles, size),
    }
    sinks.write_tables(tables, out)
    return tables


def train_inputs(spark: SparkSession, label_mapping: str, image_root: str, out: str, epochs: int = 30, warmup: int = 10, rate: float = 1e-4, decay: float = 1e-4, cap: int | None = None) -> dict[str, object]:
    """What a classifier's training reads: classes, capped rows with paths, weights, composition and learning rates.  The network isn't here."""
    mapping, classes, rows = coco.read_split_config(spark, label_mapping)
    key = lambda i: F.xxhash64(F.lit(42), i)
    run = f"{out}/{N.run_name('run', epochs, rate, decay)}"
    own, sizes = [], {}
    for s, df in rows.items():
        one = sampling.loader_pipeline(df.withColumnRenamed("remapped_label", "label"), [], cap, key, s, id_col="crop_path")
        own.append(one.withColumn("split", F.lit(s)).withColumn("path", N.crop_path(F.col("crop_path"), image_root)))
    every = own[0].unionByName(own[1]).unionByName(own[2]).join(classes, "label")
    sizes = {r["split"]: r["count"] for r in every.groupBy("split").count().collect()}
    weights = sampling.class_weights(sampling.class_counts(every.where("split = 'train'")))
    rates = spark.range(1, epochs + 1).select(F.col("id").alias("epoch"), N.lr_at(F.col("id"), epochs, warmup, rate).alias("rate"))
    sinks.write_tables({"rows": every, "class_weights": weights, "rates": rates}, run)
    sinks.write_json_row(reports.composition(sampling.split_composition(every, classes)), f"{run}/split_composition.json")
    names = [r["label"] for r in classes.orderBy("class_id").collect()]  # a row per class
    return {"run": run, "classes": names, "sizes": sizes}


def evaluate(pred: DataFrame, rows: DataFrame, classes: DataFrame, prefix: str, out: str) -> dict[str, object]:
    """The artefacts of an evaluation, from predictions (row_id, y_true, y_pred, scores): AP by class, misclassified rows, and means."""
    from skygrid.operators import metrics

    n = classes.count()
    ap = metrics.average_precision(pred, n)
    by_class = reports.ap_per_class(ap, classes)
    sinks.write_text(by_class.select(F.to_json("ap").alias("value")), f"{out}/{prefix}_ap_per_class.json")
    wrong = reports.misclassified_rows(metrics.misclassified(pred), rows, classes)
    parts = sinks.document({}, [("rows", wrong.withColumnRenamed("row_id", "__id"))], "__id")
    marks = F.when(F.col("section") == -1, "").when(F.col("section") == 0, "[").when(F.col("section") == 2, "]").otherwise(F.col("value"))
    sinks.write_text(parts.withColumn("value", marks), f"{out}/{prefix}_misclassified.json", ["section", "at"])
    report = {r["label"]: r for r in metrics.class_report(metrics.confusion(pred, n)).collect()}
    values = by_class.first()["ap"]
    return {"macro_f1": report["macro avg"]["f1"], "map_macro": sum(values.values()) / max(1, len(values)), "n_samples": report["accuracy"]["support"]}


def write_summary(spark: SparkSession, path: str, **values: object) -> None:
    """A run's summary as one JSON document."""
    import json

    sinks.write_text(spark.createDataFrame([(json.dumps(values, indent=2),)], "value string"), path)
