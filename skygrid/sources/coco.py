"""Readers of detection and annotation files under declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DETECTION = "struct<bbox:array<double>,score:double,category_id:bigint,category_name:string,tcws_species:string,segmentation:array<array<double>>>"
MASTER = f"images array<struct<file_name:string,width:int,height:int,detections:array<{DETECTION}>>>"
SINGLE = f"image struct<file_name:string,width:int,height:int>, annotations array<{DETECTION}>"
EITHER = f"{SINGLE}, {MASTER}"
COCO = (
    "info struct<description:string,version:string,tile_size:int,source_image:string,source_dimensions:string,num_orthomosaics:int>, "
    "categories array<struct<id:bigint,name:string>>, "
    "images array<struct<id:bigint,file_name:string,width:int,height:int,orthomosaic_id:string,tile_x:int,tile_y:int>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,iscrowd:int>>"
)
CATALOG = "crop_path string, species_name string, source_tile string, orthomosaic_id string, bbox_coco string, annotation_id bigint"
SIDE = 10_000


def existing(spark: SparkSession, *paths: str) -> list[str]:
    """The files that the paths and globs name, by name; FileNotFoundError tells the first that names none."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(conf).globStatus(where)
        if not found:
            raise FileNotFoundError(path)
        out += sorted(f.getPath().toString() for f in found)
    return out


def read_json(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One row per file, with its path."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("file"))


def read_master(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_name, width, height, detections) of a master document; of repeated names the last entry wins."""
    rows = read_json(spark, path, MASTER).select("file", F.posexplode("images").alias("pos", "i")).where("i.file_name is not null")
    last = rows.groupBy("i.file_name").agg(F.max_by("i", F.struct("file", "pos")).alias("i"))
    width, height = F.coalesce("i.width", F.lit(SIDE)), F.coalesce("i.height", F.lit(SIDE))
    return last.select("i.file_name", width.alias("width"), height.alias("height"), F.coalesce("i.detections", F.array().cast(f"array<{DETECTION}>")).alias("detections"))


def read_image_annotations(spark: SparkSession, path: str | list[str], target: str | None = None, lenient: bool = False) -> DataFrame:
    """(file, detections) of documents in either form: ``annotations`` of one image, or the first of ``images`` named ``target``.

    A document with neither key is an error, or gives no detections if ``lenient``; so does a target that isn't there.
    """
    rows = read_json(spark, path, EITHER)
    first = F.get(F.filter("images", lambda i: i["file_name"] == F.lit(target)), F.lit(0))["detections"]
    empty = F.array().cast(f"array<{DETECTION}>")
    found = F.when(F.col("annotations").isNotNull(), F.col("annotations")).when(F.col("images").isNotNull(), F.coalesce(first, empty))
    return rows.select("file", found.otherwise(empty if lenient else F.raise_error(F.lit("neither annotations nor images"))).alias("detections"))


def read_om_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """(om_id, detections) of a folder's files OM_NNN_annotations.json, the key from the file's name; none for a document without any."""
    rows = read_image_annotations(spark, existing(spark, f"{folder}/OM_*_annotations.json"), lenient=True)
    name = F.element_at(F.split("file", "/"), -1)
    return rows.select(F.regexp_replace(name, "_annotations[.]json$", "").alias("om_id"), "detections")


def match_annotations(images: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images (file_name) with the detections of their id (om_id, detections), and one row with the number of those that have none."""
    from skygrid.functions.names import image_id_of

    own = images.withColumn("om_id", image_id_of(F.col("file_name")))
    return own.join(annotations, "om_id"), own.join(annotations, "om_id", "left_anti").agg(F.count("*").alias("failed"))


def boxes(detections: DataFrame, key: str = "om", default: str = "UNKNOWN") -> DataFrame:
    """(key, det_idx, x_min, y_min, x_max, y_max, species, score) from an array ``detections``, in its order."""
    rows = detections.select(key, F.posexplode("detections").alias("pos", "d"))
    corner = [F.get("d.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x_min", "y_min", "x_max", "y_max"))]
    return rows.select(key, (F.col("pos") + 1).cast("long").alias("det_idx"), *corner, F.coalesce("d.tcws_species", F.lit(default)).alias("species"), "d.score")


def read_coco(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of COCO files, each with its file and place in the list."""
    rows = read_json(spark, path, COCO)
    out = [rows.select("file", F.posexplode(c).alias("pos", "r")).select("file", "pos", "r.*") for c in ("images", "annotations", "categories")]
    return out[0], out[1], out[2]


def read_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Annotations of several COCO files with the name of their split."""
    own = [read_coco(spark, p)[1].withColumn("split", F.lit(s)) for s, p in paths.items()]
    out = own[0]
    for df in own[1:]:
        out = out.unionByName(df)
    return out


METADATA = (
    "seed int, iterations int, best_score double, score_details struct<distribution_score:double,missing_penalty:double,imbalance_penalty:double>, "
    "split_sizes struct<train_tiles:bigint,val_tiles:bigint,test_tiles:bigint,train_annotations:bigint,val_annotations:bigint,test_annotations:bigint>, "
    "missing_species struct<val:array<string>,test:array<string>>, train_image_ids array<bigint>, val_image_ids array<bigint>, test_image_ids array<bigint>"
)


def read_split_bundle(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of the three splits of a folder, with split, and its one row of metadata."""
    files = {s: existing(spark, f"{folder}/{s}_annotations.json")[0] for s in ("train", "val", "test")}
    tables: list[DataFrame | None] = [None, None, None]
    for split, path in files.items():
        for k, df in enumerate(read_coco(spark, path)):
            own = df.withColumn("split", F.lit(split))
            tables[k] = own if tables[k] is None else tables[k].unionByName(own)
    return tables[0], tables[1], tables[2], read_json(spark, existing(spark, f"{folder}/split_metadata.json"), METADATA).drop("file")


def read_split_config(spark: SparkSession, label_mapping: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """The label map, the class list and the catalogues train.csv, val.csv and test.csv, which must lie beside it."""
    folder = label_mapping.rsplit("/", 1)[0]
    existing(spark, label_mapping, *(f"{folder}/{s}.csv" for s in ("train", "val", "test")))
    mapping = read_label_map(spark, label_mapping)
    rows = {s: read_catalog(spark, f"{folder}/{s}.csv", ", remapped_label string") for s in ("train", "val", "test")}
    return mapping, class_list(mapping), rows


def read_catalog(spark: SparkSession, path: str | list[str], extra: str = "") -> DataFrame:
    """A crop catalogue; ``extra`` columns, as ", remapped_label string", follow its own."""
    return spark.read.schema(CATALOG + extra).option("header", True).option("escape", '"').csv(path)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(raw, label) of a flat JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("raw", "label"))


def class_list(label_map: DataFrame) -> DataFrame:
    """(label, class_id) of the distinct labels, ids from 0 by name."""
    w = Window.orderBy("label")  # a row per class
    return label_map.select("label").distinct().withColumn("class_id", (F.row_number().over(w) - 1).cast("long"))


def read_species_counts(spark: SparkSession, path: str) -> DataFrame:
    """(species, n) of a crop summary, most frequent first."""
    rows = read_json(spark, path, "total_crops bigint, total_skipped bigint, species_counts map<string,bigint>, num_species bigint")
    return rows.select(F.explode("species_counts").alias("species", "n")).orderBy(F.desc("n"), "species")


def list_rasters(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """(path, file_name, length) of image files, their contents unread."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")
