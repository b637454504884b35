"""Command line of the annotation engine: python -m skygrid <command>."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skygrid.functions.names import elapsed
from skygrid.plans import stages

log = logging.getLogger("skygrid")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="python -m skygrid", description=__doc__)
    out.add_argument("--log-file", help="append the log to a file as well")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        return sub.add_parser(name, help=text, description=text)

    p = command("prepare", "number, copy and annotate source images")
    p.add_argument("images_dir")
    p.add_argument("annotations_json")
    p.add_argument("--output-dir", default="data")
    p.add_argument("--samples-dir")
    p = command("tile", "tile one image")
    p.add_argument("-i", "--image", required=True)
    p.add_argument("-a", "--annotations", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-t", "--tile-size", type=int, default=512)
    p = command("tile-all", "tile all images of a prepared data set and merge them")
    p.add_argument("--dataset-dir", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--tile-size", type=int, default=500)
    p = command("merge", "merge the annotations of all images")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-t", "--tile-size", type=int, default=500)
    p = command("split", "search for the best partition of the tiles")
    p.add_argument("-t", "--tiles-dir")
    p.add_argument("-a", "--annotations", required=True)
    p.add_argument("-n", "--iterations", type=int, default=3000)
    p.add_argument("-s", "--seed", type=int, default=42)
    p.add_argument("-o", "--output", required=True)
    p = command("crop", "crop annotations out of tiles")
    p.add_argument("--json", required=True)
    p.add_argument("--tile-dir", required=True)
    p.add_argument("--output-dir", default="crops")
    p.add_argument("--pad-frac", type=float, default=0.25)
    p.add_argument("--size", type=int, default=224)
    p.add_argument("--species", nargs="*")
    p = command("species-eda", "counts by species")
    one = p.add_mutually_exclusive_group(required=True)
    for name in ("annotations-json", "crops-json", "csv-path"):
        one.add_argument(f"--{name}")
    p.add_argument("--output", required=True)
    p.add_argument("--threshold", type=int, default=50)
    p = command("image-eda", "summary of each image")
    p.add_argument("--annotations-dir", required=True)
    p.add_argument("--output", required=True)
    p = command("tiled-eda", "summary of a tiled data set")
    p.add_argument("--annotations", required=True)
    p.add_argument("--output", required=True)
    p = command("split-eda", "chart data of a split")
    p.add_argument("--splits-dir", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--tile-size", type=int, default=500)
    p = command("train-inputs", "rows, weights and rates for a classifier's training; the network is not part of this engine")
    p.add_argument("--label-mapping", required=True)
    p.add_argument("--image-root", required=True)
    p.add_argument("--epochs", type=int, default=30)
    p.add_argument("--lr", type=float, default=1e-4)
    p.add_argument("--weight-decay", type=float, default=1e-4)
    p.add_argument("--warmup-epochs", type=int, default=10)
    p.add_argument("--cap", type=int)
    p.add_argument("--out-dir", default="runs")
    p = command("all", "prepare, tile, split, summaries and crops")
    p.add_argument("--images-dir", required=True)
    p.add_argument("--annotations", required=True)
    p.add_argument("--output-dir", default="data")
    p.add_argument("--tile-size", type=int, default=500)
    p.add_argument("--iterations", type=int, default=5000)
    p.add_argument("--seed", type=int, default=42)
    return out


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "prepare":
        rows = stages.prepare(spark, a.images_dir, a.annotations_json, a.output_dir, a.samples_dir)
        log.info("%d images under %s", rows.count(), a.output_dir)
    elif a.command == "tile":
        log.info("%s", stages.tile(spark, a.image, a.annotations, a.output, a.tile_size).first())
    elif a.command == "tile-all":
        _, failed = stages.tile_all(spark, a.dataset_dir, a.output_dir, a.tile_size)
        log.info("tiled; %d images without annotations", failed)
    elif a.command == "merge":
        stages.merge(spark, a.input, a.output, a.tile_size)
    elif a.command == "split":
        log.info("%s", stages.split(spark, a.tiles_dir, a.annotations, a.output, a.iterations, a.seed))
    elif a.command == "crop":
        log.info("%s", stages.crop(spark, a.json, a.tile_dir, a.output_dir, a.pad_frac, a.size, a.species))
    elif a.command == "species-eda":
        source = "annotations" if a.annotations_json else "crops" if a.crops_json else "csv"
        stages.species_eda(spark, source, a.annotations_json or a.crops_json or a.csv_path, a.output, a.threshold)
    elif a.command == "image-eda":
        stages.image_eda(spark, a.annotations_dir, a.output)
    elif a.command == "tiled-eda":
        stages.tiled_eda(spark, a.annotations, a.output)
    elif a.command == "split-eda":
        stages.split_eda(spark, a.splits_dir, a.output, a.tile_size)
    elif a.command == "train-inputs":
        log.info("%s", stages.train_inputs(spark, a.label_mapping, a.image_root, a.out_dir, a.epochs, a.warmup_epochs, a.lr, a.weight_decay, a.cap))
    else:
        out = a.output_dir
        stages.prepare(spark, a.images_dir, a.annotations, f"{out}/dataset")
        stages.tile_all(spark, f"{out}/dataset", f"{out}/tiles", a.tile_size)
        stages.split(spark, None, f"{out}/tiles/all_annotations.json", f"{out}/splits", a.iterations, a.seed)
        stages.image_eda(spark, f"{out}/dataset/annotations", f"{out}/eda")
        stages.species_eda(spark, "annotations", f"{out}/tiles/all_annotations.json", f"{out}/eda")
        stages.tiled_eda(spark, f"{out}/tiles/all_annotations.json", f"{out}/eda")
        stages.split_eda(spark, f"{out}/splits", f"{out}/eda/splits", a.tile_size)
        stages.crop(spark, f"{out}/tiles/all_annotations.json", f"{out}/tiles", f"{out}/crops")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if a.log_file:
        handlers.append(logging.FileHandler(a.log_file))
    logging.basicConfig(level=logging.WARNING, format="%(asctime)s %(message)s", handlers=handlers, force=True)
    log.setLevel(logging.INFO)
    spark = SparkSession.builder.appName("skygrid").getOrCreate()
    began = time.time()
    run(spark, a)
    log.info("done in %s", spark.range(1).select(elapsed(F.lit(time.time() - began))).first()[0])


if __name__ == "__main__":
    main()
