"""The stages from files to files, on two small images."""

import csv
import datetime
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygrid import __main__ as cli
from skygrid.functions import names as N
from skygrid.operators import distributions, raster, reports
from skygrid.plans import stages
from skygrid.sources import coco, rasters, sinks

NAMES = ["20250510 10k-02-10.jpg", "20250510 10k-02-9.jpg"]


def det(box, species):
    return {"bbox": box, "score": 0.5, "tcws_species": species}


BOXES = {
    NAMES[0]: [det([10.0, 10.0, 40.123, 30.456], "ROTE"), det([240.0, 10.0, 260.0, 30.0], "SATE")],
    NAMES[1]: [det([5.0, 5.0, 25.0, 25.0], "SATE"), det([300.0, 300.0, 310.0, 330.0], "SATE"), {"bbox": [400.0, 10.0, 420.0, 30.0]}],
}


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    (base / "src").mkdir()
    (base / "samples").mkdir()
    (base / "samples" / "note.txt").write_text("a sample")
    rng = np.random.default_rng(1)
    pixels = {n: rng.integers(0, 256, (500, 600, 3)).astype(np.uint8) for n in NAMES}
    for n, img in pixels.items():
        (base / "src" / n).write_bytes(rasters.encode_png(img))
    (base / "src" / "DJI_0001.jpg").write_bytes(b"not listed")
    entries = [{"file_name": n, "width": 600, "height": 500, "detections": b} for n, b in BOXES.items()]
    (base / "master.json").write_text(json.dumps({"images": [{"file_name": NAMES[0], "detections": []}, *entries]}))
    out = f"{base}/data"
    rows = stages.prepare(spark, f"{base}/src", f"{base}/master.json", out, f"{base}/samples", datetime.date(2025, 5, 10)).collect()
    stats, failed = stages.tile_all(spark, out, f"{base}/tiles", 250)
    return base, pixels, rows, {r.om: r for r in stats.collect()}, failed


def test_prepare(spark, work):
    base, pixels, rows, _, _ = work
    assert [(r.om, r.src, r.n) for r in sorted(rows)] == [(1, NAMES[1], 3), (2, NAMES[0], 2)]
    assert sorted(os.listdir(base / "data" / "images")) == ["OM_001_20250510_10k-02-9.jpg", "OM_002_20250510_10k-02-10.jpg"]
    one = json.loads((base / "data" / "annotations" / "OM_002_annotations.json").read_text())
    assert one["image"]["width"] == 600 and [d["bbox"] for d in one["annotations"]] == [d["bbox"] for d in BOXES[NAMES[0]]]
    every = json.loads((base / "data" / "annotations" / "all_annotations.json").read_text())
    assert [i["file_name"][:6] for i in every["images"]] == ["OM_001", "OM_002"] and len(every["images"][0]["detections"]) == 3
    text = (base / "data" / "metadata" / "CO-DETR - Master Summary 20250510.txt").read_text().splitlines()
    assert text[0] == "Images loaded : 2" and text[4] == f"| {'Image Name':<28} | {'Masks':>7} |  ROTE    SATE    UNKN   |"
    assert text[5] == "| OM_001_20250510_10k-02-9.jpg |       3 |       0       2       1 |" and text[-1] == "Total birds : 5" and f"{'SATE':<8} : {3:>10,} " in text
    assert (base / "data" / "samples" / "note.txt").read_text() == "a sample"
    with pytest.raises(FileExistsError):
        stages.prepare(spark, f"{base}/src", f"{base}/master.json", f"{base}/data")
    with pytest.raises(FileNotFoundError):
        stages.prepare(spark, f"{base}/nowhere", f"{base}/master.json", f"{base}/data2")


def test_tiles(spark, work):
    base, pixels, _, stats, failed = work
    assert failed == 0 and stats[1].total_tiles == 4 and stats[1].dropped_edge_tiles == 2 and stats[1].total_annotations == 3 and stats[2].clipped_boxes == 2
    name = "OM_002_00250_00000.png"
    got = rasters.read_rasters(spark, f"{base}/tiles/OM_002/tiles/{name}").first()
    assert (np.frombuffer(got.data, np.uint8).reshape(250, 250, 3) == pixels[NAMES[0]][:250, 250:500]).all()
    doc = json.loads((base / "tiles" / "OM_002" / "annotations.json").read_text())
    assert list(doc) == ["info", "categories", "images", "annotations"] and doc["info"]["source_dimensions"] == "600x500"
    assert doc["annotations"][0]["bbox"] == [10.0, 10.0, 30.12, 20.46] and doc["annotations"][0]["area"] == round(30.123 * 20.456, 2)
    assert [a["id"] for a in doc["annotations"]] == [1, 2, 3] and [i["id"] for i in doc["images"]] == [1, 2, 3, 4]
    assert json.loads((base / "tiles" / "OM_002" / "tiling_diagnostics.json").read_text())["image_size"] == "600x500"
    merged = json.loads((base / "tiles" / "all_annotations.json").read_text())
    assert [i["id"] for i in merged["images"]] == list(range(1, 9)) and merged["images"][4]["file_name"].startswith("OM_002/tiles/OM_002_")
    assert [a["id"] for a in merged["annotations"]] == list(range(1, 7)) and merged["info"]["num_orthomosaics"] == 2
    with pytest.raises(ValueError):
        stages.tile(spark, f"{base}/src/{NAMES[0]}", f"{base}/master.json", f"{base}/x", 0)
    one = stages.tile(spark, f"{base}/src/{NAMES[0]}", f"{base}/master.json", f"{base}/one", 250)
    assert one.first().total_annotations == 0  # the first entry of a repeated name


def test_split_and_summaries(spark, work):
    base = work[0]
    best = stages.split(spark, None, f"{base}/tiles/all_annotations.json", f"{base}/split", iterations=20, seed=3)
    meta = json.loads((base / "split" / "split_metadata.json").read_text())
    assert meta["best_score"] == best["best_score"] and meta["iterations"] == 20
    ids = sum((meta[f"{s}_image_ids"] for s in ("train", "val", "test")), [])
    assert sorted(ids) == list(range(1, 9)) and meta["train_image_ids"] == sorted(meta["train_image_ids"])
    assert meta["split_sizes"]["train_tiles"] == 6 and sum(meta["split_sizes"][f"{s}_annotations"] for s in ("train", "val", "test")) == 6
    total = 0
    for s in ("train", "val", "test"):
        doc = json.loads((base / "split" / f"{s}_annotations.json").read_text())
        lines = (base / "split" / f"{s}_tiles.txt").read_text().split()
        assert "info" not in doc and [i["id"] for i in doc["images"]] == list(range(1, len(lines) + 1)) and [i["file_name"] for i in doc["images"]] == lines
        assert {a["image_id"] for a in doc["annotations"]} <= {i["id"] for i in doc["images"]}
        total += len(doc["annotations"])
    assert total == 6
    report = (base / "split" / "split_report.txt").read_text().splitlines()
    assert report[1] == "DATASET SPLIT REPORT" and f"Final score: {best['best_score']:.4f}" in report
    tables = stages.split_eda(spark, f"{base}/split", f"{base}/eda", 250)
    assert {(r.om, r.column, r.row) for r in tables["split_map"].collect()} == {(f"OM_00{k}", x, y) for k in (1, 2) for x in (0, 1) for y in (0, 1)}
    stages.image_eda(spark, f"{base}/data/annotations", f"{base}/eda")
    assert list(csv.DictReader(open(base / "eda" / "om_summary.csv")))[0] == {"orthomosaic": "OM_001", "total_annotations": "3", "num_species": "2", "top_species": "SATE"}
    assert {r.species: r.n for r in stages.species_eda(spark, "annotations", f"{base}/tiles/all_annotations.json", f"{base}/eda2").collect()} == {"SATE": 4, "ROTE": 1, "UNKNOWN": 1}
    assert stages.tiled_eda(spark, f"{base}/tiles/all_annotations.json", f"{base}/eda3").first().tiles == 8


def test_crops(spark, work):
    base = work[0]
    got = stages.crop(spark, f"{base}/tiles/all_annotations.json", f"{base}/tiles", f"{base}/crops", size=32)
    assert got == {"total_crops": 6, "num_species": 3, "total_skipped": 0}
    rows = list(csv.DictReader(open(base / "crops" / "annotations.csv")))
    assert [r["annotation_id"] for r in rows] == ["1", "2", "3", "4", "5", "6"] and rows[0]["bbox_coco"].startswith("[")
    for r in rows:
        one = rasters.read_rasters(spark, f"{base}/crops/{r['crop_path']}").first()
        assert (one.height, one.width) == (32, 32) and np.frombuffer(one.data, np.uint8).any()
    (base / "labels").mkdir()
    (base / "labels" / "label_mapping.json").write_text(json.dumps({"ROTE": "tern", "SATE": "tern2"}))
    with pytest.raises(FileNotFoundError):
        coco.read_split_config(spark, f"{base}/labels/label_mapping.json")
    for s in ("train", "val", "test"):
        with open(base / "labels" / f"{s}.csv", "w") as f:
            w = csv.DictWriter(f, [*rows[0], "remapped_label"])
            w.writeheader()
            w.writerows(r | {"remapped_label": "tern" if r["species_name"] == "ROTE" else "tern2"} for r in rows)
    run = stages.train_inputs(spark, f"{base}/labels/label_mapping.json", f"{base}/crops", f"{base}/runs", cap=2)
    assert run["classes"] == ["tern", "tern2"] and run["sizes"] == {"train": 3, "val": 2, "test": 2}
    assert json.loads(open(f"{run['run']}/split_composition.json").read())["train"] == {"tern": 1, "tern2": 2}
    chosen = stages.crop(spark, f"{base}/tiles/all_annotations.json", f"{base}/tiles", f"{base}/crops2", size=16, species=["ROTE"])
    assert chosen["total_crops"] == 1


def test_command_line(spark, work, monkeypatch):
    base = work[0]
    a = cli.parser().parse_args(["merge", "-i", f"{base}/tiles", "-o", f"{base}/again.json"])
    assert a.tile_size == 500
    cli.run(spark, a)
    assert len(json.loads((base / "again.json").read_text())["images"]) == 8
    assert cli.parser().parse_args(["split", "-a", "x", "-o", "y"]).iterations == 3000
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["species-eda", "--annotations-json", "a", "--csv-path", "b", "--output", "c"])


def test_evaluation_artefacts(spark, tmp_path):
    pred = spark.createDataFrame([(1, 0, 0, [0.9, 0.1]), (2, 0, 1, [0.4, 0.6]), (3, 1, 1, [0.2, 0.8])], "row_id long, y_true int, y_pred int, scores array<double>")
    rows = spark.createDataFrame([(1, "a.png"), (2, "b.png"), (3, "c.png")], "row_id long, crop_path string")
    classes = spark.createDataFrame([("x", 0), ("y", 1)], "label string, class_id long")
    got = stages.evaluate(pred, rows, classes, "val", str(tmp_path))
    assert got["n_samples"] == 3 and got["macro_f1"] == pytest.approx(2 / 3)
    assert json.loads((tmp_path / "val_misclassified.json").read_text()) == [{"crop_path": "b.png", "true_label": "x", "predicted_label": "y", "true_class_conf": 0.4, "predicted_class_conf": 0.6}]
    assert json.loads((tmp_path / "val_ap_per_class.json").read_text()) == {"x": 1.0, "y": 1.0}
    stages.write_summary(spark, f"{tmp_path}/summary.json", epochs=3)
    assert json.loads((tmp_path / "summary.json").read_text()) == {"epochs": 3}
    with pytest.raises(FileExistsError):
        stages.write_summary(spark, f"{tmp_path}/summary.json", epochs=3)


def test_png_and_unreadable_files(spark, tmp_path):
    img = np.random.default_rng(0).integers(0, 256, (7, 5, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(rasters.encode_png(img))
    (tmp_path / "b.png").write_bytes(b"nothing")
    got = {r.file_name: r for r in rasters.read_rasters(spark, str(tmp_path)).collect()}
    assert (np.frombuffer(got["a.png"].data, np.uint8).reshape(7, 5, 3) == img).all() and got["b.png"].data is None
    files = spark.createDataFrame([("f/x.bin", b"1"), ("f/y.bin", b"22")], "path string, data binary")
    rasters.write_files(files, str(tmp_path))
    assert sorted(os.listdir(tmp_path / "f")) == ["x.bin", "y.bin"] and (tmp_path / "f" / "y.bin").read_bytes() == b"22"


def test_augmentation():
    img = np.random.default_rng(0).integers(0, 256, (60, 80, 3)).astype(np.uint8)
    assert (raster.shift_scale_rotate(img, 0, 0, 1, 0) == img).all()
    turned = raster.shift_scale_rotate(img[:60, :60], 0, 0, 1, 90)
    assert (turned == np.rot90(img[:60, :60], 1)).all() or (turned == np.rot90(img[:60, :60], -1)).all()
    assert (raster.colour_jitter(img, 1, 1, 1, 0) == img).all()
    grey = raster.colour_jitter(img, 1, 1, 0, 0).astype(int)
    assert np.ptp(grey, axis=2).max() == 0
    rng = np.random.default_rng(1)
    assert raster.random_resized_crop(img, 32, rng).shape == (32, 32, 3) and (raster.coarse_dropout(img + 1, rng) == 0).any()
    for train in (True, False):
        chain = raster.transform(32, train)
        assert chain(img, 5).shape == (3, 32, 32) and (chain(img, 5) == chain(img, 5)).all()
    assert (raster.transform(32, False)(img, 1) == raster.transform(32, False)(img, 2)).all()


def test_small_operators(spark):
    row = spark.createDataFrame([("OM_001", "a.png", None, "", "b")], "om string, f string, n string, e string, v string")
    day = F.to_date(F.lit("2025-05-10"))
    got = row.select(N.tile_path(F.col("om"), F.col("f")).alias("p"), N.present(", ", F.col("n"), F.col("e"), F.col("v"), F.col("f")).alias("j"), N.date_stamp(day).alias("d"), N.portable_key(F.lit(9 * 10**12), F.lit(1)).alias("k")).first()
    assert (got.p, got.j, got.d) == ("OM_001/tiles/a.png", "b, a.png", "05102025") and got.k >= 0
    counts = spark.createDataFrame([("a", 3, 2, 1)], "species string, train long, val long, test long")
    assert {(r.split, r.n, r.base) for r in distributions.stacked(counts).collect()} == {("train", 3, 0), ("val", 2, 3), ("test", 1, 5)}
    tiles = spark.createDataFrame([("a", c) for c in (1, 2, 2, 5, 9, 0)] + [("b", 4)], "split string, c long")
    v = distributions.violin(tiles, points=50).orderBy("x").collect()
    own = [r for r in v if r.split == "a"]
    data = np.array([1, 2, 2, 5, 9.0])
    h = data.std(ddof=1) * len(data) ** -0.2
    want = [np.exp(-(((x - data) / h) ** 2) / 2).sum() / (len(data) * h * np.sqrt(2 * np.pi)) for x in np.linspace(1, 9, 50)]
    assert [r.density for r in own] == pytest.approx(want) and own[0].median == 2 and {r.density for r in v if r.split == "b"} == {None}
    rows = spark.range(10).withColumnRenamed("id", "row_id")
    first = [r.row_id for r in reports.epoch_order(rows, 1, 1).collect()]
    assert sorted(first) == list(range(10)) and first != [r.row_id for r in reports.epoch_order(rows, 1, 2).collect()]
    assert reports.first_warnings(rows, ["row_id"], 3).count() == 3 and reports.peek(rows, 4).count() == 4
    assert [r.value for r in sinks.document({"a": 1}, [("l", rows.limit(0).withColumnRenamed("row_id", "id"))]).orderBy("section", "at").collect()] == ["{", '"a": 1,', '"l": [', "]}"]
