"""Micro-fixtures for the annotation engine's operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygrid.functions import names as N
from skygrid.operators import distributions, grid, ids, metrics, raster, sampling, splits
from skygrid.sources import coco, sinks

BOX = "om long, det_idx long, x_min double, y_min double, x_max double, y_max double, species string"
CASES = [
    (500, (100, 100, 150, 140), [(0, 0, 100, 100, 50, 40, False)]),
    (500, (480, 100, 520, 140), [(0, 0, 480, 100, 20, 40, True), (500, 0, 0, 100, 20, 40, True)]),
    (500, (490, 490, 510, 510), [(0, 0, 490, 490, 10, 10, True), (0, 500, 490, 0, 10, 10, True), (500, 0, 0, 490, 10, 10, True), (500, 500, 0, 0, 10, 10, True)]),
    (500, (500, 500, 520, 520), [(500, 500, 0, 0, 20, 20, False)]),
    (500, (499, 0, 501, 1), []),
    (500, (10, 10, 12, 12), [(0, 0, 10, 10, 2, 2, False)]),
    (500, (10, 10, 11.75, 12), []),
    (500, (-20, -10, 30, 40), [(0, 0, 0, 0, 30, 40, True)]),
    (500, (9990, 9990, 10010, 10010), [(9500, 9500, 490, 490, 10, 10, True)]),
    (512, (9800, 100, 9850, 150), []),
    (512, (9720, 100, 9850, 150), [(9216, 0, 504, 100, 8, 50, True)]),
    (500, (30, 40, 10, 20), [(0, 0, 30, 40, -20, -20, False)]),
    (500, (30, 20, 10, 40), []),
    (500, (10, 10, 10, 50), []),
    (500, (0, 0, 1500, 20), [(x, 0, 0, 0, 500, 20, True) for x in (0, 500, 1000)]),
    (500, (510, 510, 490, 490), []),
    (500, (None, 0, 10, 10), []),
]


@pytest.mark.parametrize("size", [500, 512])
def test_box_by_tile(spark, size):
    own = [(i, b, e) for i, (s, b, e) in enumerate(CASES) if s == size]
    rows = spark.createDataFrame([(1, i, *[None if v is None else float(v) for v in b], "a") for i, b, _ in own], BOX)
    images = spark.createDataFrame([(1, 10000, 10000)], "om long, width long, height long")
    got = {}
    for r in grid.tile_join(rows, images, size).collect():
        got.setdefault(r.det_idx, []).append((r.tile_x, r.tile_y, r.x, r.y, r.w, r.h, r.is_clipped))
    assert {k: sorted(v) for k, v in got.items()} == {i: sorted(e) for i, _, e in own if e}


def test_join_has_no_nested_loop(spark):
    rows = spark.createDataFrame([], BOX)
    images = spark.createDataFrame([(1, 10000, 10000)], "om long, width long, height long")
    plan = grid.tile_join(rows, images, 500)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ids_of_more_than_999_images(spark):
    """Ids keep all digits of the number that image_name prints, so no two images share one."""
    rows = spark.createDataFrame([(i,) for i in (1, 99, 100, 999, 1000, 1001, 56470)], "i int")
    own = rows.withColumn("om_id", N.image_id_of(N.image_name(F.col("i"), F.lit("20250510 10k-03-11.jpg"))))
    got = own.select("i", "om_id", N.image_number(F.col("om_id")).alias("number"), N.image_number(F.lit("foo")).alias("none")).collect()
    assert all((r.om_id, r.number, r.none) == (f"OM_{r.i:03d}", r.i, None) for r in got)


def test_prepare_more_than_999_images(spark, tmp_path):
    """Against the SQL, with as many suppliers as make numbers of four digits."""
    import duckdb

    from skygrid.plans.queries import ORACLE_SQL, QUERIES

    spark.range(1, 1401).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(5000).select((F.col("id") % 1300 + 1).alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("supplier", "lineitem"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["q_prepare"](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL['q_prepare']}) order by idx").fetchall()
    assert len(want) > 1000 and [tuple(r) for r in got.orderBy("idx").collect()] == want


def test_tiling_stats(spark):
    images = spark.createDataFrame([(1, 10000, 10000), (2, 10000, 10000)], "om long, width long, height long")
    rows = spark.createDataFrame([(1, 1, 480.0, 100.0, 520.0, 140.0, "a"), (1, 2, 10.0, 10.0, 20.0, 20.0, None)], BOX)
    got = {r.om: r.asDict() for r in grid.tiling_stats(images, grid.tile_join(rows, images, 512), 512).collect()}
    assert got[1] | {"om": 1} == dict(om=1, total_tiles=361, dropped_edge_tiles=39, total_annotations=3, clipped_boxes=2, empty_tiles=359, tiles_with_partial_boxes=2)
    assert got[2]["empty_tiles"] == 361


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    for given, want in (("OM_001_2025.jpg", "OM_001"), ("foo.bar.jpg", "foo.bar"), ("xOM_001.jpg", "xOM_001")):
        assert one(N.image_id_of(F.lit(given))) == want
    assert one(grid.tile_name(F.lit(1), F.lit(123456), F.lit(5))) == "OM_001_123456_00005.png"
    order = ["10k-2-9", "10k-2-10", "10k-10-1", "x"]
    rows = spark.createDataFrame([(f"20250510 {x}.jpg",) for x in sorted(order)], "n string")
    assert [r.n[9:-4] for r in rows.orderBy(N.source_row(F.col("n")), N.source_col(F.col("n"))).collect()] == order
    assert one(N.crop_path(F.lit("crops\\X\\a.png"), "/d")) == "/d/X/a.png"
    assert one(N.elapsed(F.lit(3725.9))) == "1:02:05"
    assert N.run_name("swin", 30, 1e-4, 0.01) == "swin_ep30_lr0100_wd0100"


@pytest.mark.parametrize(
    "box,want",
    [
        ((100, 100, 40, 20), (90, 95, 150, 125)),
        ((0, 0, 10, 10), (0, 0, 12, 12)),
        ((495, 495, 5, 5), (493, 493, 500, 500)),
        ((3.9, 3.9, 2.5, 2.5), (3, 3, 7, 7)),
        ((0, 0, 0.5, 0.5), None),
        ((30, 40, -20, -20), None),
        ((10, 10, -20, -20), None),
    ],
)
def test_crop_window(spark, box, want):
    w = N.crop_window(*[F.lit(float(v)) for v in box], F.lit(500), F.lit(500))
    got = spark.range(1).select(w.alias("w")).first().w
    assert (tuple(got) if got else None) == want


def test_merge_offsets_and_unknown(spark):
    images = spark.createDataFrame([("a", 400), ("a", 1), ("c", 400), ("d", 5)], "file string, image_id long")
    cats = spark.createDataFrame([("a", 1, "x"), ("c", 1, "y")], "file string, category_id long, name string")
    ann = spark.createDataFrame([("a", 1, 400, 1), ("c", 1, 400, 1), ("d", 1, 5, 9), ("d", 0, 5, 9), ("b", 0, 1, 1)], "file string, pos long, image_id long, category_id long")
    got = sorted(tuple(r) for r in ids.merge_bundles(images, ann, cats).collect())
    assert got == [("a", 1, 400, 1, 1, "x"), ("c", 1, 800, 2, 2, "y"), ("d", 0, 805, 3, 0, "UNKNOWN"), ("d", 1, 805, 4, 0, "UNKNOWN")]
    assert ids.orphans(ann, images).count() == 1


def test_mode_tie_and_medians(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate("ABBA")], "om long, det_idx long, species string")
    got = distributions.image_summary(spark.createDataFrame([(1,), (2,)], "om long"), rows).orderBy("om").collect()
    assert [tuple(r) for r in got] == [(1, 4, 2, "A"), (2, 0, 0, "N/A")]
    m = distributions.medians(spark.createDataFrame([(v,) for v in (1, 2, 3, 10)], "n long")).first()
    assert tuple(m) == (2.5, 3, 2)


@pytest.mark.parametrize("n,want", [(9600, (7680, 960, 960)), (8800, (7040, 880, 880)), (7, (5, 0, 2))])
def test_split_sizes(spark, n, want):
    tiles = spark.range(n).withColumnRenamed("id", "image_id")
    a = splits.random_splits(tiles, spark.createDataFrame([(0,)], "iteration long"))
    got = {r.split: r["count"] for r in a.groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in splits.SPLITS) == want
    assert tuple(splits.split_invariants(a, tiles).first()) == (n, 0, 0)


def test_caps_and_groups(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["a", "a", "a", "b", None])], "row_id long, label string")
    key = lambda i: N.portable_key(i, F.lit(0).cast("long"))
    got = sorted(r.label for r in sampling.cap_per_class(rows, 2, key).collect())
    assert got == ["a", "a", "b"]
    many = spark.createDataFrame([(i, "zyx"[i % 3]) for i in range(30)] + [(99, None)], "row_id long, label string")
    got = sampling.merge_groups(many, [["z", "x", "y"]], 10, key).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"x_y_z": 9, None: 1}
    w = sampling.class_weights(spark.createDataFrame([("a", 1), ("b", 3)], "label string, n long"))
    assert {r.label: r.weight for r in w.collect()} == {"a": 1.5, "b": 0.5}


def test_weighted_sample(spark):
    rows = spark.createDataFrame([(i, 9.0 if i == 3 else 1.0) for i in range(10)], "row_id long, weight double")
    got = sampling.weighted_sample(rows, 2000).groupBy("row_id").count().collect()
    n = {r.row_id: r["count"] for r in got}
    assert sum(n.values()) == 2000 and 850 < n[3] < 1150


def test_metrics(spark):
    pred = spark.createDataFrame([(0, [0.9, 0.1]), (0, [0.6, 0.4]), (1, [0.65, 0.35]), (1, [0.2, 0.8])], "y_true int, scores array<double>")
    ap = {r.class_id: r.ap for r in metrics.average_precision(pred, 2).collect()}
    assert ap[1] == pytest.approx(0.8333333333)
    p = pred.withColumn("y_pred", metrics.arg_max(F.col("scores")))
    rep = {r.label: r for r in metrics.class_report(metrics.confusion(p, 3)).collect()}
    assert rep["2"].f1 == 0 and rep["accuracy"].f1 == 0.75 and rep["1"].precision == 1.0
    s = pred.select(metrics.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("s")).first().s
    assert s == [0.5, 0.5]


def test_lr(spark):
    lr = {r.e: r.lr for r in spark.range(1, 31).select(F.col("id").alias("e"), N.lr_at(F.col("id"), 30, 10, 1e-4).alias("lr")).collect()}
    for e, want in ((1, 1e-5), (10, 1e-4), (20, 5e-5), (30, 0)):
        assert lr[e] == pytest.approx(want, abs=1e-12)


def test_score_of_a_known_split(spark):
    counts = spark.createDataFrame([(0, "a", 80, 10, 10), (0, "b", 10, 0, 0)], "iteration long, species string, train long, val long, test long")
    got = splits.score_splits(counts).first()
    g = (100 / 110, 10 / 110)
    dist = sum(abs(p - q) for s in ((80 / 90, 10 / 90), (1, 0), (1, 0)) for p, q in zip(s, g))
    assert got.distribution_score == pytest.approx(dist) and got.missing_penalty == pytest.approx(4 * math.sqrt(g[1]))
    assert got.imbalance_penalty == pytest.approx(0.5 * (abs(90 / 110 - 0.8) + 2 * abs(10 / 110 - 0.1)))


def test_sources_and_sinks(spark, tmp_path):
    det = {"bbox": [1.0, 2.0, 3.0, 4.0], "score": 0.5, "tcws_species": None}
    doc = {"images": [{"file_name": "a", "detections": []}, {"file_name": "b"}, {"file_name": "a", "width": 5, "detections": [det]}]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    got = {r.file_name: (r.width, r.height, len(r.detections)) for r in coco.read_master(spark, str(tmp_path / "m.json")).collect()}
    assert got == {"a": (5, 10000, 1), "b": (10000, 10000, 0)}
    first = coco.read_image_annotations(spark, str(tmp_path / "m.json"), "a").first()
    assert first.detections == []
    b = coco.boxes(coco.read_master(spark, str(tmp_path / "m.json")), "file_name").first()
    assert (b.det_idx, b.x_max, b.species) == (1, 3.0, "UNKNOWN")
    (tmp_path / "l.json").write_text('{"x": "B", "y": "A", "z": "B"}')
    labels = coco.read_label_map(spark, str(tmp_path / "l.json"))
    assert {r.label: r.class_id for r in coco.class_list(labels).collect()} == {"A": 0, "B": 1}
    cat = spark.createDataFrame([("p", "s", "t", "o", "[1.0, 2.0]", 7)], coco.CATALOG)
    sinks.write_catalog(cat, str(tmp_path / "c"))
    assert coco.read_catalog(spark, str(tmp_path / "c")).collect() == cat.collect()
    with pytest.raises(Exception):
        sinks.write_catalog(cat, str(tmp_path / "c"))
    img = spark.createDataFrame([(1, "f", 5, 5, "OM_001", 0, 0)], "id long, file_name string, width int, height int, orthomosaic_id string, tile_x int, tile_y int")
    ann = spark.createDataFrame([(1, 1, 1, [0.0, 1.0, 2.0, 3.0], 6.0, 0)], "id long, image_id long, category_id long, bbox array<double>, area double, iscrowd int")
    sinks.write_coco(img, ann, spark.createDataFrame([(1, "x")], "id long, name string"), str(tmp_path / "coco"), {"version": "1.0", "tile_size": 500})
    i, a, c = coco.read_coco(spark, str(tmp_path / "coco"))
    assert i.count() == a.count() == c.count() == 1 and a.first().bbox == [0.0, 1.0, 2.0, 3.0]
    line = sinks.fixed_width(spark.createDataFrame([("abcdef", 12345)], "a string, n long"), {"a": 4, "n": 8}).first().value
    assert line == "abcd  12,345"


def test_raster(spark):
    img = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    rows = spark.createDataFrame([(1, 4, 6, img.tobytes()), (2, 4, 6, None)], "om long, height int, width int, data binary")
    got = {(r.tile_x, r.tile_y): r.data for r in raster.slice_tiles(rows, 2).collect()}
    assert len(got) == 6 and bytes(got[4, 2]) == img[2:4, 4:6].tobytes()
    assert (raster.area_resize(np.full((7, 5, 3), 9, np.uint8), 3, 4) == 9).all()
    assert raster.area_resize(img, 2, 3)[0, 0, 0] == round(img[:2, :2, 0].mean())
    assert not raster.crop(None, (0, 0, 1, 1)).any() and raster.fit_square(img, 8).shape == (8, 8, 3)
    assert raster.to_tensor(img).shape == (3, 4, 6)
