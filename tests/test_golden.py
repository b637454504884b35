"""Published results that the operators have to reproduce."""

import pytest
from pyspark.sql import functions as F

from skygrid.operators import metrics, reports, sampling, splits

# Annotations by species in train, val and test of two published splits.
FIRST = [
    ("ROTEA", 8308, 1079, 887), ("SATEA", 2912, 332, 308), ("BRPEC", 2021, 248, 234), ("LAGUA", 1227, 133, 133),
    ("BRPEA", 691, 72, 89), ("BLSKA", 162, 12, 15), ("TRHEA", 138, 16, 18), ("GREGA", 88, 13, 7),
    ("GREGC", 86, 10, 11), ("LWBBA", 55, 9, 5), ("RUTUA", 58, 5, 6), ("GBHEC", 48, 6, 6),
    ("WHIBA", 40, 4, 2), ("ROSPA", 23, 4, 5), ("OTHRA", 23, 2, 3), ("DCCOA", 21, 1, 3),
    ("GBHEA", 20, 4, 1), ("SNEGA", 8, 1, 2), ("AMAVA", 3, 1, 1), ("CATEA", 2, 0, 3),
    ("UNSURE", 4, 1, 0), ("ROSPC", 1, 0, 1), ("BLSTA", 0, 1, 0), ("REEGA", 0, 0, 1),
    ("REEGWM", 1, 0, 0),
]
SECOND = [
    ("ROTEA", 7279, 909, 912), ("SATEA", 2203, 298, 250), ("BRPEC", 2008, 257, 225), ("LAGUA", 1146, 149, 138),
    ("BRPEA", 657, 74, 88), ("TRHEA", 142, 12, 18), ("GREGC", 79, 19, 9), ("GREGA", 85, 11, 10),
    ("LWBBA", 53, 5, 11), ("GBHEC", 47, 9, 4), ("WHIBA", 35, 3, 7), ("MTRNS", 32, 5, 7),
    ("ROTEF", 33, 5, 6), ("RUTUA", 33, 6, 3), ("ROSPA", 28, 2, 2), ("OTHRA", 23, 3, 1),
    ("GBHEA", 22, 2, 1), ("DCCOA", 11, 5, 4), ("UNSURE", 8, 8, 3), ("BRPEF", 13, 0, 2),
    ("LAGUF", 8, 1, 2), ("SATEF", 9, 1, 1), ("SNEGA", 7, 3, 1), ("AMAVA", 4, 1, 0),
    ("CATEA", 2, 3, 0), ("DCCOF", 1, 2, 1), ("GREGF", 2, 0, 0), ("ROSPC", 1, 0, 1),
    ("WHIBF", 2, 0, 0), ("BNSTA", 1, 0, 0), ("NECOA", 0, 0, 1), ("REEGA", 1, 0, 0),
    ("REEGF", 1, 0, 0), ("REEGWMA", 1, 0, 0), ("RUTUF", 1, 0, 0),
]
# Species to training class.
LABELS = {
    "AMAVA": "OTHERS", "BLSKA": "BLSKA", "BLSTA": "OTHERS", "BRPEA": "BRPEA", "BRPEC": "BRPEC", "CATEA": "OTHERS",
    "DCCOA": "OTHERS", "GBHEA": "OTHERS", "GBHEC": "OTHERS", "GREGA": "LARGE_WHITE_BIRDS", "GREGC": "LARGE_WHITE_BIRDS", "LAGUA": "LAGUA",
    "LWBBA": "LARGE_WHITE_BIRDS", "OTHRA": "OTHERS", "REEGA": "LARGE_WHITE_BIRDS", "REEGWM": "LARGE_WHITE_BIRDS", "ROSPA": "OTHERS", "ROSPC": "OTHERS",
    "ROTEA": "ROTEA", "RUTUA": "OTHERS", "SATEA": "SATEA", "SNEGA": "LARGE_WHITE_BIRDS", "TRHEA": "OTHERS", "UNSURE": "OTHERS",
    "WHIBA": "LARGE_WHITE_BIRDS",
}
# Rows of each class in val and test, and wrong predictions (true, predicted, number).
SUPPORT = {
    "val": {"BLSKA": 19, "BRPEA": 85, "BRPEC": 250, "LAGUA": 149, "LARGE_WHITE_BIRDS": 34, "OTHERS": 42, "ROTEA": 1027, "SATEA": 355},
    "test": {"BLSKA": 19, "BRPEA": 86, "BRPEC": 251, "LAGUA": 150, "LARGE_WHITE_BIRDS": 35, "OTHERS": 44, "ROTEA": 1028, "SATEA": 356},
}
WRONG = {
    "val": [
        ("BLSKA", "BRPEA", 1), ("BRPEA", "BRPEC", 9), ("BRPEA", "OTHERS", 1),
        ("BRPEA", "ROTEA", 2), ("BRPEC", "BRPEA", 6), ("BRPEC", "LARGE_WHITE_BIRDS", 9),
        ("BRPEC", "OTHERS", 1), ("BRPEC", "ROTEA", 11), ("BRPEC", "SATEA", 1),
        ("LAGUA", "BRPEC", 1), ("LAGUA", "ROTEA", 7), ("LARGE_WHITE_BIRDS", "BRPEC", 1),
        ("LARGE_WHITE_BIRDS", "OTHERS", 1), ("OTHERS", "BRPEC", 1), ("OTHERS", "LARGE_WHITE_BIRDS", 1),
        ("ROTEA", "BLSKA", 1), ("ROTEA", "BRPEC", 3), ("ROTEA", "LAGUA", 4),
        ("ROTEA", "SATEA", 72), ("SATEA", "BRPEC", 1), ("SATEA", "ROTEA", 34),
    ],
    "test": [
        ("BRPEA", "BRPEC", 5), ("BRPEA", "ROTEA", 3), ("BRPEC", "BRPEA", 2),
        ("BRPEC", "LAGUA", 1), ("BRPEC", "LARGE_WHITE_BIRDS", 8), ("BRPEC", "ROTEA", 9),
        ("BRPEC", "SATEA", 3), ("LAGUA", "BRPEC", 4), ("LAGUA", "OTHERS", 1),
        ("LAGUA", "ROTEA", 6), ("LARGE_WHITE_BIRDS", "OTHERS", 1), ("LARGE_WHITE_BIRDS", "ROTEA", 1),
        ("OTHERS", "BRPEA", 1), ("OTHERS", "LAGUA", 3), ("OTHERS", "LARGE_WHITE_BIRDS", 2),
        ("ROTEA", "BRPEC", 5), ("ROTEA", "LAGUA", 4), ("ROTEA", "LARGE_WHITE_BIRDS", 1),
        ("ROTEA", "SATEA", 66), ("SATEA", "BRPEC", 1), ("SATEA", "ROTEA", 32),
    ],
}
SCORES = [
    (FIRST, {"train": 7680, "val": 960, "test": 960}, (0.1205, 0.1411, 0.0118, 0.2734)),
    (SECOND, {"train": 7040, "val": 880, "test": 880}, (0.1184, 0.3996, 0.0026, 0.5206)),
]
COUNTS = "iteration long, species string, train long, val long, test long"


def counts_of(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], COUNTS)


@pytest.mark.parametrize("rows,tiles,want", SCORES)
def test_scores_of_published_splits(spark, rows, tiles, want):
    r = splits.score_splits(counts_of(spark, rows)).first()
    assert tuple(round(v, 4) for v in (r.distribution_score, r.missing_penalty, r.imbalance_penalty, r.total_score)) == want


TOP = [
    "SNEGA 16.4, ROSPA 16.2, WHIBA 13.9, DCCOA 12.0, GBHEA 12.0, BLSKA 11.4, RUTUA 8.1, GREGA 7.0, LWBBA 6.1, OTHRA 5.7",
    "UNSURE 75.8, DCCOA 50.0, SNEGA 34.5, BRPEF 20.0, LAGUF 16.4, GBHEA 16.0, GREGC 15.5, ROSPA 15.0, MTRNS 14.5, OTHRA 12.6",
]
MISSING = [
    ("CATEA REEGA REEGWM ROSPC", "BLSTA REEGWM UNSURE"),
    ("BNSTA BRPEF GREGF NECOA REEGA REEGF REEGWMA ROSPC RUTUF WHIBF", "AMAVA BNSTA CATEA GREGF REEGA REEGF REEGWMA RUTUF WHIBF"),
]


@pytest.mark.parametrize("k", [0, 1])
def test_shares_and_reports_of_published_splits(spark, k):
    rows, tiles, _ = SCORES[k]
    counts = counts_of(spark, rows)
    shares = splits.species_shares(counts.drop("iteration"))
    assert ", ".join(f"{r.species} {r.deviation:.1f}" for r in splits.imbalance_top(shares).collect()) == TOP[k]
    missing = splits.missing_species(shares).orderBy("species").collect()
    assert tuple(" ".join(r.species for r in missing if r[f"missing_{s}"]) for s in ("val", "test")) == MISSING[k]
    score = splits.score_splits(counts).first().asDict()
    lines = reports.split_report(shares, score, tiles, 42, 5000)
    at = lines.index("SCORE BREAKDOWN")
    first = ["Distribution score: 0.1205", "  - Train L1 distance: 0.0073", "  - Val L1 distance: 0.0668", "  - Test L1 distance: 0.0464", "Missing species penalty: 0.1411", "Imbalance penalty: 0.0118"]
    second = ["Distribution score: 0.1184", "  - Train L1 distance: 0.0053", "  - Val L1 distance: 0.0543", "  - Test L1 distance: 0.0587", "Missing species penalty: 0.3996", "Imbalance penalty: 0.0026"]
    assert lines[at + 2 : at + 8] == (first, second)[k]
    size = ["Train            7680    80.0%           15940    81.2%", "Train            7040    80.0%           13978    80.0%"][k]
    bird = ["ROTEA           10274     8308     1079      887    80.9%    10.5%     8.6%", "ROTEA            9100     7279      909      912    80.0%    10.0%    10.0%"][k]
    own = ["  DCCOA: 21/1/3 (global: 25, deviation: 12.0)", "  DCCOA: 11/5/4 (global: 20, deviation: 50.0)"][k]
    assert size in lines and bird in lines and own in lines
    names = [x[4:].split()[0] for x in lines[lines.index("MISSING SPECIES") : lines.index("TOP 10 MOST IMBALANCED SPECIES")] if x.startswith("  - ")]
    assert names == " ".join(MISSING[k]).split()


def test_classes_of_published_counts(spark):
    species = counts_of(spark, FIRST).select("species", (F.col("train") + F.col("val") + F.col("test")).alias("n"))
    mapping = spark.createDataFrame(list(LABELS.items()), "raw string, label string")
    got = {r.label: r.n for r in sampling.label_remap(species, mapping).groupBy("label").agg(F.sum("n").alias("n")).collect()}
    # Rows of each class.
    assert got == {"ROTEA": 10274, "SATEA": 3552, "BRPEC": 2503, "LAGUA": 1493, "BRPEA": 852, "OTHERS": 429, "LARGE_WHITE_BIRDS": 343, "BLSKA": 189}


@pytest.mark.parametrize("split,want", [("val", 0.9092573001577626), ("test", 0.9168182661231925)])
def test_f1_of_published_predictions(spark, split, want):
    names = sorted(SUPPORT[split])
    wrong = WRONG[split]
    right = [(k, k, n - sum(m for t, _, m in wrong if t == k)) for k, n in SUPPORT[split].items()]
    rows = [(names.index(t), names.index(p), n) for t, p, n in [*right, *wrong]]
    pred = spark.createDataFrame(rows, "y_true int, y_pred int, n int").select("y_true", "y_pred", F.explode(F.sequence(F.lit(1), "n")))
    report = {r.label: r for r in metrics.class_report(metrics.confusion(pred, 8)).collect()}
    assert report["macro avg"].f1 == pytest.approx(want, abs=1e-9) and report["accuracy"].support == sum(SUPPORT[split].values())


def test_sizes_of_published_splits(spark):
    for n, want in ((9600, (7680, 960, 960)), (8800, (7040, 880, 880)), (7, (5, 0, 2))):
        tiles = spark.range(1, n + 1).withColumnRenamed("id", "image_id")
        got = {r.split: r["count"] for r in splits.random_splits(tiles, spark.range(1).withColumnRenamed("id", "iteration")).groupBy("split").count().collect()}
        assert tuple(got.get(s, 0) for s in splits.SPLITS) == want
