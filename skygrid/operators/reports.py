"""Reports as lines of text and run artefacts as small tables, ready for the writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrid.operators.splits import SPLITS, imbalance_top, missing_species

MAX_SPECIES = 10_000


def _texts(spark: SparkSession, lines: list[str], section: int) -> DataFrame:
    return spark.createDataFrame([(section, k, t) for k, t in enumerate(lines)], "section int, at long, value string")


def master_summary(images: DataFrame, rows: DataFrame, system: str = "CO-DETR - Master.json") -> DataFrame:
    """(section, at, value): the summary of a prepared data set, images by species, from images (om, file_name) and rows (om, species).

    A column for each species, in order; totals by descending number, ties by first appearance of the name.
    """
    spark = images.sparkSession
    totals = rows.groupBy(F.coalesce("species", F.lit("UNKN")).alias("species")).agg(F.count("*").alias("n"))
    found = {r["species"]: r["n"] for r in totals.orderBy("species").limit(MAX_SPECIES + 1).collect()}  # a row per species
    if len(found) > MAX_SPECIES:
        raise ValueError("too many species for columns")
    n_images = images.count()
    head = [f"Images loaded : {n_images}", f"JSonSys : {system}", "", "TCWS Species : "]
    head.append(f"| {'Image Name':<28} | {'Masks':>7} |" + "".join(f"  {s:<6}" for s in found) + " |")
    per = rows.groupBy("om", F.coalesce("species", F.lit("UNKN")).alias("species")).agg(F.count("*").alias("n"))
    per = per.groupBy("om").agg(F.map_from_entries(F.collect_list(F.struct("species", "n"))).alias("by"), F.sum("n").alias("n"))  # MAX_SPECIES at most
    own = images.select("om", "file_name").join(per, "om", "left")
    cells = [F.concat(F.lit("  "), _left(F.coalesce(F.try_element_at("by", F.lit(s)), F.lit(0)), 6)) for s in found]
    line = F.concat(F.lit("| "), _right(F.col("file_name"), 28), F.lit(" | "), _left(F.format_number(F.coalesce("n", F.lit(0)), 0), 7), F.lit(" |"), *cells, F.lit(" |"))
    body = own.select(F.lit(1).alias("section"), F.col("om").cast("long").alias("at"), line.alias("value"))
    by_number = sorted(found, key=lambda s: -found[s])
    tail = ["", "Species : ", *(f"{s:<8} : {found[s]:>10,} " for s in by_number), "", f"Total birds : {sum(found.values()):,}"]
    return _texts(spark, head, 0).unionAll(body).unionAll(_texts(spark, tail, 2))


def _left(value: Column, n: int) -> Column:
    """Padded on the left, never cut."""
    text = value.cast("string")
    return F.when(F.length(text) < n, F.lpad(text, n, " ")).otherwise(text)


def _right(value: Column, n: int) -> Column:
    text = value.cast("string")
    return F.when(F.length(text) < n, F.rpad(text, n, " ")).otherwise(text)


def split_report(shares: DataFrame, score: dict[str, float], tiles: dict[str, int], seed: int, iterations: int) -> list[str]:
    """The lines of the report on the best split.

    ``shares`` is ``species_shares`` of its counts, a row per species; ``score`` has total_score, distribution_score,
    missing_penalty, imbalance_penalty; ``tiles`` the number of tiles of each split.
    """
    rows = shares.orderBy("rank").limit(MAX_SPECIES).collect()
    sums = {s: sum(r[s] for r in rows) for s in SPLITS}
    total = sum(sums.values())
    share = {s: {r["species"]: (r[s] / sums[s] if sums[s] else 0.0) for r in rows} for s in SPLITS}
    overall = {r["species"]: (r["total"] / total if total else 0.0) for r in rows}
    out = ["=" * 70, "DATASET SPLIT REPORT", "=" * 70, "", "CONFIGURATION", "-" * 40, f"Random seed: {seed}", f"Iterations: {iterations}", "Split ratios: 80% / 10% / 10%", f"Final score: {score['total_score']:.4f}", ""]
    out += ["SCORE BREAKDOWN", "-" * 40, f"Distribution score: {score['distribution_score']:.4f}"]
    out += [f"  - {s.title()} L1 distance: {sum(abs(share[s][k] - p) for k, p in overall.items()):.4f}" for s in SPLITS]
    out += [f"Missing species penalty: {score['missing_penalty']:.4f}", f"Imbalance penalty: {score['imbalance_penalty']:.4f}", ""]
    n = sum(tiles.values())
    percent = lambda a, b: 100 * a / b if b else 0.0
    out += ["SPLIT SIZES", "-" * 40, f"{'Split':<10} {'Tiles':>10} {'%':>8} {'Annotations':>15} {'%':>8}", "-" * 55]
    out += [f"{s.title():<10} {tiles[s]:>10} {percent(tiles[s], n):>7.1f}% {sums[s]:>15} {percent(sums[s], total):>7.1f}%" for s in SPLITS]
    out += ["-" * 55, f"{'Total':<10} {n:>10} {'100.0%':>8} {total:>15} {'100.0%':>8}", "", "PER-SPECIES DISTRIBUTION", "-" * 90]
    out += [f"{'Species':<12} {'Global':>8} {'Train':>8} {'Val':>8} {'Test':>8} {'Train%':>8} {'Val%':>8} {'Test%':>8}", "-" * 90]
    for r in rows:
        counts = " ".join(f"{r[c]:>8}" for c in ("total", *SPLITS))
        out.append(f"{r['species'][:12]:<12} {counts} " + " ".join(f"{r[f'pct_{s}']:>7.1f}%" for s in SPLITS))
    out += ["", "MISSING SPECIES", "-" * 40]
    missing = {r["species"]: r for r in missing_species(shares).collect()}
    for s in ("val", "test"):
        names = sorted(k for k, r in missing.items() if r[f"missing_{s}"])
        known = {r["species"]: r["total"] for r in rows}
        out += [f"Missing in {s} ({len(names)}):", *(f"  - {k} (global count: {known[k]})" for k in names)] if names else [f"Missing in {s}: None"]
    out += ["", "TOP 10 MOST IMBALANCED SPECIES", "-" * 40]
    by_name = {r["species"]: r for r in rows}
    for r in imbalance_top(shares).collect():
        own = by_name[r["species"]]
        out.append(f"  {r['species']}: {own['train']}/{own['val']}/{own['test']} (global: {r['total']}, deviation: {r['deviation']:.1f})")
    return [*out, "", "=" * 70]


def split_metadata(assigned: DataFrame, shares: DataFrame, score: dict[str, float], seed: int, iterations: int) -> DataFrame:
    """(section, at, value): the document that describes a split: seed, scores, sizes, missing species and the ids of each split.

    ``assigned`` is (image_id, split); the lists of ids are written a line each and never gathered.
    """
    from skygrid.sources.sinks import document

    sums = shares.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in SPLITS]).first()
    tiles = {r["split"]: r["count"] for r in assigned.groupBy("split").count().collect()}  # three rows
    missing = missing_species(shares).collect()
    names = lambda s: sorted(r["species"] for r in missing if r[f"missing_{s}"])
    sizes = {f"{s}_tiles": tiles.get(s, 0) for s in SPLITS} | {f"{s}_annotations": sums[s] for s in SPLITS}
    head = {
        "seed": seed,
        "iterations": iterations,
        "best_score": score["total_score"],
        "score_details": {k: score[k] for k in ("distribution_score", "missing_penalty", "imbalance_penalty")},
        "split_sizes": sizes,
        "missing_species": {"val": names("val"), "test": names("test")},
    }
    lists = [(f"{s}_image_ids", assigned.where(F.col("split") == s).select(F.col("image_id").alias("id"))) for s in SPLITS]
    out = document(head, lists)
    number = F.regexp_replace("value", r'\{"id":(\d+)\}', "$1")
    return out.withColumn("value", F.when(F.col("section") % 3 == 1, number).otherwise(F.col("value")))


def ap_per_class(ap: DataFrame, classes: DataFrame) -> DataFrame:
    """One row with a map from labels to average precision; ``classes`` (label, class_id) is a dimension."""
    own = classes.join(ap, "class_id", "left")
    return own.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.coalesce("ap", F.lit(0.0)).alias("ap"))))).alias("ap"))


def misclassified_rows(wrong: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The wrong predictions (row_id, y_true, y_pred, true_score, predicted_score) with the crop's path from ``rows`` (row_id, crop_path) and labels."""
    true = classes.select(F.col("class_id").alias("y_true"), F.col("label").alias("true_label"))
    predicted = classes.select(F.col("class_id").alias("y_pred"), F.col("label").alias("predicted_label"))
    own = wrong.join(rows.select("row_id", "crop_path"), "row_id", "left").join(true, "y_true", "left").join(predicted, "y_pred", "left")
    return own.select("row_id", "crop_path", "true_label", "predicted_label", F.col("true_score").alias("true_class_conf"), F.col("predicted_score").alias("predicted_class_conf"))


def composition(counts: DataFrame) -> DataFrame:
    """One row with a map from labels to counts for each split, of counts (label, train, val, test)."""
    return counts.agg(*[F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", s)))).alias(s) for s in SPLITS])


def first_warnings(failures: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` failures, for warnings."""
    return failures.orderBy(*order).limit(n)


def peek(rows: DataFrame, n: int = 32) -> DataFrame:
    """A first batch of rows, to look at."""
    return rows.limit(n)


def epoch_order(rows: DataFrame, seed: int, epoch: int, id_col: str = "row_id") -> DataFrame:
    """Rows in the pseudo-random order of an epoch, for training without a sampler."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.lit(epoch), F.col(id_col)), id_col)
