"""Classification metrics as aggregates over predictions (row_id, y_true, y_pred, scores)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arg_max(scores: Column) -> Column:
    """Index of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda v: v / total)


def confusion(pred: DataFrame, classes: int) -> DataFrame:
    """(y_true, y_pred, n, pct) for every pair of the fixed classes, pct of the row of y_true, 0 for an empty one."""
    spark = pred.sparkSession
    k = spark.range(classes).select(F.col("id").cast("int").alias("y_true"), F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("y_pred"))
    n = pred.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))
    out = k.join(n, ["y_true", "y_pred"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("y_true"))
    return out.withColumn("pct", F.round(F.coalesce(F.col("n") * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0)), 9))


def class_report(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support): each class, accuracy, macro and weighted means; divisions by zero give 0."""
    per = matrix.groupBy("y_true").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    got = matrix.groupBy(F.col("y_pred").alias("y_true")).agg(F.sum("n").alias("predicted"))
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    c = per.join(got, "y_true").withColumn("precision", safe(F.col("tp"), F.col("predicted"))).withColumn("recall", safe(F.col("tp"), F.col("support")))
    f1 = 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    c = c.withColumn("f1", F.coalesce(f1, F.lit(0.0)))
    names = ("precision", "recall", "f1")
    rows = c.select(F.col("y_true").cast("string").alias("label"), *names, "support")
    macro = c.agg(*[F.avg(x).alias(x) for x in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), *names, "support")
    total = F.nullif(F.sum("support"), F.lit(0))
    weighted = c.agg(*[F.coalesce(F.sum(F.col(x) * F.col("support")) / total, F.lit(0.0)).alias(x) for x in names], F.sum("support").alias("support"))
    accuracy = c.agg(F.coalesce(F.sum("tp") / total, F.lit(0.0)).alias("a"), F.sum("support").alias("support"))
    accuracy = accuracy.select(F.lit("accuracy").alias("label"), *[F.col("a").alias(x) for x in names], "support")
    out = rows.unionByName(accuracy).unionByName(macro).unionByName(weighted.select(F.lit("weighted avg").alias("label"), *names, "support"))
    return out.select("label", *[F.round(x, 9).alias(x) for x in names], "support")


def average_precision(pred: DataFrame, classes: int) -> DataFrame:
    """(class_id, ap), one against the rest; tied scores enter together; a class without positives has 0."""
    long = pred.select("y_true", F.posexplode(F.slice("scores", 1, classes)).alias("class_id", "score"))
    per = long.groupBy("class_id", "score").agg(F.count("*").alias("n"), F.count_if(F.col("y_true") == F.col("class_id")).alias("tp"))
    # Running sums in two levels: within ranges of scores, and over the ranges before, so no class is one task.
    ends = per.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    span = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    block = F.coalesce(F.floor((F.col("high") - F.col("score")) / span * 255), F.lit(0))
    per = per.join(F.broadcast(ends)).select("class_id", "score", "n", "tp", block.alias("block"))  # one row
    inside = Window.partitionBy("class_id", "block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("class_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = per.groupBy("class_id", "block").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))
    sums = sums.select("class_id", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "tp")])
    run = per.withColumns({c: F.sum(c[4:]).over(inside) for c in ("run_n", "run_tp")}).join(sums, ["class_id", "block"])
    run = run.withColumn("precision", (F.col("run_tp") + F.col("tp_before")) / (F.col("run_n") + F.col("n_before")))
    return run.groupBy("class_id").agg(F.round(F.coalesce(F.sum(F.col("tp") * F.col("precision")) / F.nullif(F.sum("tp"), F.lit(0)), F.lit(0.0)), 9).alias("ap"))


def misclassified(pred: DataFrame) -> DataFrame:
    """Rows that are wrong, with the scores of the true and of the predicted class to 4 places."""
    at = lambda i: F.round(F.get("scores", F.col(i)), 4)
    return pred.where(F.col("y_true") != F.col("y_pred")).select("row_id", "y_true", "y_pred", at("y_true").alias("true_score"), at("y_pred").alias("predicted_score"))


def epoch_metrics(batches: DataFrame) -> DataFrame:
    """(epoch, loss, accuracy) from batches (epoch, loss, correct, n): means by sample."""
    n = F.greatest(F.lit(1), F.sum("n"))
    return batches.groupBy("epoch").agg(F.round(F.sum(F.col("loss") * F.col("n")) / n, 9).alias("loss"), F.round(F.sum("correct") / n, 9).alias("accuracy"))


def best_epoch(history: DataFrame, by: str = "val_acc") -> DataFrame:
    """The earliest epoch with the largest ``by``."""
    return history.agg(F.max_by("epoch", F.struct(F.col(by), -F.col("epoch"))).alias("epoch"), F.max(by).alias(by))
