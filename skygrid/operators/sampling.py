"""Label maps, caps, merged groups and weights of training sets."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygrid.functions.names import portable_key

Key = Callable[[Column], Column]


def label_remap(rows: DataFrame, mapping: DataFrame, raw: str = "species") -> DataFrame:
    """``rows`` with label from ``mapping`` (raw, label), many to one; names not in it go.  The mapping is a dimension."""
    return rows.join(mapping.select(F.col("raw").alias(raw), "label"), raw)


def label_index(train: DataFrame, label: str = "label") -> DataFrame:
    """(label, class_id): ids from 0 by name."""
    own = train.select(label).where(F.col(label).isNotNull()).distinct()
    return own.withColumn("class_id", (F.row_number().over(Window.orderBy(label)) - 1).cast("long"))  # a row per class


def cap_per_class(rows: DataFrame, k: int | None, key: Key, label: str = "label", id_col: str = "row_id") -> DataFrame:
    """The first ``k`` rows of each label in pseudo-random order; null labels go; None changes nothing."""
    if k is None:
        return rows
    w = Window.partitionBy(label).orderBy(key(F.col(id_col)), id_col)
    return rows.where(F.col(label).isNotNull()).withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k).drop("__rank")


def merge_groups(rows: DataFrame, groups: list[list[str]], cap: int | None, key: Key, label: str = "label", id_col: str = "row_id") -> DataFrame:
    """Each group in turn becomes one label, its names sorted and joined; with a cap each of its labels keeps max(1, cap // size) rows."""
    for group in groups:
        inside = F.coalesce(F.col(label).isin(group), F.lit(False))
        if cap is not None:  # only the group's rows are ranked, and all but the first of each label go before the shuffle
            rows = rows.where(~inside).unionByName(cap_per_class(rows.where(inside), max(1, cap // len(group)), key, label, id_col))
        rows = rows.withColumn(label, F.when(inside, F.lit("_".join(sorted(group)))).otherwise(F.col(label)))
    return rows


def loader_pipeline(rows: DataFrame, groups: list[list[str]], cap: int | None, key: Key, split: str, label: str = "label", id_col: str = "row_id") -> DataFrame:
    """Merge, then cap; val and test have a fifth of the cap, 1 at least."""
    own = cap if split == "train" or cap is None else max(1, cap // 5)
    return cap_per_class(merge_groups(rows, groups, own, key, label, id_col), own, key, label, id_col)


def class_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))


def class_weights(counts: DataFrame) -> DataFrame:
    """``counts`` with weight 1 / max(n, 1) over its mean."""
    raw = 1.0 / F.greatest(F.col("n"), F.lit(1))
    return counts.withColumn("weight", F.round(raw / F.avg(raw).over(Window.partitionBy()), 9))  # a row per class


def sampler_weights(rows: DataFrame, power: float, label: str = "label") -> DataFrame:
    """``rows`` with weight 1 / n ** power of their label's count."""
    counts = class_counts(rows, label).select(F.col(label), F.round(1.0 / F.pow(F.col("n").cast("double"), F.lit(power)), 9).alias("weight"))
    return rows.join(counts, label)


def split_composition(rows: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """(label, train, val, test) for every class, zeros filled."""
    per = rows.groupBy(label).agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")])
    return classes.select(label).join(per, label, "left").fillna(0, ["train", "val", "test"])


#: Weights are counted in units of 1e-9, and draws are places among 2**62 or so.
UNITS, PLACES = 1_000_000_000, 2147483647**2


def weighted_sample(rows: DataFrame, draws: int, seed: int = 42, weight: str = "weight", id_col: str = "row_id", bucket_rows: int = 100_000) -> DataFrame:
    """``draws`` rows with replacement, each with a chance in proportion to its weight, with ``draw`` from 0.

    Rows with a null id or no weight take no part.  Weights are whole units, so their running sums, by (bucket, id), are exact and every draw meets
    one row.  The number of buckets grows with the rows; a bucket's rows and draws are merged by their places in one sorted pass, in
    which a draw takes the last row that begins before it.
    """
    own = rows.where((F.col(weight) > 0) & F.col(id_col).isNotNull()).withColumn("__u", F.greatest(F.round(F.col(weight) * UNITS), F.lit(1)).cast("long"))
    buckets = own.count() // bucket_rows + 1
    own = own.withColumn("__b", F.pmod(F.col(id_col), F.lit(buckets)))
    sums = own.groupBy("__b").agg(F.sum("__u").alias("s"))
    ends = sums.withColumn("hi", F.sum("s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)))  # a row per bucket
    ends = ends.select("__b", (F.col("hi") - F.col("s")).alias("lo"), "hi")
    table = ends.agg(F.array_sort(F.collect_list(F.struct("lo", "__b"))).alias("t"), F.max("hi").alias("total")).where("total is not null")
    step = max(1, math.isqrt(buckets))
    d = rows.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(table))  # one row of buckets
    place = portable_key(F.col("draw"), F.lit(seed)) * 2147483647 + portable_key(F.col("draw"), F.lit(seed + 1))
    d = d.withColumn("place", place)
    d = d.withColumn("__at", F.expr(f"cast(place as decimal(19,0)) * cast(total as decimal(18,0)) div cast({PLACES} as decimal(19,0))"))
    coarse = F.greatest(F.size(F.filter(F.transform(F.sequence(F.lit(0), F.size("t") - 1, F.lit(step)), lambda i: F.get("t", i)["lo"]), lambda lo: lo <= F.col("__at"))) - 1, F.lit(0)) * step
    near = F.filter(F.slice("t", coarse + 1, F.lit(step)), lambda x: x["lo"] <= F.col("__at"))
    d = d.withColumn("bucket", F.element_at(near, -1)).select("draw", F.col("bucket.__b").alias("__b"), (F.col("__at") - F.col("bucket.lo")).alias("__at"))
    inside = Window.partitionBy("__b").orderBy(id_col).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("__at", F.coalesce(F.sum("__u").over(inside), F.lit(0)))
    names = rows.columns
    both = own.select("__b", "__at", F.lit(None).cast("long").alias("draw"), F.struct(*names).alias("__row"))
    both = both.unionByName(d.select("__b", "__at", "draw", F.lit(None).cast(both.schema["__row"].dataType).alias("__row")))
    order = Window.partitionBy("__b").orderBy("__at", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__row", F.last("__row", ignorenulls=True).over(order)).where("draw is not null").select("draw", "__row.*")
