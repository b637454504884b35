"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated as often as an inverted Poisson distribution of mean r_s says for the document's own hash;
r_s is the source's target share of the output over its share of the input.  The copies are then dealt out by a global sort
on another hash.  Each document decides for itself, so nothing is gathered but a count per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygrid.llm.common import cut, free_names

#: Rate beyond which a draw is the sum of several, and terms of a distribution of at most that rate: what lies beyond
#: 96 terms has a probability under 1e-40, far below the 52 bits of a draw, so every draw is decided.
PART, TERMS = 16, 96
MAX_BROADCAST = 10_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 hash."""
    hexed = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return F.conv(hexed, 16, 10).cast("double") / float(1 << 52)


def source_rates(docs: DataFrame, source_col: str, weights: DataFrame | None, temperature: float, total: int | None) -> DataFrame:
    """(source, n, rate, parts, cdf): a row per source. ``weights`` has source and weight; without, weight is n ** temperature."""
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is not None:
        own = weights.select(F.col("source").cast("string").alias("w_source"), F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
        own = own.groupBy("w_source").agg(F.sum("weight").alias("weight"))
        counts = counts.join(own, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source").fillna(0.0, ["weight"])
    else:
        counts = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    sums = counts.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    goal = F.lit(float(total)) if total is not None else F.col("all_n").cast("double")
    rate = F.coalesce(goal * F.col("weight") / F.nullif(F.col("all_weight"), F.lit(0.0)) / F.col("n"), F.lit(0.0))
    out = counts.join(F.broadcast(sums)).withColumn("rate", rate)  # one row
    out = out.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    r = F.col("rate") / F.col("parts")
    begin = F.struct(F.exp(-r).alias("p"), F.array(F.exp(-r)).alias("c"))
    grow = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        begin,
        lambda s, k: F.struct((s["p"] * r / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * r / k)).alias("c")),
    )
    return out.select("source", "n", "rate", "parts", grow["c"].alias("cdf"))


def mix_sources(
    docs: DataFrame,
    *,
    weights: DataFrame | None = None,
    temperature: float = 0.0,
    total: int | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    copy_col: str = "copy",
) -> DataFrame:
    """``docs`` replicated to the target weights, in a global pseudo-random order, with ``copy_col`` from 1.

    ``weights`` (source, weight) are the target shares, sources not in it having none; without, a source's weight is its
    number of rows to the power ``temperature``.  ``total`` is the expected number of rows, by default that of
    ``docs``.  A null source is a source of its own, a null id draws as the text "null", rows that repeat an id draw
    alike.  Texts are not looked at.  Other columns pass through, whatever their names.  A column that has the name of ``copy_col`` is replaced.  Empty tables give no rows.
    """
    own_source, parts, cdf, count, order = free_names([*docs.columns, copy_col], 5)
    rates = cut(source_rates(docs, source_col, weights, temperature, total).select(F.col("source").alias(own_source), F.col("parts").alias(parts), F.col("cdf").alias(cdf)))
    if rates.count() <= MAX_BROADCAST:
        rates = F.broadcast(rates)  # at most 10,000 rows of 97 numbers
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    draws = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda j: uniform(F.lit(str(seed)), key, j.cast("string")))
    one = lambda u: F.size(F.filter(F.col(cdf), lambda c: c <= u))
    copies = F.aggregate(draws, F.lit(0), lambda s, u: s + one(u))
    columns = [f"`{c}`" for c in docs.columns if c != copy_col]
    own = docs.join(rates, F.col(source_col).cast("string").eqNullSafe(F.col(own_source))).withColumn(count, copies)
    own = own.where(F.col(count) > 0).select(*columns, F.explode(F.sequence(F.lit(1), F.col(count))).alias(copy_col))
    own = own.withColumn(order, F.xxhash64(F.lit(seed), key, F.col(copy_col)))
    return own.orderBy(order, key, copy_col).drop(order)
