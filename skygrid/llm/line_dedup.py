"""Line dedup on levelled sorted runs of line hashes.

``LineRuns`` keeps what has been seen as runs: tables of 128-bit line hashes, bucketed and sorted by hash.  Batches of documents come in descending order of ids.  A new batch is merge-anti-joined with the
runs, which need no exchange for it: keys that no run has are fresh and enter with their largest id, which stays the largest of all; known keys only
add the number of documents that hold them.  The batch becomes a run of its own, and as soon as a level has ``fanout``
runs they are compacted into one run of the next level.  So each key has one fresh row, which tells the document that keeps
the line, and its number of documents is the sum over the runs.

Runs and batches have as many files as their rows ask for, whatever the number of shuffle partitions.  Without Hadoop's native library
each file takes two processes for its mode and that of its checksums, started by the executor.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrid.llm.common import cut, delete, free_names, shared_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a run that a bucket holds, about.
BUCKET_ROWS = 100_000
SCHEMA = "lo long, hi long, n long, top long, fresh boolean"
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The lines of a text, split at \\n; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


class LineRuns:
    """Levelled runs (lo, hi, n, top, fresh), each in ``buckets`` buckets by (lo, hi) and sorted so, in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 3) -> None:
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _write(self, run: DataFrame) -> str:
        """A new run; a bucket's rows meet in one task, so it is one file however many tasks there are."""
        name = f"line_run_{uuid.uuid4().hex}"
        bucket = F.pmod(F.hash("lo", "hi"), F.lit(self.buckets))  # as the writer counts
        out = run.select("lo", "hi", "n", "top", "fresh").repartition(self.buckets, bucket).write.bucketBy(self.buckets, "lo", "hi").sortBy("lo", "hi")
        self.paths[name] = shared_path(self.spark, name)
        out.option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        delete(self.spark, self.paths.pop(name))

    def _every(self, names: list[str]) -> DataFrame:
        """The rows of several runs, read as plain files: Spark 4.1 takes a union of bucketed scans for bucketed, which it isn't."""
        return self.spark.read.schema(SCHEMA).parquet(*(self.paths[name] for name in names))

    @staticmethod
    def _merge(rows: DataFrame) -> DataFrame:
        """A row for each key; a key that is fresh in two runs is an error, as then either's top may be wrong."""
        out = rows.groupBy("lo", "hi").agg(F.sum("n").alias("n"), F.max(F.when(F.col("fresh"), F.col("top"))).alias("top"), F.count_if("fresh").alias("times"))
        n = F.when(F.col("times") <= 1, F.col("n")).otherwise(F.raise_error(F.lit("a line is fresh in two runs")).cast("long"))
        return out.select("lo", "hi", n.alias("n"), "top", (F.col("times") == 1).alias("fresh"))

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (lo, hi, n, top), a row for each key, as a run.  Ids are below those of earlier batches."""
        own = batch.select("lo", "hi", "n", "top").repartition(self.buckets, "lo", "hi")
        runs = [self.spark.table(name).where("fresh").select("lo", "hi").hint("merge") for level in self.levels for name in level]
        rows = reduce(lambda df, run: df.join(run, ["lo", "hi"], "left_anti"), runs, own).withColumn("fresh", F.lit(True))
        for run in runs:
            rows = rows.unionByName(own.join(run, ["lo", "hi"], "left_semi").withColumn("fresh", F.lit(False)))
        name = self._write(rows)
        self.levels[0].append(name)
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(self._merge(self._every(self.levels[k]))))
                for old in self.levels[k]:
                    self._drop(old)
                self.levels[k] = []

    def merged(self) -> DataFrame:
        """(lo, hi, n, top): every key ever added, with the number of documents that hold it and the largest of their ids."""
        return self._merge(self._every([name for level in self.levels for name in level])).drop("fresh")

    def clear(self) -> None:
        """Delete all runs."""
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = [[]]


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, lo, hi): the distinct keys of each row with at least ``min_chars`` code points."""
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col(text_col)), line_key), lambda k: F.char_length(k) >= min_chars))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.explode(keys).alias("key"))
    return rows.select("id", F.xxhash64("key").alias("lo"), F.xxhash64("key", F.lit(1)).alias("hi"))


def common_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int, batches: int) -> DataFrame:
    """(lo, hi, top): keys in at least ``min_docs`` documents and the largest id that holds them, null if only null ids do."""
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    batch = sum(((F.col("id") < c).cast("int") for c in cuts or []), F.lit(0))  # the largest ids are batch 0, nulls the last
    keys = line_hashes(docs, id_col, text_col, min_chars).distinct()  # rows that repeat an id are one document
    keys = keys.withColumn("batch", F.coalesce(batch, F.lit(batches - 1))).groupBy("batch", "lo", "hi").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    path = shared_path(spark, "line-batches")
    keys.hint("rebalance", F.col("batch")).write.partitionBy("batch").parquet(path)  # a batch's rows together, split by size
    stored = spark.read.schema(keys.select("lo", "hi", "n", "top", "batch").schema).parquet(path)
    runs = LineRuns(spark, stored.count() // BUCKET_ROWS + 1)
    for b in range(batches):
        runs.add(stored.where(F.col("batch") == b))
    common = cut(runs.merged().where(F.col("n") >= min_docs).drop("n"))
    runs.clear()
    delete(spark, path)
    return common


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, batches: int = 4, counts: bool = True
) -> DataFrame:
    """``docs`` with the text that stays, and with ``counts`` n_lines and n_dropped (clashing columns are replaced).

    A line whose key (stripped, A-Z lower-cased) has at least ``min_chars`` code points and is in at least ``min_docs``
    documents goes, except in the largest id that holds it.  Null or empty texts are one empty line, which stays,
    and come out empty.  Rows that repeat an id are one document and decide alike; rows with a null id are one document as
    well, smaller than any.  Other columns pass through, whatever their names.  An empty table gives no rows.
    """
    common = common_lines(docs, id_col, text_col, min_docs, min_chars, batches)
    own_id, drops, kept = free_names([*docs.columns, "n_lines", "n_dropped"], 3)
    dropped = line_hashes(docs, id_col, text_col, min_chars).join(common, ["lo", "hi"]).where("id < top or (id is null and top is not null)")
    dropped = dropped.groupBy(F.col("id").alias(own_id)).agg(F.collect_set("lo").alias(drops))
    own = docs.join(dropped, F.col(id_col).cast("long").eqNullSafe(F.col(own_id)), "left")
    lines = lines_of(F.col(text_col))

    def stays(line: Column) -> Column:
        key = line_key(line)
        return (F.char_length(key) < min_chars) | ~F.array_contains(drops, F.xxhash64(key))

    own = own.withColumn(kept, F.when(F.col(drops).isNull(), lines).otherwise(F.filter(lines, stays)))
    out = [F.array_join(kept, "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    if counts:
        n = F.size(lines).cast("long")
        out += [n.alias("n_lines"), (n - F.size(kept)).alias("n_dropped")]
    return own.select(*out)
