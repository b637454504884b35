"""The corpus pipeline: from raw documents to packed training sequences, in five stages.

A stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skygrid.llm import quality
from skygrid.llm.common import delete, free_names, held_out, shared_path
from skygrid.llm.line_dedup import dedup_lines
from skygrid.llm.mixing import mix_sources
from skygrid.llm.near_dedup import near_duplicates
from skygrid.llm.packing import pack_documents
from skygrid.llm.queries import table, tokenizer_path

#: Documents whose quality scores less go.
QUALITY = 0.7
#: A source's weight in the mix is its size to this power, between its natural share (1) and an equal one (0).
TEMPERATURE = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier, fitted to the labels, gives at least ``QUALITY``.

    Null and empty texts score like texts without tokens, whatever that is; repeated rows score alike; rows with a null id are scored,
    but never learned from.  Other columns pass through under any names.  Empty documents give no rows, empty labels a model that
    gives every text 0.5, so none stays.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return quality.with_score(docs, model, keep_from=QUALITY)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that three documents or more share, but from the last; n_chars follows the text.

    Every row stays.  A null text comes out empty, rows that repeat an id are one document and decide alike, as are rows with a
    null id, the first of all; among equal lines only the id decides.  An empty table gives no rows.
    """
    out = dedup_lines(docs, counts=False)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest id, of each group of near-duplicates (five words, likeness of 0.8).

    Null, empty and blank texts are like nothing and stay.  Of rows that repeat both id and text one stays, a null id
    counting as an id here; which one is told by a hash of its columns.  A null id is linked with nothing else.  An empty
    table gives no rows.
    """
    found = near_duplicates(docs, words=5, percent=80)
    ids = found.groupBy(F.col("doc_id").alias("__id")).agg(F.min("kept").alias("__kept"), F.count("*").alias("__n"))
    special = ids.where(~F.col("__kept") | (F.col("__n") > 1))
    name = dict(zip(("__id", "__kept", "__n"), free_names(docs.columns, 3)))
    own_id, kept, n = name.values()
    rows = docs.join(special.withColumnsRenamed(name), F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)), "left")
    rows = rows.where(F.col(kept).isNull() | F.col(kept))
    once = rows.where(F.col(n).isNull()).select(docs.columns)
    w = Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(*docs.columns))
    again = rows.where(F.col(n).isNotNull()).withColumn(n, F.row_number().over(w)).where(F.col(n) == 1)
    return once.unionAll(again.select(docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources come near to equal shares, in a global pseudo-random order.

    A null source is a source of its own, a null id draws as the text "null", rows that repeat an id draw alike, texts are not
    looked at.  An empty table gives no rows.
    """
    copy = free_names(docs.columns, 1)[0]
    return mix_sources(docs, temperature=TEMPERATURE, copy_col=copy).drop(copy)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of at most 4096 tokens.

    Null and empty texts are their end mark alone.  Rows that repeat an id, as copies in the mix do, are packed each for itself; a
    null id stays null.  An empty table gives no rows.
    """
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned scores and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; what lies between them is written to the shared folder, and goes when the next is written."""
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if old:
            delete(spark, old)
        docs, old = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
