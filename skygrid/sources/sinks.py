"""Writers: Parquet for what grows, single JSON or text files for what is small by nature."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_text(lines: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One text file of the column ``value`` of rows in order; refuses to overwrite.

    The rows are sorted by all tasks and written by one, a line at a time, so nothing is gathered in memory.
    """
    spark = lines.sparkSession
    jvm = spark.sparkContext._jvm
    target, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(target):
        raise FileExistsError(path)
    rows = lines.orderBy(*order) if order else lines
    rows.select("value").coalesce(1).write.text(folder.toString())
    parts = system.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "part-*"))
    system.mkdirs(target.getParent())
    if parts:
        system.rename(parts[0].getPath(), target)
    else:
        system.create(target).close()
    system.delete(folder, True)


def document(head: dict[str, object], lists: list[tuple[str, DataFrame]], order: str = "id") -> DataFrame:
    """(section, at, value): the lines of one JSON object, single values first, then lists of rows by ``order``, a line for each."""
    spark = lists[0][1].sparkSession
    texts = [f"{json.dumps(k)}: {json.dumps(v)}," for k, v in head.items()]
    rows = [(-1, k, t) for k, t in enumerate(["{", *texts])]
    for k, (name, _) in enumerate(lists):
        rows += [(3 * k, 0, f"{json.dumps(name)}: ["), (3 * k + 2, 0, "]," if k + 1 < len(lists) else "]}")]
    out = spark.createDataFrame(rows, "section int, at long, value string")
    for k, (_, df) in enumerate(lists):
        first = df.agg(F.min(order)).first()[0]
        comma = F.when(F.col(order) == first, "").otherwise(",") if first is not None else F.lit("")
        own = [c for c in df.columns if not c.startswith("__")]
        line = F.concat(comma, F.to_json(F.struct(*own)))
        out = out.unionAll(df.select(F.lit(3 * k + 1), F.col(order).cast("long"), line))
    return out


def write_document(head: dict[str, object], lists: list[tuple[str, DataFrame]], path: str, order: str = "id") -> None:
    write_text(document(head, lists, order), path, ["section", "at"])


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, info: dict[str, object] | None = None) -> None:
    """A COCO document, categories before images and annotations, by id."""
    write_document({"info": info} if info else {}, [("categories", categories), ("images", images), ("annotations", annotations)], path)


def write_combined(images: DataFrame, path: str) -> None:
    """All images (om, file_name, width, height, detections) as one document, by om."""
    own = images.select(F.col("om").alias("__om"), "file_name", "width", "height", "detections")
    write_document({}, [("images", own)], path, "__om")


def write_per_image(rows: DataFrame, path: str, key: str = "om_id") -> None:
    """A folder of JSON lines per image."""
    rows.write.mode("errorifexists").partitionBy(key).json(path)


def write_tables(tables: dict[str, DataFrame], path: str, by: str | None = None) -> None:
    """A folder of Parquet per table; refuses to overwrite."""
    for name, df in tables.items():
        w = df.write.mode("errorifexists")
        (w.partitionBy(by) if by and by in df.columns else w).parquet(f"{path}/{name}")


def write_lines(rows: DataFrame, order: list[str], column: str, path: str) -> None:
    """One text file with a line per row in order, for lists of tiles."""
    write_text(rows.withColumn("value", F.col(column).cast("string")), path, order)


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file with a header line, rows in order: a summary of a row per image or species."""
    names = rows.columns
    spark = rows.sparkSession
    quoted = [F.when(F.col(c).cast("string").rlike("[\",\n]"), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c).cast("string")) for c in names]
    body = rows.select(F.lit(1).alias("__part"), *order, F.concat_ws(",", *[F.coalesce(v, F.lit("")) for v in quoted]).alias("value"))
    head = spark.range(1).select(F.lit(0).alias("__part"), *[F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in order], F.lit(",".join(names)).alias("value"))
    write_text(head.unionByName(body), path, ["__part", *order])


def write_catalog(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_json_row(row: DataFrame, path: str) -> None:
    """A one-row table as one JSON file: diagnostics, metadata, summaries."""
    write_text(row.select(F.to_json(F.struct("*")).alias("value")), path)


def counts_map(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """A small table of (key, value) as a one-row map."""
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(out))


def fixed_width(table: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Lines of a report: columns cut and padded to their widths, numbers with thousands separators and to the right."""
    kinds, parts = dict(table.dtypes), []
    for c, n in widths.items():
        if kinds[c] in ("int", "bigint"):
            parts.append(F.lpad(F.format_number(F.col(c), 0), n, " "))
        else:
            parts.append(F.rpad(F.substring(F.col(c).cast("string"), 1, n), n, " "))
    return table.select(F.concat(*parts).alias("value"))
