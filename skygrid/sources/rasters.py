"""Raster files: decoding through the JVM's image readers, PNG encoding, and files written or copied by executors."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def read_rasters(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, file_name, height, width, data) of PNG, JPEG and other image files; data are BGR bytes, null for unreadable files.

    Grey images have three equal channels, alpha is left out.
    """
    rows = spark.read.format("image").load(path).select("image.*")

    def bgr(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data = []
            for r in frame.itertuples():
                if r.height <= 0 or r.nChannels not in (1, 3, 4):
                    data.append(None)
                elif r.nChannels == 3:
                    data.append(r.data)
                else:
                    own = np.frombuffer(r.data, np.uint8).reshape(-1, r.nChannels)
                    data.append(np.ascontiguousarray(own[:, :3] if r.nChannels == 4 else np.repeat(own, 3, axis=1)).tobytes())
            yield pd.DataFrame({"path": frame["origin"], "file_name": frame["origin"].str.rsplit("/", n=1).str[-1], "height": frame["height"], "width": frame["width"], "data": data})

    return rows.mapInPandas(bgr, "path string, file_name string, height int, width int, data binary")


def encode_png(img: np.ndarray) -> bytes:
    """A PNG file of (height, width, 3) BGR bytes."""
    h, w = img.shape[:2]
    lines = np.zeros((h, 1 + 3 * w), np.uint8)  # filter type 0, then the line
    lines[:, 1:] = img[..., ::-1].reshape(h, 3 * w)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def to_png(rows: DataFrame, path: str = "path", height: str = "height", width: str = "width") -> DataFrame:
    """(path, data) with PNG files of rows (path, height, width, data); rows without data go."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data = [encode_png(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)) for r in frame.itertuples()]
            yield pd.DataFrame({"path": frame["path"], "data": data})

    own = rows.where("data is not null").select(F.col(path).alias("path"), F.col(height).cast("int").alias("height"), F.col(width).cast("int").alias("width"), "data")
    return own.mapInPandas(run, "path string, data binary")


def _target(path: str) -> tuple[object, str]:
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _put(system: object, path: str, body: bytes) -> None:
    """Write a file under a private name and move it, so a task that is run again leaves whole files only."""
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(body)
    system.move(part, path)


def write_files(files: DataFrame, root: str) -> None:
    """Each row (path, data) as a file under ``root``, a folder all executors share."""

    def put(rows: Iterator) -> None:
        system, base = _target(root)
        for r in rows:
            _put(system, f"{base}/{r['path']}", bytes(r["data"]))

    files.select("path", "data").foreachPartition(put)


def copy_files(manifest: DataFrame, root: str) -> None:
    """Each row (src, dst): the file ``src`` copied to ``dst`` under ``root``."""

    def put(rows: Iterator) -> None:
        system, base = _target(root)
        for r in rows:
            source, path = _target(r["src"])
            with source.open_input_stream(path) as data:
                _put(system, f"{base}/{r['dst']}", data.read())

    manifest.select("src", "dst").foreachPartition(put)


def species_folder(catalog: DataFrame, crops: DataFrame, size: int = 224) -> DataFrame:
    """(path, data) with a PNG of each crop (annotation_id, data) under its catalogue path."""
    rows = crops.join(catalog.select("annotation_id", "crop_path"), "annotation_id")
    return to_png(rows.select(F.col("crop_path").alias("path"), F.lit(size).alias("height"), F.lit(size).alias("width"), "data"))
