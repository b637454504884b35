"""Helpers shared by the training-data operators: shared folders, Arrow text access, hashing."""

from __future__ import annotations

import tempfile
import uuid
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space [\x20\x09-\x0D], the separators of words.
BLANK = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes of text handled at once inside a batch, which bounds a worker's scratch arrays.
CHUNK_BYTES = 1 << 21
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset and one machine runs all."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not told:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="skygrid-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(told)
    return told


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def delete(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound Arrow batches by rows and bytes, so long texts don't pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def free_names(taken: list[str], n: int) -> list[str]:
    """Names of private columns that no column of ``taken`` has, whatever case is told apart."""
    used, out, k = {c.lower() for c in taken}, [], 0
    while len(out) < n:
        if f"__p{k}" not in used:
            out.append(f"__p{k}")
        k += 1
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the row offsets of a string column, nulls as empty texts; no copy if it can be helped."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def row_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> list[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each; a longer text makes a range of its own."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        out.append((first, last))
        first = last
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising permutation of 64-bit words used by SplitMix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes as they count with folding: A-Z as a-z.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
#: The bytes of a word of eight that belong to a run of 0 to 7 bytes.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)
_SHORT = mix(np.arange(1, 65, dtype=np.uint64) * GOLDEN)


def byte_classes(*classes: bytes | range) -> np.ndarray:
    """A table from bytes to classes: 0 for white space, k for the k-th given set, 1 for the rest."""
    out = np.ones(256, np.uint8)
    out[list(BLANK)] = 0
    for k, members in enumerate(classes, 2):
        out[list(members)] = k
    return out


WORDS = byte_classes()


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes of one class other than 0; offsets begin at 0 of ``data``."""
    return kind_runs(table[data], offsets)


def kind_runs(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``runs``, of given classes."""
    n = len(kinds)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=new[1:])
    begin = offsets[:-1]
    new[begin[begin < n]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    keep = kinds[starts] != 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each run's bytes; with ``fold`` A-Z count as a-z.

    A run is read in words of eight bytes.  Each goes with its place through a permutation before they are added, so
    no arithmetic structure of the bytes carries over to the sum; runs of up to eight bytes never collide among their length.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    if fold:
        np.take(FOLDED, data, out=padded[: len(data)])
    else:
        padded[: len(data)] = data
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the word that begins at each byte
    lengths = ends - starts
    last = np.maximum(lengths - 1, 0) >> 3
    tail = words[starts + 8 * last]
    short = lengths - 8 * last < 8
    tail[short] &= _MASKS[(lengths - 8 * last)[short]]
    out = mix(tail ^ place_keys(int(last.max()) + 1)[last])
    long = np.flatnonzero(last)
    if len(long):
        n = last[long]
        first = np.cumsum(n) - n
        k = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        terms = mix(words[np.repeat(starts[long], n) + 8 * k] ^ place_keys(int(n.max()))[k])
        out[long] += np.add.reduceat(terms, first)
    return mix(out + lengths.astype(np.uint64) * GOLDEN)


def place_keys(n: int) -> np.ndarray:
    """A pseudo-random number for each place; at least n of them."""
    return _SHORT if n <= len(_SHORT) else mix(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN)
