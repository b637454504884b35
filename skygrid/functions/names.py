"""Scalar expressions on names, paths, windows and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE_NAME = r"^\d{8} 10k-\d+-\d+\.jpg$"
#: An image's number as %03d prints it: three digits, or more that don't begin with 0.
NUMBER = "[1-9][0-9]{3,}|[0-9]{3}"


def is_source_image(name: Column) -> Column:
    return F.coalesce(name.rlike(SOURCE_NAME), F.lit(False))


def source_row(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, r"10k-(\d+)-(\d+)", 1), F.lit("")).try_cast("int"), F.lit(999))


def source_col(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, r"10k-(\d+)-(\d+)", 2), F.lit("")).try_cast("int"), F.lit(999))


def image_name(index: Column, name: Column) -> Column:
    """OM_NNN_<date>_<rest> for "<date> <rest>"."""
    parts = F.split(name, " ", 2)
    return F.format_string("OM_%03d_%s_%s", index, F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))


def image_id_of(file_name: Column) -> Column:
    """OM_NNN at the beginning, with all digits of a number above 999; otherwise the name without its last suffix."""
    return F.coalesce(F.nullif(F.regexp_extract(file_name, f"^(OM_(?:{NUMBER}))", 1), F.lit("")), F.regexp_replace(file_name, r"\.[^.]*$", ""))


def image_number(om_id: Column) -> Column:
    """The number in OM_NNN, null if there is none."""
    return F.regexp_extract(om_id, f"^OM_({NUMBER})", 1).try_cast("long")


def tile_path(om_id: Column, file_name: Column) -> Column:
    """A tile's name inside a merged data set."""
    return F.concat_ws("/", om_id, F.lit("tiles"), file_name)


def present(separator: str, *values: Column) -> Column:
    """The values that are neither null nor empty, joined."""
    return F.concat_ws(separator, *[F.nullif(v, F.lit("")) for v in values])


def date_stamp(day: Column, pattern: str = "MMddyyyy") -> Column:
    return F.date_format(day, pattern)


def first_folder(om: Column, file_name: Column) -> Column:
    return F.coalesce(F.nullif(om, F.lit("")), F.split_part(file_name, F.lit("/"), F.lit(1)))


def crop_path(path: Column, root: str) -> Column:
    """Slashes forward, one leading crops/ off, under ``root`` unless absolute."""
    own = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "(?i)^crops/", "")
    return F.when(own.startswith("/"), own).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), own))


def py_list(values: Column) -> Column:
    """An array as a Python list is printed."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: v.cast("string")), ", "), F.lit("]"))


def run_name(prefix: str, epochs: int, rate: float, decay: float) -> str:
    """Name of a training run: rate and decay in millionths and ten-thousandths."""
    return f"{prefix}_ep{epochs}_lr{round(rate * 1e6):04d}_wd{round(decay * 1e4):04d}"


def elapsed(seconds: Column) -> Column:
    s = seconds.cast("int")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("int"), (F.floor(s / 60) % 60).cast("int"), s % 60)


def crop_window(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: float = 0.25) -> Column:
    """struct(x1, y1, x2, y2) of the padded window, truncated toward zero and clamped; null if nothing is left.

    A padded window that is empty falls back on the box itself; that being empty means a black crop.
    """

    def clamp(v: Column, most: Column) -> Column:
        return F.least(F.greatest(v.cast("int"), F.lit(0)), most.cast("int"))

    def window(px: Column | float, py: Column | float) -> Column:
        return F.struct(clamp(x - px, width).alias("x1"), clamp(y - py, height).alias("y1"), clamp(x + w + px, width).alias("x2"), clamp(y + h + py, height).alias("y2"))

    padded, bare = window(w * pad, h * pad), window(F.lit(0.0), F.lit(0.0))
    full = lambda s: (s["x2"] > s["x1"]) & (s["y2"] > s["y1"])
    return F.when(full(padded), padded).when(full(bare), bare)


def lr_at(epoch: Column, epochs: int, warmup: int, rate: float) -> Column:
    """Linear warm-up, then cosine to zero."""
    import math

    steps = max(epochs - warmup, 1)
    cosine = F.lit(rate) * (1 + F.cos(F.lit(math.pi) * (epoch - warmup) / steps)) / 2
    return F.when(epoch <= warmup, F.lit(rate) * epoch / max(warmup, 1)).otherwise(cosine)


def portable_key(id_: Column, iteration: Column) -> Column:
    """A pseudo-random order that other engines can repeat, of ids of any size; ties go by id."""
    a = (id_ % 2147483647 * 1103515 + iteration * 104729 + 12345) % 2147483647
    return ((a * a) % 2147483647 * 48271 + iteration * 69621) % 2147483647


def hashed_key(id_: Column, iteration: Column, seed: int = 42) -> Column:
    """The library's own pseudo-random order, below 2**31 as the portable one."""
    return F.pmod(F.xxhash64(F.lit(seed), iteration, id_), F.lit(2147483647))


def key_block(key: Column) -> Column:
    """One of 128 ranges of such keys, by which rows are numbered in parallel."""
    return F.shiftright(key, 24)
