"""One-permutation MinHash fingerprints, in DataFrame functions only.

Each shingle is hashed once.  The top 7 bits of the hash choose one of 128 bins and the smallest hash of a bin stands
for it.  An empty bin i takes the value of the bin that comes first in its own random order of all bins, which is
optimal densification: its probes h(i, 1), h(i, 2) ... up to the first bin that is not empty, drawn without repeats.  The order is
that of b * FACTORS[i] + SHIFTS[i] modulo a prime.  Of each bin the 8 lowest bits are stored.  Unequal values agree in
them with probability C = 2**-8, so a share p of agreeing bins is corrected to (p - C) / (1 - C).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygrid.llm.common import GOLDEN, free_names, mix

BIN_BITS, LOW_BITS = 7, 8
BINS = 1 << BIN_BITS


PRIME = (1 << 31) - 1


def _numbers(first: int) -> list[int]:
    """128 pseudo-random numbers from 1 to PRIME - 1."""
    return [int(x % np.uint64(PRIME - 1)) + 1 for x in mix(np.arange(first, first + BINS, dtype=np.uint64) * GOLDEN)]


FACTORS, SHIFTS = _numbers(1), _numbers(1001)


def _bin(h: Column) -> Column:
    return F.shiftright(h, 64 - BIN_BITS) + (BINS >> 1)


#: The PROBES bins that come first in each bin's order: FIRST[k][i] is number k for bin i.
PROBES = 16
FIRST = [[int(x) for x in row] for row in np.argsort((np.arange(BINS) * np.array(FACTORS)[:, None] + np.array(SHIFTS)[:, None]) % PRIME, axis=1).T[:PROBES]]
WHITE = " \t\n\x0b\x0c\r"


def _listed(values: list[int] | list[str], kind: str = "bigint") -> Column:
    """An array of many constants, which is folded into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _words(text: Column) -> Column:
    """The words between ASCII white space; one empty word if there is none."""
    return F.split(F.btrim(text, F.lit(WHITE)), r"[\x20\x09-\x0D]+", -1)


def _hashes(toks: Column, words: int) -> Column:
    """A hash for each shingle of so many words, in order; fewer words are one shingle.

    The hash of a struct goes through its fields and leaves out nulls, as that of an array does.
    """
    many = F.greatest(F.size(toks) - (words - 1), F.lit(1))
    return F.transform(F.arrays_zip(*[F.slice(toks, F.lit(k), many) for k in range(1, words + 1)]), lambda x: F.xxhash64(x))


def _signed(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """``df`` with ``out``: 128 bytes of the fingerprint of a set of shingle hashes, or null without any hashes."""
    mins, full = free_names([*df.columns, out], 2)
    df = df.withColumn(mins, F.sort_array(hashes))
    # The smallest hash of each bin, as (bin, low bits) in one number, by ascending bins.
    firsts = F.filter(mins, lambda x, i: (i == 0) | (F.shiftrightunsigned(x.bitwiseXOR(F.get(F.col(mins), i - 1)), 64 - BIN_BITS) != 0))
    low = (1 << LOW_BITS) - 1
    df = df.withColumn(mins, F.transform(firsts, lambda x: (_bin(x) * (low + 1)).bitwiseOR(x.bitwiseAND(F.lit(low)))))
    factors, shifts = _listed(FACTORS), _listed(SHIFTS)
    firsts_of = [_listed(row, "int") for row in FIRST]

    def stretch(x: Column, k: Column) -> Column:
        """The value of a full bin and nulls for the empty bins up to the next full one; the first has those before it as well."""
        own = F.shiftright(x, LOW_BITS).cast("int")
        last = F.coalesce(F.shiftright(F.get(F.col(mins), k + 1), LOW_BITS).cast("int"), F.lit(BINS))
        value = F.array((x.bitwiseAND(F.lit(low)) - 128).cast("tinyint"))
        none = F.lit(None).cast("tinyint")
        after = F.concat(value, F.array_repeat(none, last - own - 1))
        return F.when((k == 0) & (own > 0), F.concat(F.array_repeat(none, own), after)).otherwise(after)

    def searched(i: Column) -> Column:
        """The value of the bin that is first in the order of an empty bin i: the low bits of a number whose high bits give the order."""
        order = lambda x: (F.shiftright(x, LOW_BITS) * F.get(factors, i) + F.get(shifts, i)) % PRIME
        least = F.array_min(F.transform(F.col(mins), lambda x: order(x) * (low + 1) + x.bitwiseAND(F.lit(low))))
        return (least.bitwiseAND(F.lit(low)) - 128).cast("tinyint")

    def filled(v: Column, i: Column) -> Column:
        """The value of a full bin, or for an empty one of the first full bin in its order: a few probes find it unless most are empty."""
        probes = F.coalesce(*[F.get(F.col(full), F.get(order, i)) for order in firsts_of])
        return F.coalesce(v, F.when(F.size(mins) >= PROBES // 2, probes), searched(i))

    df = df.withColumn(full, F.flatten(F.transform(F.col(mins), stretch)))
    return df.withColumn(out, F.when(F.size(mins) > 0, F.transform(full, filled))).drop(mins, full)


def with_hashes(df: DataFrame, text: str, out: str, words: int = 5) -> DataFrame:
    """``df`` with ``out``: hashes of the shingles of ``words`` words between ASCII white space; a shorter text is one, one without words none."""
    (toks,) = free_names([*df.columns, out], 1)
    df = df.withColumn(toks, _words(F.col(text)))
    empty = (F.size(toks) == 1) & (F.get(F.col(toks), F.lit(0)) == "")
    return df.withColumn(out, F.when(~empty, _hashes(F.col(toks), words)).otherwise(F.array().cast("array<bigint>"))).drop(toks)


def with_signature(df: DataFrame, text: str, out: str, words: int = 5) -> DataFrame:
    """``df`` with ``out``: 128 bytes of the text's fingerprint, or null for a text without words.

    Shingles are ``words`` words between ASCII white space; a shorter text is one shingle.
    """
    (hashes,) = free_names([*df.columns, out], 1)
    return _signed(with_hashes(df, text, hashes, words), hashes, out).drop(hashes)


def with_edited_hashes(df: DataFrame, left: Column, right: Column, left_hashes: Column, right_hashes: Column, out: str, words: int = 5) -> DataFrame:
    """``df`` with ``out``: the shingle hashes of ``left`` + ``right``, of which each begins a text whose hashes are given.

    All words of ``left`` but the last and all of ``right`` but the first and the last are whole in the given texts, so
    the hashes of their shingles are taken over.  The shingles on the seam and the one that ends ``right`` are hashed anew;
    with few words on a side all are.
    """
    p, q, seam, ends, made, begun, ended = free_names([*df.columns, out], 7)
    df = df.withColumn(begun, _words(left)).withColumn(ended, _words(right))
    own, other = F.col(begun), F.col(ended)
    shared = (F.size(own) >= words) & (F.size(other) > words)
    blank = F.substring(left, -1, 1).isin(*WHITE) | F.substring(right, 1, 1).isin(*WHITE)
    joint = F.concat(
        F.array_join(F.slice(own, F.size(own) - (words - 1), F.lit(words)), " "),
        F.when(blank, " ").otherwise(""),
        F.array_join(F.slice(other, F.lit(1), F.lit(words)), " "),
    )
    last = F.slice(other, F.size(other) - (words - 1), F.lit(words))
    none = F.array().cast("array<bigint>")
    df = df.select(
        "*",
        F.when(shared, F.size(own) - words).otherwise(0).alias(p),
        F.when(shared, F.size(other) - words - 1).otherwise(0).alias(q),
        F.when(shared, joint).otherwise(F.concat(left, right)).alias(seam),
        F.when(shared, F.array(F.xxhash64(last))).otherwise(none).alias(ends),
    )
    df = with_hashes(df.drop(begun, ended), seam, made, words)
    parts = [F.slice(left_hashes, F.lit(1), F.col(p)), F.slice(right_hashes, F.lit(2), F.col(q)), F.col(made), F.col(ends)]
    return df.withColumn(out, F.concat(*parts)).drop(p, q, seam, ends, made, begun, ended)


def packed(sig: Column) -> Column:
    """A fingerprint as hexadecimal digits, two for each bin; empty for a text without words."""
    digits = _listed([f"{v:02x}" for v in range(256)], "string")
    return F.coalesce(F.array_join(F.transform(sig, lambda v: F.get(digits, v.cast("int") + 128)), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The corrected share of agreeing bins, 0 to 1; texts without words are like each other and nothing else."""
    same = F.size(F.array_remove(F.zip_with(a, b, lambda x, y: x == y), False))
    c = 1.0 / (1 << LOW_BITS)
    share = (same / F.lit(float(BINS)) - c) / (1 - c)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(share, F.lit(0.0)))


def with_next(df: DataFrame, id_col: str, text_col: str, carried: list[str], out: str, rows_per_bucket: int = 2000, derived: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``df`` with a struct ``out`` of the ``carried`` columns of the next row by (id, text), null ids first; after the last the first.

    ``derived`` adds columns behind the exchange and the sort, so they cost neither; they may be carried.

    Ids are cut into ranges at quantiles, themselves ids that occur.  A row that begins a range is also sent to the
    range before it, so that every range finds its last row's follower without a global sort: one exchange.
    """
    ids, bucket, at, side = free_names([*df.columns, out], 4)
    df = df.withColumn(ids, F.col(id_col).cast("long"))
    n, low, known = df.agg(F.count("*"), F.min(ids), F.count(ids)).first()
    if not n:
        return derived(df.drop(ids)).withColumn(out, F.struct(*carried))
    first = F.col(ids).isNull() if known < n else F.col(ids) == low
    parts = min(65_536, n // rows_per_bucket + 1)
    cuts = df.agg(F.percentile_approx(ids, [i / parts for i in range(1, parts)] or [0.5], max(10_000, 8 * parts))).first()[0] if parts > 1 else []
    cuts = sorted({c for c in cuts or [] if c > low or known < n})
    step = max(1, math.isqrt(len(cuts)))

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: F.coalesce(c <= F.col(ids), F.lit(False))))

    number, begins = F.lit(0), F.lit(False)
    if cuts:
        fine = F.array(*[F.lit(c).cast("long") for c in cuts])
        coarse = below(F.array(*[F.lit(c).cast("long") for c in cuts[step - 1 :: step]])) * step
        number = coarse + below(F.slice(fine, coarse + 1, F.lit(step)))
        begins = F.get(fine, F.col(bucket) - 1) == F.col(ids)
    df = df.withColumn(bucket, number)
    places = F.array(
        F.struct(F.col(bucket).alias("b"), F.lit(0).alias("s")),
        F.when((F.col(bucket) > 0) & begins, F.struct((F.col(bucket) - 1).alias("b"), F.lit(1).alias("s"))),
        F.when(first, F.struct(F.lit(len(cuts)).alias("b"), F.lit(1).alias("s"))),
    )
    df = df.withColumn(at, F.explode(F.filter(places, lambda x: x.isNotNull())))
    df = df.withColumn(bucket, F.col(f"{at}.b")).withColumn(side, F.col(f"{at}.s")).drop(at)
    order = [F.col(side), F.col(ids).asc_nulls_first(), F.col(text_col)]
    df = derived(df.repartition(bucket).sortWithinPartitions(bucket, *order))
    df = df.withColumn(out, F.lead(F.struct(*carried)).over(Window.partitionBy(bucket).orderBy(*order)))
    return df.where(F.col(side) == 0).drop(ids, bucket, side)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(doc_id, fingerprint, sig) of every row; nulls count as empty texts, whose fingerprint is empty."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = with_signature(own, "text", "sig", words)
    return own.select("doc_id", packed(F.col("sig")).alias("fingerprint"), "sig")


def edited_fingerprints(docs: DataFrame, *, words: int = 5) -> DataFrame:
    """Fingerprints of documents, of their edited texts and the likeness to those and to the next document.

    The edited text ends in the first floor(n_chars / 2) code points of the next document by (doc_id, text) in
    place of as many of its own.  Null texts are empty; null ids come first; rows that repeat an id follow
    one another by text; a single row follows itself.  Other columns are not looked at.
    """
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = with_next(own, "doc_id", "text", ["text", "hashes", "sig"], "next", derived=lambda df: _signed(with_hashes(df, "text", "hashes", words), "hashes", "sig"))
    own = own.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    left, right = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next.text"), F.lit(1), half)
    own = own.select("doc_id", "n_chars", "sig", F.col("next.sig").alias("next_sig"), left.alias("left"), right.alias("right"), "hashes", F.col("next.hashes").alias("next_hashes"))
    own = with_edited_hashes(own, F.col("left"), F.col("right"), F.col("hashes"), F.col("next_hashes"), "edited_hashes", words)
    own = own.select("doc_id", "n_chars", "sig", "next_sig", F.concat("left", "right").alias("edited"), "edited_hashes")
    own = _signed(own, "edited_hashes", "edited_sig")
    return own.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("sig")).alias("fingerprint"),
        packed(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
