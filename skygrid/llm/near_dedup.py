"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles becomes MinHash values of 16 bits each.  The first of them are split into chunks of 4.
If two signatures of n chunks differ in at most 2 * n - 1 of those places, the pigeonhole principle leaves a chunk with at
most one difference; so each chunk is indexed once for each allowed error, that place left out, and every pair
under the distance threshold meets in some index key.  ``Plan`` derives the number of chunks from the likeness asked for: at
0.85 and 0.8 there are 7, which a pair at 0.85 fails all with probability 2e-7, and one at 0.8 with 6e-6.

Links are confirmed on the full shingle sets.  Equal sets are one class, so copies never multiply.  In an index key
every class is first held against the key's smallest class only; what those links join needs no further look.
Only classes of one key that are still in different components are compared with one another, in blocks, however many there
are; nothing is capped.  There a second signature of 512 values of 8 bits decides which pairs are worth reading, and a
pair is told by the first of the keys it shares only.  Such pairs are never rows: a block keeps a list of partners for each
class, fetches each text once, and gives the links of a spanning forest, so what is written grows with the members of a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrid.llm.common import GOLDEN, cut, mix, row_chunks, run_hashes, runs, small_batches, text_buffers
from skygrid.llm.components import connected

PLACES, WIDE = 4, 512
#: Probabilities that a pair at the threshold fails all chunks, and that it exceeds either signature's bound.
MISS, FAR_MISS = 1e-5, 2e-7


@dataclass(frozen=True)
class Plan:
    """What a threshold asks for: number of chunks, of 16-bit values, and the most differing ones of those and of the 512 8-bit values."""

    chunks: int
    size: int
    far: int
    far_wide: int

    @staticmethod
    def of(percent: int) -> Plan:
        if not 30 <= percent <= 100:
            raise ValueError("near-duplicates are found at 30 to 100 percent")
        s = percent / 100
        fails = 1 - s**PLACES - PLACES * s ** (PLACES - 1) * (1 - s)
        chunks = max(7, math.ceil(math.log(MISS) / math.log(fails))) if fails > 0 else 7
        size = max(64, chunks * PLACES)
        return Plan(chunks, size, _tail(size, (1 - s) * (1 - 2.0**-16)), _tail(WIDE, (1 - s) * (1 - 2.0**-8)))


def _tail(n: int, p: float) -> int:
    """The smallest number that a binomial one exceeds with probability FAR_MISS at most."""
    above, k = 0.0, n
    while k > 0:
        above += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if above > FAR_MISS:
            return k
        k -= 1
    return 0


BLOCK = 1024
_A32 = (mix(np.arange(2001, WIDE + 2001, dtype=np.uint64) * GOLDEN) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B32 = (mix(np.arange(3001, WIDE + 3001, dtype=np.uint64) * GOLDEN) >> np.uint64(32)).astype(np.uint32)
_A = mix(np.arange(1, 1001, dtype=np.uint64) * GOLDEN) | np.uint64(1)
_B = mix(np.arange(1001, 2001, dtype=np.uint64) * GOLDEN)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles; a shorter text is one shingle, no words none."""
    starts, ends, rows = runs(data, offsets)
    h = run_hashes(data, starts, ends)
    n, m = len(offsets) - 1, len(h) - words + 1
    odd = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    if m > 0:
        s = h[:m] * odd[0]
        for j in range(1, words):
            s += h[j : j + m] * odd[j]
        whole = rows[:m] == rows[words - 1 :]
        s, at = mix(s[whole]), rows[:m][whole]
    else:
        s, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends_at = np.cumsum(np.bincount(at, minlength=n))
    n_words = np.bincount(rows, minlength=n)
    first = np.cumsum(n_words) - n_words
    out, begin = [], 0
    for i in range(n):
        if 0 < n_words[i] < words:
            own = h[first[i] : first[i] + n_words[i]]
            out.append(mix(np.array([(own * odd[: len(own)]).sum() + np.uint64(len(own))], np.uint64)))
        else:
            out.append(np.unique(s[begin : ends_at[i]]))
        begin = ends_at[i]
    return out


def signature(sets: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``size`` 16-bit and of 512 8-bit MinHash values; zeros for empty sets."""
    out, wide = np.zeros((len(sets), size), np.uint16), np.zeros((len(sets), WIDE), np.uint8)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        lengths = np.array([len(sets[i]) for i in full])
        starts = np.cumsum(lengths) - lengths
        flat = np.concatenate([sets[i] for i in full])
        scratch = np.empty_like(flat)
        for k in range(size):
            np.bitwise_xor(flat, _B[k], out=scratch)
            np.multiply(scratch, _A[k], out=scratch)
            out[full, k] = mix(np.minimum.reduceat(scratch, starts)) & np.uint64(0xFFFF)
        short = (flat >> np.uint64(32)).astype(np.uint32)
        scratch, least = np.empty_like(short), np.empty((WIDE, len(full)), np.uint32)
        for k in range(WIDE):
            np.bitwise_xor(short, _B32[k], out=scratch)
            np.multiply(scratch, _A32[k], out=scratch)
            np.minimum.reduceat(scratch, starts, out=least[k])
        wide[full] = (mix(least.astype(np.uint64)) & np.uint64(0xFF)).T
    return out, wide


def signatures(docs: DataFrame, words: int, size: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, lo, hi, sig, wide): set size, two 64-bit hashes of the set, packed signatures."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in row_chunks(offsets, 1 << 20):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                sums = [mix(s) for s in sets]
                lo = np.array([s.sum(dtype=np.uint64) for s in sums], np.uint64)
                hi = np.array([np.bitwise_xor.reduce(mix(s + GOLDEN)) if len(s) else 0 for s in sums], np.uint64)
                sig, wide = signature(sets, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(lo.view(np.int64)),
                        pa.array(hi.view(np.int64)),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                        pa.array([x.tobytes() for x in wide], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "lo", "hi", "sig", "wide"],
                )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_shingles long, lo long, hi long, sig binary, wide binary")


def _sigs(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint16).reshape(len(column), -1 if len(column) else 64)


def index_keys(classes: DataFrame, chunks: int) -> DataFrame:
    """(key, rep): for each chunk of a class's signature the keys with one place left out, exact, not hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, keys = _sigs(batch.column(1)).astype(np.int64), []
            for c in range(chunks):
                chunk = sig[:, c * PLACES : (c + 1) * PLACES]
                for out in range(PLACES):
                    key = np.full(len(sig), c * PLACES + out, np.int64)
                    for p in range(PLACES):
                        if p != out:
                            key = (key << 16) | chunk[:, p]
                    keys.append(key)
            reps = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(reps, len(keys)))], ["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _near(pairs: DataFrame, classes: DataFrame, far: int) -> DataFrame:
    """Pairs (a, b) whose signatures differ in at most ``far`` places."""
    sig = classes.select("rep", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = (_sigs(batch.column(2)) != _sigs(batch.column(3))).sum(axis=1) <= far
            yield batch.select([0, 1]).filter(pa.array(keep))

    own = pairs.join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    own = own.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
    return own.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _column_sets(column: pa.Array | pa.ChunkedArray, words: int) -> list[np.ndarray]:
    data, offsets = text_buffers(column)
    return [s for i, j in row_chunks(offsets, 1 << 20) for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)]


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets, false if one is empty."""
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    if not len(short) or len(short) * 100 < percent * len(long):
        return False
    at = np.searchsorted(long, short)
    both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _bounds(table: pa.Table) -> np.ndarray:
    """Where the runs of equal (key, p) begin, and the end."""
    key, p = table.column("key").to_numpy(), table.column("p").to_numpy()
    return np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (p[1:] != p[:-1])) + 1, len(key)]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole (key, p) groups from batches in which a group's rows stand together."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        last = int(_bounds(held)[-2]) if len(held) else 0
        if last:
            yield held.slice(0, last)
            held = held.slice(last)
    if held is not None and len(held):
        yield held


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on the full shingle sets of whole texts.

    ``docs`` has doc_id and text.  The side a may repeat without bound: its text is joined last and goes
    straight to the comparison.
    """
    small_batches(docs.sparkSession, 500)
    ids = pairs.select(F.col("a").alias("doc_id")).distinct().union(pairs.select(F.col("b").alias("doc_id")).distinct()).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi")
    own = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    own = own.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def sets(column: pa.Array) -> list[np.ndarray]:
        return _column_sets(column, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column(0).to_numpy(zero_copy_only=False)
            text_a = batch.column(2)
            new = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
            if len(new) < 0.8 * len(a):  # runs of one id may hold several texts only if the id repeats; then compare texts too
                as_text = text_a.to_pylist()
                new = np.array([i for i in range(len(a)) if i == 0 or a[i] != a[i - 1] or as_text[i] != as_text[i - 1]])
            else:
                new = np.arange(len(a))
            left = sets(text_a.take(pa.array(new)))
            of = np.searchsorted(new, np.arange(len(a)), side="right") - 1
            keep = np.zeros(len(a), bool)
            for i, right in enumerate(sets(batch.column(3))):
                keep[i] = _alike(left[of[i]], right, percent)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return own.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _first_key(x: np.ndarray, y: np.ndarray, chunks: int) -> np.ndarray:
    """Number of the first index key that signatures ``x`` share with ``y``, for pairs that share one."""
    same = (x[..., : chunks * PLACES] == y[..., : chunks * PLACES]).reshape(-1, chunks, PLACES)
    chunk = (same.sum(axis=2) >= PLACES - 1).argmax(axis=1)
    own = same[np.arange(len(same)), chunk]
    return chunk * PLACES + np.where(own.all(axis=1), 0, (~own).argmax(axis=1))


def _block_pairs(rows: DataFrame, far: int, chunks: int) -> DataFrame:
    """Near pairs inside (key, pair of blocks) groups as (key, p, doc_id, others), others being the larger ends.

    Rows (key, p, blk, rep, comp, sig, wide) of one group stand together.  Each end of a pair gets one row.
    """

    def compare(number: int, blk: np.ndarray, rep: np.ndarray, comp: np.ndarray, sig: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, last = blk.min(), blk.max()
        left = np.flatnonzero(blk == first)
        right = left if first == last else np.flatnonzero(blk == last)
        a, b = [], []
        for i in left:
            other = right[right > i] if first == last else right
            other = other[comp[other] != comp[i]]
            other = other[(wide[other] != wide[i]).sum(axis=1) <= far]
            if len(other):
                other = other[_first_key(sig[other], sig[i], chunks) == number]
                a.append(np.minimum(rep[i], rep[other]))
                b.append(np.maximum(rep[i], rep[other]))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            yield from done(table)

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, p = table.column("key").to_numpy(), table.column("p").to_numpy()
        bounds = _bounds(table)
        blk, rep, comp = (table.column(c).to_numpy() for c in ("blk", "rep", "comp"))
        sig = _sigs(table.column("sig"))
        wide = np.frombuffer(b"".join(table.column("wide").to_pylist()), np.uint8).reshape(-1, WIDE)
        number = key >> 48
        a, b, row = [], [], []
        sizes = np.diff(bounds)
        two = bounds[:-1][sizes == 2]
        if len(two):
            two = two[comp[two] != comp[two + 1]]
            two = two[(wide[two] != wide[two + 1]).sum(axis=1) <= far]
            two = two[_first_key(sig[two], sig[two + 1], chunks) == number[two]]
            a.append(np.minimum(rep[two], rep[two + 1]))
            b.append(np.maximum(rep[two], rep[two + 1]))
            row.append(two)
        for i in np.flatnonzero(sizes > 2):
            s = slice(bounds[i], bounds[i + 1])
            x, y = compare(int(number[bounds[i]]), blk[s], rep[s], comp[s], sig[s], wide[s])
            a.append(x)
            b.append(y)
            row.append(np.full(len(x), bounds[i]))
        if sum(map(len, a)):
            yield partners(key, p, np.concatenate(row), np.concatenate(a), np.concatenate(b))

    def partners(key: np.ndarray, p: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((b, a, row))
        row, a, b = row[order], a[order], b[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (a[1:] != a[:-1])])
        count = np.diff(np.r_[first, len(a)])
        # The larger ends need their texts as well; those that are a smaller end too have a row already.
        ids, rows_of = np.r_[a[first], b], np.r_[row[first], row]
        n_others = np.r_[count, np.zeros(len(b), np.int64)]
        _, one = np.unique(np.stack([rows_of, ids]), axis=1, return_index=True)
        one.sort()
        offsets = np.r_[0, np.cumsum(n_others[one])]
        return pa.RecordBatch.from_arrays(
            [pa.array(key[rows_of[one]]), pa.array(p[rows_of[one]]), pa.array(ids[one]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(b))],
            ["key", "p", "doc_id", "others"],
        )

    return rows.mapInArrow(run, "key long, p long, doc_id long, others array<long>")


def confirmed_in_groups(lists: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between the doc_id and the others of rows (key, p, doc_id, others), on the sets of whole texts.

    Every other id has a row of its own in its (key, p) group.  A pair whose ends are joined already by links of
    the same group is left out: components stay the same.
    """
    small_batches(docs.sparkSession, 500)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = lists.join(texts, "doc_id").select("key", "p", "doc_id", "others", "text")

    def links(table: pa.Table) -> tuple[list[int], list[int]]:
        ids, others = table.column("doc_id").to_pylist(), table.column("others").to_pylist()
        sets = _column_sets(table.column("text"), words)
        at, root, a, b = {}, {x: x for x in ids}, [], []
        for i, x in enumerate(ids):
            at.setdefault(x, []).append(i)

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, x in enumerate(ids):
            for y in others[i]:
                if top(x) != top(y) and any(_alike(sets[i], sets[j], percent) for j in at[y]):
                    root[top(y)] = top(x)
                    a.append(x)
                    b.append(y)
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            bounds, a, b = _bounds(table), [], []
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                x, y = links(table.slice(int(i), int(j - i)))
                a += x
                b += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return own.repartition("key", "p").sortWithinPartitions("key", "p").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked if 100 * |A & B| >= percent * |A | B| on their sets of ``words``-word shingles, with A-Z
    lower-cased and words split at ASCII white space.  ``component_id`` is the smallest id reachable.
    Null or empty texts and texts of white space have no shingles and no links.  A null id links with nothing and is
    kept, its component null.  Rows that repeat an id belong together.  Other columns are not looked at.  An
    empty table gives no rows.  A ``percent`` below 30 is an error.
    """
    plan = Plan.of(percent)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = cut(signatures(docs, words, plan.size))
    small_batches(docs.sparkSession)
    some = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = cut(some.groupBy("lo", "hi", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"), F.min("wide").alias("wide")))

    keys = index_keys(classes, plan.chunks)
    buckets = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = cut(keys.join(buckets, "key").where("rep != pivot"))
    star = cut(_near(members.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), classes, plan.far))
    links = cut(confirmed(star, docs, words, percent))
    comps = connected(links)

    # What is left of each key: classes, but for its pivot, that lie in different components.
    left = members.where("n > 2").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    left = left.select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    open_keys = left.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).where("x < y")
    open_keys = open_keys.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"))
    rows = left.join(open_keys, "key").withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    rows = rows.join(classes.select("rep", "sig", "wide"), "rep")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.withColumn("p", F.least("blk", "other").cast("long") * F.lit(1 << 31) + F.greatest("blk", "other"))
    rows = rows.select("key", "p", "blk", "rep", "comp", "sig", "wide").repartition("key", "p").sortWithinPartitions("key", "p")
    more = cut(confirmed_in_groups(cut(_block_pairs(rows, plan.far_wide, plan.chunks)), docs, words, percent))
    if not more.isEmpty():
        comps = connected(links.unionAll(more))

    found = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("lo", "hi", "n_shingles", F.coalesce("component", "rep").alias("of"))
    out = sigs.drop("sig", "wide").join(found, ["lo", "hi", "n_shingles"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("of")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
