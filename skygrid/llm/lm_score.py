"""Language-model scoring by cross-entropy difference.

Two bigram models, of a target set and of the background, share one vocabulary (all words of both) and one smoothing, so they are
matched but for what was counted:

    P(w | v) = PAIR c(v, w) / c(v) + WORD c(w) / N + POOL (c(w) of both) / (N of both)

A token's loss is -log2 of its probability after the word before it; a document's score is the mean over its tokens of
target loss less background loss (Moore and Lewis, 2010).  Low scores read like the target.

Every word, context and pair has its own count, known by a 64-bit hash, so the models grow with the corpus and are neither
broadcast nor collected.  Documents are dealt into blocks of bounded bytes.  A block asks for its distinct keys, cut by key
range into buckets; a bucket adds up what all blocks hold of a key and answers each block with the totals in the order it
asked; the block, whose texts are read from the same shuffle again, scores its documents.  What moves is the texts once,
a key once for each block that has it, and two numbers back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrid.llm.common import GOLDEN, mix, row_chunks, run_hashes, runs, small_batches, text_buffers

#: Bytes of text that a block holds, but for the last text in it; as many buckets as blocks.
BLOCK_BYTES = 8 << 20
BEGIN = np.uint64(0x5851F42D4C957F2D)
WORD_SEED, CONTEXT_SEED = np.uint64(0x3C79AC492BA7B653), np.uint64(0x1C69B3F74AC4AE35)
PAIR, WORD, POOL = 0.6, 0.35, 0.05

REQUEST = "block long, bucket long, keys binary, counts binary"
ANSWER = "block long, bucket long, target binary, background binary"
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def token_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its key, the key of what stands before it as a context (another word or the beginning), the pair's key, its row.

    Words stand between ASCII white space; A-Z count as a-z.
    """
    starts, ends, rows = runs(data, offsets)
    h = run_hashes(data, starts, ends)
    if not len(h):
        return h, h, h, rows
    before = np.r_[BEGIN, h[:-1]]
    before[np.r_[True, rows[1:] != rows[:-1]]] = BEGIN
    return mix(h ^ WORD_SEED), mix(before ^ CONTEXT_SEED), mix(h + mix(before * GOLDEN)), rows


def _chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffers(column)
    for i, j in row_chunks(offsets):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def distinct_keys(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a column of texts, ascending, and how often each occurs."""
    parts = [np.unique(np.concatenate(token_keys(d, o)[:3]), return_counts=True) for _, _, d, o in _chunks(column)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of keys begins in ascending keys, and the end."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))


def pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane: the high planes of small ones are zeros, which a shuffle compresses away."""
    return numbers.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(raw: list[bytes]) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<u8").ravel() for x in raw]
    return np.concatenate([np.zeros(0, np.uint64), *parts])


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack([raw]), dtype=np.uint64)


def _request(block: int | None, column: pa.Array | pa.ChunkedArray, buckets: int) -> pa.RecordBatch:
    keys, counts = distinct_keys(column)
    at = bucket_bounds(keys, buckets)
    full = np.flatnonzero(at[1:] > at[:-1])
    cuts = [slice(at[b], at[b + 1]) for b in full]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block] * len(full), pa.int64()),
            pa.array(full, pa.int64()),
            pa.array([pack_keys(keys[c]) for c in cuts], pa.binary()),
            pa.array([pack(counts[c]) for c in cuts], pa.binary()),
        ],
        ["block", "bucket", "keys", "counts"],
    )


def _answer(table: pa.Table) -> pa.Table:
    """The totals of the target (rows without a block) and of the background for each block's keys in one bucket."""
    blocks = table.column("block").to_pylist()
    keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    sizes = np.array([len(k) for k in keys])
    counts = unpack(table.column("counts").to_pylist())
    of_target = np.repeat([b is None for b in blocks], sizes)
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = [np.bincount(at, counts * own).astype(np.uint64)[at] for own in (of_target, ~of_target)]
    ends = np.cumsum(sizes)
    asked = [k for k, b in enumerate(blocks) if b is not None]
    sums = [pa.array([pack(t[ends[k] - sizes[k] : ends[k]]) for k in asked], pa.binary()) for t in totals]
    own = pa.array([blocks[k] for k in asked], pa.int64())
    return pa.table([own, pa.array([table.column("bucket")[0].as_py()] * len(asked), pa.int64()), *sums], ["block", "bucket", "target", "background"])


def token_losses(words: np.ndarray, contexts: np.ndarray, pairs: np.ndarray, pooled: np.ndarray, total: int) -> np.ndarray:
    """-log2 of each token's probability in a model of ``total`` tokens, from counts of its word, context and pair."""
    return -np.log2(PAIR * pairs / np.maximum(contexts, 1) + WORD * words / max(total, 1) + POOL * pooled)


def _score(docs: pa.Table, answers: pa.Table, totals: tuple[int, int]) -> pa.Table:
    text, ids = docs.column("text"), docs.column("doc_id").combine_chunks()
    keys, _ = distinct_keys(text)
    answers = answers.sort_by("bucket")
    sums = [unpack(answers.column(c).to_pylist()).astype(np.int64) for c in ("target", "background")]
    if any(len(s) != len(keys) for s in sums):
        raise AssertionError("a block's answers don't fit its keys")
    n, losses = np.zeros(len(docs), np.int64), np.zeros((2, len(docs)))
    for i, j, data, offsets in _chunks(text):
        *kinds, rows = token_keys(data, offsets)
        if not len(rows):
            continue
        at = [np.searchsorted(keys, k) for k in kinds]
        pooled = (sums[0][at[0]] + sums[1][at[0]]) / sum(totals)
        n[i:j] = np.bincount(rows, minlength=j - i)
        for m in (0, 1):
            losses[m, i:j] = np.bincount(rows, token_losses(*(sums[m][a] for a in at), pooled, totals[m]), minlength=j - i)
    target, background = losses / np.maximum(n, 1)
    return pa.table([ids, pa.array(n), pa.array(target), pa.array(background), pa.array(target - background)], [x.split()[0] for x in SCORES.split(", ")])


def _sizes(texts: DataFrame) -> tuple[int, int]:
    """Bytes and tokens of a one-column table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, tokens = 0, 0
        for batch in batches:
            for _, _, data, offsets in _chunks(batch.column(0)):
                size, tokens = size + len(data), tokens + len(runs(data, offsets)[0])
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([tokens], pa.int64())], ["size", "tokens"])

    row = texts.mapInArrow(run, "size long, tokens long").agg(F.sum("size"), F.sum("tokens")).first()
    return row[0] or 0, row[1] or 0


def cross_entropy_difference(docs: DataFrame, target: DataFrame, *, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for each row of ``docs``; the background is all of ``docs``.

    ``target`` has a column ``text``; without tokens in it a target loss comes from the pooled words alone.  A null, empty or blank
    text has no tokens, losses and score 0.  Rows that repeat an id are scored each, null ids stay null, other columns are not
    looked at, an empty table gives no rows.  A block's memory is bounded by ``block_bytes`` and the longest text; rows equal
    in id and text share a block.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    goal = target.select(F.col("text").cast("string").alias("text"))
    size, n_background = _sizes(own.select("text"))
    totals = (_sizes(goal)[1], n_background)
    blocks = max(1, -(-size // block_bytes))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_request(key[0].as_py(), table.column("text"), blocks)])

    def ask_of_target(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _request(None, batch.column(0), blocks)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score(left, right, totals)

    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    asked = dealt.groupBy("block").applyInArrow(ask, REQUEST).unionByName(goal.mapInArrow(ask_of_target, REQUEST))
    answers = asked.groupBy("bucket").applyInArrow(_answer, ANSWER)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)
