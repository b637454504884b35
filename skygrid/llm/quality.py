"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every token has a fixed sparse ternary index vector.  A token's context vector is the sum of the index vectors of its
neighbours over all documents, less what the frequencies of tokens alone would give (Kanerva et al., 2000); its word vector is
that sum's signs, one bit a component.  Every token of the corpus has a vector of its own, known by a 64-bit hash: sums and vectors
lie in a distributed table that grows with the vocabulary, cut by key range into buckets.

Texts to score are never moved.  Tasks turn them into blocks of bounded bytes, a bag of token numbers for each document and the
block's distinct tokens; blocks ask buckets for the vectors of their tokens.  A document is the mean of its tokens' vectors.  The
network is trained in numpy; a temperature fitted on rows that it didn't train on calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrid.llm.common import GOLDEN, cut, free_names, kind_runs, mix, row_chunks, run_hashes, small_batches, text_buffers
from skygrid.llm.lm_score import bucket_bounds
from skygrid.llm.tokens import _KINDS

DIM, NONZERO, WINDOW = 64, 2, 2
REPEAT = np.uint64(0)
#: Bytes of text that a block holds, but for the last text in it, and for which there is a bucket.
BLOCK_BYTES, BUCKET_BYTES = 32 << 20, 32 << 20
SUMS = "bucket long, keys binary, counts binary, sums binary"


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes, signs folded in, high planes of zeros left out."""
    n = numbers.astype(np.int64, copy=False).ravel()
    n = ((n << 1) ^ (n >> 63)).view(np.uint64)
    planes = max(1, -(-int(n.max()).bit_length() // 8)) if len(n) else 1
    raw = b"".join((n >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in range(planes))
    return np.array([len(n), planes], "<i8").tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    size, planes = (int(x) for x in np.frombuffer(raw, "<i8", 2))
    parts = np.frombuffer(pa.decompress(raw[16:], size * planes, "zstd", asbytes=True), np.uint8).reshape(planes, size)
    n = np.zeros(size, np.uint64)
    for k in range(planes):
        n |= parts[k].astype(np.uint64) << np.uint64(8 * k)
    return (n >> np.uint64(1)).view(np.int64) ^ -(n & np.uint64(1)).view(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)).view(np.int64))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw).view(np.uint64), dtype=np.uint64)


def index_vectors(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero components of each token's index vector."""
    draws = mix(mix(keys)[:, None] + np.arange(1, NONZERO + 1, dtype=np.uint64) * GOLDEN)
    return (draws % np.uint64(DIM)).astype(np.int64), np.where((draws >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def token_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit key and document of each token: a run of letters, digits or punctuation.

    A word equal to the token before, or to the one before that, is the token "repeat": a bag wouldn't tell a stuttering
    text from one that uses the same words, and the token has a word vector like any other.
    """
    starts, ends, docs = kind_runs(_KINDS[data], offsets)
    h = run_hashes(data, starts, ends, fold=False)
    keys = np.maximum(h, np.uint64(1))
    letters = _KINDS[data[starts]] == 1 if len(starts) else np.zeros(0, bool)
    for back in (1, 2):
        if len(h) > back:
            same = (h[back:] == h[:-back]) & (docs[back:] == docs[:-back]) & letters[back:]
            keys[back:][same] = REPEAT
    return keys, docs


def _chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffers(column)
    for i, j in row_chunks(offsets, 1 << 19):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


Sums = tuple[np.ndarray, np.ndarray, np.ndarray]
NONE: Sums = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, DIM), np.int32))


def contexts(data: np.ndarray, offsets: np.ndarray) -> Sums:
    """The distinct tokens, ascending; how many neighbours each has within the window, and the sum of their index vectors."""
    tokens, docs = token_keys(data, offsets)
    keys, own = np.unique(tokens, return_inverse=True)
    places, signs = index_vectors(keys)
    counts, at, weight = np.zeros(len(keys), np.int64), [np.zeros(0, np.int64)], [np.zeros(0)]
    for gap in range(1, WINDOW + 1):
        near = np.flatnonzero(docs[gap:] == docs[:-gap]) if len(docs) > gap else np.zeros(0, np.int64)
        for a, b in ((own[near], own[near + gap]), (own[near + gap], own[near])):
            at.append((a[:, None] * DIM + places[b]).ravel())
            weight.append(signs[b].ravel())
            counts += np.bincount(a, minlength=len(keys))
    sums = np.bincount(np.concatenate(at), np.concatenate(weight), minlength=len(keys) * DIM)
    return keys, counts, sums.astype(np.int32).reshape(-1, DIM)


def merged(parts: list[Sums]) -> Sums:
    """The totals of several tables of contexts."""
    keys = np.unique(np.concatenate([NONE[0], *(p[0] for p in parts)]))
    counts, sums = np.zeros(len(keys), np.int64), np.zeros((len(keys), DIM), np.result_type(np.int32, *(p[2] for p in parts)))
    for own, n, part in parts:
        at = np.searchsorted(keys, own)
        counts[at] += n
        sums[at] += part
    return keys, counts, sums


def _rows(table: Sums, buckets: int) -> pa.RecordBatch:
    keys, counts, sums = table
    at = bucket_bounds(keys, buckets)
    full = np.flatnonzero(at[1:] > at[:-1])
    cuts = [slice(at[b], at[b + 1]) for b in full]
    columns = [[pack_keys(keys[c]) for c in cuts], [pack(counts[c]) for c in cuts], [pack(sums[c]) for c in cuts]]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "keys", "counts", "sums"])


def _total(table: pa.Table) -> Sums:
    """A bucket's totals from what tasks counted, a row at a time."""
    columns = [table.column(c) for c in ("keys", "counts", "sums")]
    keys = np.zeros(0, np.uint64)
    for raw in columns[0]:
        keys = np.union1d(keys, unpack_keys(raw.as_py()))
    counts, sums = np.zeros(len(keys), np.int64), np.zeros((len(keys), DIM), np.int64)
    for k, n, part in zip(*columns, strict=True):
        at = np.searchsorted(keys, unpack_keys(k.as_py()))
        counts[at] += unpack(n.as_py())
        sums[at] += unpack(part.as_py()).reshape(-1, DIM)
    return keys, counts, sums


def signs(counts: np.ndarray, sums: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Word vectors from context sums, a bit for each component: whether it is above what ``usual`` neighbours would give."""
    return np.packbits(sums > counts[:, None] * usual, axis=1, bitorder="little").view("<u8").ravel()


@dataclass
class Words:
    """A row (bucket, keys, vectors) for each bucket of tokens, and the number of buckets."""

    table: DataFrame
    buckets: int


def _usual(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Bytes of a one-column table of texts, and the mean index vector of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total = 0, np.zeros(DIM + 1)
        for batch in batches:
            for _, _, data, offsets in _chunks(batch.column(0)):
                keys, n = np.unique(token_keys(data, offsets)[0], return_counts=True)
                places, weights = index_vectors(keys)
                total += np.r_[np.bincount(places.ravel(), (weights * n[:, None]).ravel(), minlength=DIM), n.sum()]
                size += len(data)
        yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([total.astype(np.int64).tobytes()], pa.binary())], ["size", "total"])

    size, total = 0, np.zeros(DIM + 1, np.int64)
    for row in texts.mapInArrow(run, "size long, total binary").collect():  # 66 numbers a task
        size, total = size + row["size"], total + np.frombuffer(row["total"], np.int64)
    return size, total[:DIM] / max(1, total[DIM])


def word_vectors(texts: DataFrame, *, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> Words:
    """The word vector of every token of a one-column table."""
    size, usual = _usual(texts)
    buckets = max(1, -(-size // bucket_bytes))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, size = NONE, [], 0
        for batch in batches:
            for _, _, data, offsets in _chunks(batch.column(0)):
                parts.append(contexts(data, offsets))
                size += len(data)
                if len(parts) >= 8:
                    held, parts = merged([held, *parts]), []
                if size >= block_bytes:
                    yield _rows(merged([held, *parts]), buckets)
                    held, parts, size = NONE, [], 0
        yield _rows(merged([held, *parts]), buckets)

    def finish(table: pa.Table) -> pa.Table:
        keys, counts, sums = _total(table)
        row = [pa.array([x], pa.binary()) for x in (pack_keys(keys), signs(counts, sums, usual).tobytes())]
        return pa.table([table.column("bucket").slice(0, 1), *row], ["bucket", "keys", "vectors"])

    return Words(cut(texts.mapInArrow(add, SUMS).groupBy("bucket").applyInArrow(finish, "bucket long, keys binary, vectors binary")), buckets)


def _answer(asked: pa.Table, table: pa.Table) -> pa.Table:
    """The vectors of one bucket for each block's keys in it, and which of those keys it doesn't have."""
    keys, vectors = NONE[0], NONE[0]
    if len(table):
        keys, vectors = unpack_keys(table.column("keys")[0].as_py()), np.frombuffer(table.column("vectors")[0].as_py(), "<u8")
    out: tuple[list[bytes], list[bytes]] = ([], [])
    for raw in asked.column("keys"):
        own = unpack_keys(raw.as_py())
        found, known = np.zeros(len(own), np.uint64), np.zeros(len(own), bool)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            known = keys[at] == own
            found[known] = vectors[at[known]]
        out[0].append(found.tobytes())
        out[1].append(pack(np.flatnonzero(~known)))
    columns = [asked.column("block"), asked.column("bucket"), *(pa.array(x, pa.binary()) for x in out)]
    return pa.table(columns, ["block", "bucket", "vectors", "unknown"])


@dataclass
class Bags:
    """Documents as bags of numbers of tokens: ``sizes`` entries (place in ``keys``, count) for each."""

    keys: np.ndarray
    sizes: np.ndarray
    places: np.ndarray
    counts: np.ndarray


def bags_of(column: pa.Array | pa.ChunkedArray) -> list[Bags]:
    """A bag of its tokens for each text, in chunks."""
    out = []
    for _, _, data, offsets in _chunks(column):
        tokens, docs = token_keys(data, offsets)
        keys, own = np.unique(tokens, return_inverse=True)
        pairs, counts = np.unique(docs * max(1, len(keys)) + own, return_counts=True)
        doc, place = np.divmod(pairs, max(1, len(keys)))
        out.append(Bags(keys, np.bincount(doc, minlength=len(offsets) - 1), place, counts))
    return out


def joined(parts: list[Bags]) -> Bags:
    """Bags of several chunks as those of one, frequent tokens first."""
    keys = np.unique(np.concatenate([NONE[0], *(p.keys for p in parts)]))
    none = np.zeros(0, np.int64)
    places = np.concatenate([none, *(np.searchsorted(keys, p.keys)[p.places] for p in parts)])
    order = np.argsort(-np.bincount(places, minlength=len(keys)), kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    sizes, counts = (np.concatenate([none, *x]) for x in ([p.sizes for p in parts], [p.counts for p in parts]))
    places, doc = rank[places], np.repeat(np.arange(len(sizes)), sizes)
    by = np.lexsort((places, doc))
    return Bags(keys[order], sizes, places[by], counts[by])


def pooled(bags: Bags, vectors: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Mean word vector of each document, -1 to 1 a component; tokens that aren't known count as zeros, no tokens give zeros.

    ``vectors`` and ``known`` are of ``bags.keys``.
    """
    bits = np.unpackbits(vectors.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :DIM]
    values = (2 * bits.astype(np.int8) - 1) * known[:, None].astype(np.int8)
    out = np.zeros((len(bags.sizes), DIM), np.float32)
    ends = np.cumsum(bags.sizes)
    first = 0
    while first < len(out):
        begin = int(ends[first] - bags.sizes[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + (1 << 17), side="right")))
        full = first + np.flatnonzero(bags.sizes[first:last])
        if len(full):
            c = bags.counts[begin : ends[last - 1]].astype(np.float32)
            at = ends[full] - bags.sizes[full] - begin
            total = np.add.reduceat(values[bags.places[begin : ends[last - 1]]] * c[:, None], at, axis=0)
            out[full] = total / np.add.reduceat(c, at)[:, None]
        first = last
    return out


def features(rows: DataFrame, text_col: str, words: Words, then: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What ``then`` makes of the long columns of ``rows`` other than ``text_col`` and of the texts' mean word vectors, block by block.

    A block's memory is bounded by ``block_bytes`` and the longest text.  Only bags of token numbers go through the shuffle.
    """
    small_batches(rows.sparkSession)
    carried = [c for c in rows.columns if c != text_col]
    own = rows.select(F.col(text_col).cast("string"), *(F.col(c).cast("long") for c in carried))
    names = [f"c{k}" for k in range(len(carried))]
    buckets = words.buckets

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, parts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def block() -> pa.RecordBatch:
            bags = joined(parts)
            first = np.cumsum(bags.sizes) - bags.sizes
            gaps = np.diff(bags.places, prepend=0)
            full = first[bags.sizes > 0]
            gaps[full] = bags.places[full]
            packed = [bags.keys.tobytes(), *(pack(x) for x in (bags.sizes, gaps, bags.counts))]
            columns = [pa.ListArray.from_arrays(pa.array([0, len(bags.sizes)], pa.int32()), pa.concat_arrays([h[k] for h in held])) for k in range(len(carried))]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in packed), *columns], ["block", "keys", "sizes", "gaps", "counts", *names])

        for batch in batches:
            held.append(batch.columns[1:])
            parts += bags_of(batch.column(0))
            size += batch.column(0).nbytes
            if size >= block_bytes:
                yield block()
                number, held, parts, size = number + 1, [], [], 0
        if held:
            yield block()

    def ask(table: pa.Table) -> pa.Table:
        keys = np.sort(np.frombuffer(table.column("keys")[0].as_py(), "<u8"))
        at = bucket_bounds(keys, buckets)
        full = np.flatnonzero(at[1:] > at[:-1])
        own = pa.array([pack_keys(keys[at[b] : at[b + 1]]) for b in full], pa.binary())
        return pa.table([pa.array([table.column("block")[0].as_py()] * len(full), pa.int64()), pa.array(full, pa.int64()), own], ["block", "bucket", "keys"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0] for c in left.column_names}
        keys = np.frombuffer(row["keys"].as_py(), "<u8")
        sizes, gaps, counts = (unpack(row[c].as_py()) for c in ("sizes", "gaps", "counts"))
        ends = np.cumsum(sizes)
        places = np.cumsum(gaps)
        if len(places):
            before = np.where(sizes > 0, places[np.minimum(ends - sizes, len(places) - 1)] - gaps[np.minimum(ends - sizes, len(places) - 1)], 0)
            places -= np.repeat(before, sizes)
        vectors, known, at = np.zeros(len(keys), np.uint64), np.ones(len(keys), bool), 0
        if len(right):
            right = right.sort_by("bucket")
            for own, unknown in zip(right.column("vectors"), right.column("unknown"), strict=True):
                own = np.frombuffer(own.as_py(), "<u8")
                vectors[at : at + len(own)] = own
                known[at + unpack(unknown.as_py())] = False
                at += len(own)
        if at != len(keys):
            raise AssertionError("a block's answers don't fit its tokens")
        order = np.argsort(keys)
        by_place, known_at = np.empty_like(vectors), np.empty_like(known)
        by_place[order], known_at[order] = vectors, known
        table = pa.table([row[c].values for c in names], carried)
        return then(table, pooled(Bags(keys, sizes, places, counts), by_place, known_at))

    lists = ", ".join(f"{c} array<long>" for c in names)
    blocks = own.mapInArrow(deal, f"block long, keys binary, sizes binary, gaps binary, counts binary, {lists}")
    asked = blocks.groupBy("block").applyInArrow(ask, "block long, bucket long, keys binary")
    answers = asked.groupBy("bucket").cogroup(words.table.groupBy("bucket")).applyInArrow(_answer, "block long, bucket long, vectors binary, unknown binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


@dataclass
class Network:
    """Two layers: tanh, then a logit divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 5, decay: float = 1e-4) -> Network:
    """Fit by Adam on four fifths of the rows and calibrate on the rest; one class alone gives its smoothed share."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    scale = (x.std(axis=0) if len(x) else np.zeros(x.shape[1])) + 1e-3
    rng = np.random.default_rng(seed)
    prior = float(np.log(share / (1 - share)))
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array(prior)]
    if len(y) < 10 or y.min() == y.max():
        return Network(mean, scale, p[0], p[1], p[2] * 0, prior)
    held = np.arange(len(y)) % 5 == 4
    z, t = ((x - mean) / scale)[~held], y[~held]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(t))
        rate = 3e-3 * (1 - epoch / epochs)
        for i in range(0, len(t), 256):
            k = order[i : i + 256]
            h = np.tanh(z[k] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - t[k]) / len(k)
            back = np.outer(d, p[2]) * (1 - h * h)
            grads = [z[k].T @ back + decay * p[0], back.sum(axis=0), h.T @ d + decay * p[2], d.sum()]
            step += 1
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                p[j] = p[j] - rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3]))
    logits, t = net.logits(x[held]), y[held]

    def loss(temperature: float) -> float:
        s = logits / temperature
        return float(np.mean(np.logaddexp(0, s) - t * s))

    net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return net


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", max_rows: int = 20_000) -> tuple[Words, Network]:
    """Word vectors of all texts of ``docs``, and a network fitted to at most ``max_rows`` rows of ``labels``.

    ``labels`` has doc_id and ``label_col``; the rows are those with the smallest hashes of doc_id.  Null ids and labels
    don't count, repeated ones count with their mean.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = word_vectors(texts.select("text"))
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = cut(texts.join(F.broadcast(own), "doc_id").select("doc_id", (F.col("label") >= 0.5).cast("long").alias("label"), "text"))  # max_rows rows of two numbers

    def keep(table: pa.Table, x: np.ndarray) -> pa.Table:
        return pa.table([*table.columns, pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    found = features(rows, "text", words, keep, "doc_id long, label long, x binary").toArrow()
    ids = found.column("doc_id").to_numpy()
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(-1, DIM).astype(float)
    order = np.lexsort((x[:, 0], mix(ids.astype(np.uint64)))) if len(ids) else np.zeros(0, np.int64)
    return words, train(x[order], found.column("label").to_numpy()[order].astype(float))


def scores(rows: DataFrame, model: tuple[Words, Network], *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The long columns of ``rows`` and ``score_col``, the probability of label 1 for the text of each row.

    Null and empty texts have the score of no tokens, and tokens that the model hasn't seen a vector of zeros.  Nulls in the other
    columns stay, repeated rows are scored each, an empty table gives no rows.  Only the network goes to all tasks.
    """
    words, net = model

    def run(table: pa.Table, x: np.ndarray) -> pa.Table:
        return table.append_column(score_col, pa.array(net.score(x.astype(float))))

    carried = [c for c in rows.columns if c != text_col]
    return features(rows, text_col, words, run, ", ".join([*(f"`{c}` long" for c in carried), f"`{score_col}` double"]))


def with_score(docs: DataFrame, model: tuple[Words, Network], *, text_col: str = "text", score_col: str = "score", keep_from: float | None = None) -> DataFrame:
    """``docs`` with ``score_col``, the probability of label 1; or, with ``keep_from``, the rows that score as much, unchanged.

    A score depends on the text alone, so rows meet theirs by a 128-bit hash of the text.  Null and empty texts have the
    score of no tokens.  Other columns pass through, whatever their names; a clashing ``score_col`` is replaced.  Repeated rows
    stay as often as they occur.
    """
    lo, hi, found = free_names([*docs.columns, score_col], 3)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashes = [F.xxhash64(text).alias(lo), F.xxhash64(F.lit(1), text).alias(hi)]
    own = scores(docs.select(*hashes, text.alias(found)), model, text_col=found, score_col=score_col)
    own = own.groupBy(lo, hi).agg(F.max(score_col).alias(found))
    if keep_from is not None:
        own = own.where(F.col(found) >= keep_from)
    rows = docs.withColumns({lo: hashes[0], hi: hashes[1]}).join(own, [lo, hi])
    if keep_from is not None:
        return rows.select(*docs.columns)
    return rows.select(*(c for c in docs.columns if c != score_col), F.col(found).alias(score_col))
