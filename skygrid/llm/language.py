"""Language identification by a bidirectional gated recurrent network over bytes.

The network (two GRUs, one from either end) reads whole texts byte by byte, white space and all, and gives every position a
distribution over languages; a document's probabilities are the mean over all its positions.  It is trained in numpy by
backpropagation through time, on crops spread over the texts of labelled rows.

So that a long text is not one long chain of steps, it is read in windows, many side by side.  A window's state starts from
zero ``CONTEXT`` bytes ahead of the window (behind it, for the GRU that reads backwards), or at the text's end if that is nearer.  By
then a gated state has forgotten where it began: pooled probabilities agree with those of one pass over the text to 1e-3
(tests hold them together).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygrid.llm.common import WORDS, row_chunks, small_batches, text_buffers

HIDDEN = 8
#: Bytes that a window labels, and that it reads before them.
SPAN, CONTEXT = 1024, 64
#: Bytes of a training crop.
CROP = 64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + abs(x)), in place of a tanh; (1 + it) / 2 in place of a sigmoid.  Its slope at y is (1 - abs(y)) ** 2."""
    return x / (1 + np.abs(x))


def _softmax(x: np.ndarray) -> np.ndarray:
    """Along the last axis."""
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


@dataclass
class Gru:
    """Weights of gates update (z), reset (r) and the candidate (n): of the byte read, 256 x H, and of the state before, H x H."""

    bz: np.ndarray
    br: np.ndarray
    bn: np.ndarray
    uz: np.ndarray
    ur: np.ndarray
    un: np.ndarray

    def forward(self, x: np.ndarray, trace: list) -> np.ndarray:
        """States (L, B, H) for bytes x (L, B), from zero states; ``trace`` gets what backpropagation needs."""
        h = np.zeros((x.shape[1], len(self.un)), self.un.dtype)
        out = np.empty((len(x), *h.shape), h.dtype)
        for t, now in enumerate(x):
            z = 0.5 * _soft(h @ self.uz + self.bz.take(now, axis=0)) + 0.5
            r = 0.5 * _soft(h @ self.ur + self.br.take(now, axis=0)) + 0.5
            rh = r * h
            n = _soft(rh @ self.un + self.bn.take(now, axis=0))
            trace.append((h, z, r, rh, n))
            h = n + z * (h - n)
            out[t] = h
        return out

    def backward(self, x: np.ndarray, trace: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weights in their order, through time from the last state to the first."""
        size = len(self.un)
        du = [np.zeros_like(self.un) for _ in range(3)]
        d_in = np.empty((*x.shape, 3 * size), self.un.dtype)
        dh = np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, rh, n = trace[t]
            dh += d_out[t]
            dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
            drh = dn @ self.un.T
            dz = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = drh * h * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            for k, (left, d) in enumerate(((h, dz), (h, dr), (rh, dn))):
                du[k] += left.T @ d
                d_in[t, :, k * size : (k + 1) * size] = d
            dh = dh * z + drh * r + dz @ self.uz.T + dr @ self.ur.T
        order = np.argsort(x, axis=None, kind="stable")
        values = x.ravel()[order]
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        d = np.zeros((256, 3 * size), self.un.dtype)
        d[values[first]] = np.add.reduceat(d_in.reshape(-1, 3 * size)[order], first, axis=0)
        return [d[:, :size], d[:, size : 2 * size], d[:, 2 * size :], *du]


class Reader:
    """A GRU's steps without a trace, in buffers of its own; the halves of the gates are taken into the weights of what follows."""

    def __init__(self, gru: Gru, rows: int) -> None:
        self.gru = gru
        self.un = 0.5 * gru.un
        self.h = np.zeros((rows, len(gru.un)), np.float32)
        self.held = [np.empty_like(self.h) for _ in range(4)]

    def step(self, x: np.ndarray) -> np.ndarray:
        """The first len(x) states after reading a byte each; a view that the next step overwrites."""
        h = self.h[: len(x)]
        z, r, n, own = (b[: len(x)] for b in self.held)

        def soft(out: np.ndarray, left: np.ndarray, u: np.ndarray, b: np.ndarray) -> None:
            np.matmul(left, u, out=out)
            np.take(b, x, axis=0, out=own, mode="clip")
            np.add(out, own, out=out)
            np.abs(out, out=own)
            np.add(own, 1, out=own)
            np.divide(out, own, out=out)

        soft(z, h, self.gru.uz, self.gru.bz)
        soft(r, h, self.gru.ur, self.gru.br)
        r += 1
        r *= h
        soft(n, r, self.un, self.gru.bn)
        z += 1
        z *= 0.5
        h -= n
        h *= z
        h += n
        return h


@dataclass
class Model:
    langs: list[str]
    ahead: Gru
    back: Gru
    w: np.ndarray  # 2H x K
    b: np.ndarray  # K

    def params(self) -> list[np.ndarray]:
        return [*vars(self.ahead).values(), *vars(self.back).values(), self.w, self.b]

    def positions(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A distribution over languages for each byte of the texts."""
        logits = np.zeros((len(data), len(self.langs)), np.float32)
        size = len(self.ahead.un)
        begin, end, low, high = windows(offsets)
        _scan(self.ahead, self.w[:size], data, low, end - low, begin - low, 1, logits)
        _scan(self.back, self.w[size:], data, high - 1, high - begin, high - end, -1, logits)
        return _softmax(logits + self.b)

    def pool(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean distribution of each text; zeros for an empty one."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        n = np.diff(offsets)
        full = np.flatnonzero(n)
        if len(full):
            out[full] = np.add.reduceat(self.positions(data, offsets), offsets[full], axis=0, dtype=float) / n[full, None]
        return out


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window its begin and end, and the begin and end with context, within its text."""
    lengths = np.diff(offsets)
    parts = -(-lengths // SPAN)
    of = np.repeat(np.arange(len(parts)), parts)
    begin = offsets[of] + (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * SPAN
    end = np.minimum(begin + SPAN, offsets[of + 1])
    return begin, end, np.maximum(begin - CONTEXT, offsets[of]), np.minimum(end + CONTEXT, offsets[of + 1])


def _scan(gru: Gru, w: np.ndarray, data: np.ndarray, first: np.ndarray, steps: np.ndarray, skip: np.ndarray, way: int, logits: np.ndarray) -> None:
    """Add a GRU's share of the logits of the bytes that windows label.

    A window reads ``steps`` bytes from ``first`` in direction ``way`` and labels none of the first ``skip``.  Longer windows
    stand first, so those still being read are always the first ones.
    """
    order = np.argsort(-steps, kind="stable")
    first, steps, skip = first[order], steps[order], skip[order]
    reader, data = Reader(gru, len(first)), data.astype(np.intp)
    alive = np.searchsorted(-steps, -np.arange(int(steps[0]) if len(steps) else 0), side="left")
    at, out, k = np.empty(int(steps.sum()), np.intp), np.empty((int(steps.sum()), w.shape[1]), np.float32), 0
    for t, n in enumerate(alive.tolist()):
        now = np.add(first[:n], way * t, out=at[k : k + n])
        np.matmul(reader.step(data[now]), w, out=out[k : k + n])
        if t < CONTEXT:
            now[skip[:n] > t] = -1
        k += n
    own = np.flatnonzero(at >= 0)
    logits[at[own]] += out[own]


def _new_model(langs: list[str], seed: int = 3, kind: type = np.float32) -> Model:
    rng = np.random.default_rng(seed)

    def gru() -> Gru:
        own = [rng.normal(0, 0.5, (256, HIDDEN)) for _ in range(3)] + [rng.normal(0, HIDDEN**-0.5, (HIDDEN, HIDDEN)) for _ in range(3)]
        return Gru(*(a.astype(kind) for a in own))

    return Model(langs, gru(), gru(), rng.normal(0, 0.3, (2 * HIDDEN, len(langs))).astype(kind), np.zeros(len(langs), kind))


def gradients(model: Model, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy over all positions of crops x (L, B) with languages y (B), for ``model.params()``."""
    size, traces = len(model.ahead.un), ([], [])
    s = np.concatenate([model.ahead.forward(x, traces[0]), model.back.forward(x[::-1], traces[1])[::-1]], axis=2)
    d = _softmax(s @ model.w + model.b)
    d[:, np.arange(len(y)), y] -= 1
    d /= x.size
    ds = d @ model.w.T
    dw = np.tensordot(s, d, axes=([0, 1], [0, 1]))
    return [*model.ahead.backward(x, traces[0], ds[:, :, :size]), *model.back.backward(x[::-1], traces[1], ds[::-1, :, size:]), dw, d.sum(axis=(0, 1))]


def train(crops: list[tuple[bytes, int]], langs: list[str], steps: int = 200, size: int = 128, seed: int = 4) -> Model:
    """Fit by Adam: a step takes ``size`` crops of about one length, every position labelled.

    Crops go by length into groups and are repeated to the length of the longest of theirs, so none is filled up.
    """
    model = _new_model(langs)
    if not crops or len(langs) < 2:
        return model
    rng, p = np.random.default_rng(seed), model.params()
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    groups: dict[int, list[int]] = {}
    for i, (text, _) in enumerate(crops):
        groups.setdefault(-(-len(text) // 8) * 8, []).append(i)
    drawn = []
    for n, at in sorted(groups.items()):
        x = np.stack([np.resize(np.frombuffer(crops[i][0], np.uint8), n) for i in at], axis=1)
        drawn.append((x, np.array([crops[i][1] for i in at])))
    mass = np.cumsum([len(y) for _, y in drawn])
    for step in range(1, steps + 1):
        x, y = drawn[int(np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(0, len(drawn) - 1))]
        k = rng.integers(0, len(y), size)
        rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
        for a, g, mm, vv in zip(p, gradients(model, x[:, k], y[k]), m, v, strict=True):
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            a -= (rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)).astype(a.dtype)
    return model


def fit(docs: DataFrame, *, max_docs: int = 3000, crops: int = 6) -> Model:
    """Learn from at most ``max_docs`` rows of ``docs`` (doc_id, text, lang) with a text and a language, and all their languages.

    The rows are dealt out among the languages in turn, those with the smallest hashes of doc_id first; rows with a null id don't
    count.  Of each text ``crops`` crops of 64 bytes, evenly spread from its first byte to its last, are learned from, or all of a
    shorter one.
    """
    small_batches(docs.sparkSession)
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    salted = Window.partitionBy("lang", F.pmod(F.hash("doc_id"), F.lit(64))).orderBy(*order)  # a language may hold most rows
    first = own.select("lang", "doc_id").withColumn("turn", F.row_number().over(salted)).where(F.col("turn") <= max_docs)
    first = first.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("turn") <= max_docs)
    wanted = first.orderBy("turn", F.xxhash64("doc_id"), "doc_id", "lang").limit(max_docs).select("doc_id", "lang").distinct()
    rows = own.join(F.broadcast(wanted), ["doc_id", "lang"], "left_semi")  # max_docs ids

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            of, parts = [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                starts = [a] if b - a <= CROP else sorted({a + k * (b - a - CROP) // max(1, crops - 1) for k in range(crops)})
                for k in starts if b > a else []:
                    of.append(i)
                    parts.append(data[k : min(b, k + CROP)].tobytes())
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(parts, pa.binary())], ["doc_id", "lang", "crop"])

    found = rows.mapInArrow(cut_out, "doc_id long, lang string, crop binary").toArrow().to_pylist()  # max_docs * crops rows
    found.sort(key=lambda r: (r["doc_id"], r["lang"], r["crop"]))
    langs = sorted({r["lang"] for r in found})
    number = {lang: k for k, lang in enumerate(langs)}
    return train([(r["crop"], number[r["lang"]]) for r in found], langs)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    count = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = count[offsets[1:]] > count[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, probabilities) for each row of ``docs`` (doc_id, text).

    ``und`` with score 0 for a null text, one without a letter, or a model without languages; ties go to the first
    language by name.  Rows that repeat an id are labelled each, other columns are not looked at.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a network of fixed size but for a row for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = model.langs
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in row_chunks(offsets, 1 << 21):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                letters = has_letter(part, at) & bool(langs)
                p = model.pool(part, at) if langs else np.zeros((j - i, 1))
                best = p.argmax(axis=1)
                name = [langs[k] if x else "und" for k, x in zip(best.tolist(), letters.tolist(), strict=True)]
                score = np.where(letters, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(name, pa.string()), pa.array(score), pa.array(p.tolist(), pa.list_(pa.float64()))], ["doc_id", "lang_pred", "score", "probabilities"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double, probabilities array<double>")


def language_spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, lang): runs of bytes of the UTF-8 text whose positions have the same best language, white space left out.

    Null, empty and blank texts have none, and a model without languages gives none.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches if model.langs else ():
            data, offsets = text_buffers(batch.column(1))
            ids = batch.column(0)
            for i, j in row_chunks(offsets, 1 << 21):
                part = data[offsets[i] : offsets[j]]
                at = offsets[i : j + 1] - offsets[i]
                best = np.where(WORDS[part] == 0, -1, model.positions(part, at).argmax(axis=1))
                row = np.repeat(np.arange(j - i), np.diff(at))
                first = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (row[1:] != row[:-1])]) if len(best) else np.zeros(0, np.int64)
                last = np.r_[first[1:], len(best)] if len(first) else first
                own = best[first] >= 0
                first, last = first[own], last[own]
                of = row[first]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(i + of)), pa.array(first - at[of]), pa.array(last - at[of]), pa.array([model.langs[k] for k in best[first].tolist()], pa.string())],
                    ["doc_id", "start", "end", "lang"],
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, start long, end long, lang string")
