"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

An open bin takes, again and again, the example that fits and whose demand has the largest dot product with the room
left, each dimension in units of its limit.  Examples may be whole (instruction data) or may be cut (documents).  Where
cutting is allowed, full sequences are cut off long documents first, an example that doesn't fit is cut to fill
the bin, and the rest at the very end is cut into powers of two, so nothing is padded.

Each task packs what it reads, in windows; the last bin of a window is reopened in the next.  No shuffle, and memory
is bounded by a window and the longest text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrid.llm.common import small_batches, text_buffers
from skygrid.llm.tokens import word_ids


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


@dataclass
class Item:
    """A piece of an example: its ids from ``start`` on, and the running count of loss-bearing ids (None: all of them)."""

    key: object
    ids: np.ndarray
    start: int
    whole: int
    loss: np.ndarray | None = None

    @property
    def n_loss(self) -> int:
        return len(self.ids) if self.loss is None else int(self.loss[-1])

    def split(self, n: int) -> tuple[Item, Item]:
        loss = (None, None) if self.loss is None else (self.loss[: n + 1], self.loss[n:] - self.loss[n])
        return Item(self.key, self.ids[:n], self.start, self.whole, loss[0]), Item(self.key, self.ids[n:], self.start + n, self.whole, loss[1])

    def fits(self, tokens: int, loss: int) -> int:
        """The most first ids that stay within the limits."""
        n = min(tokens, len(self.ids))
        return min(n, loss) if self.loss is None else min(n, int(np.searchsorted(self.loss, loss, side="right")) - 1)


@dataclass
class Packer:
    limits: Limits = field(default_factory=Limits)
    cut: bool = True

    def full(self, item: Item) -> tuple[list[list[Item]], Item | None]:
        """Bins of their own for what exceeds the limits of one bin, and the rest."""
        bins = []
        while len(item.ids) > self.limits.tokens or item.n_loss > self.limits.loss:
            head, item = item.split(max(1, item.fits(self.limits.tokens, self.limits.loss)))
            bins.append([head])
        if self.cut and len(item.ids) == self.limits.tokens:
            return [*bins, [item]], None
        return bins, item

    def pack(self, items: list[Item]) -> list[list[Item]]:
        """Bins of items, each within the limits as it is; the last bin may be far from full."""
        items = list(items)
        cap = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        need = np.array([[len(i.ids), 1, i.n_loss] for i in items], float).reshape(-1, 3)
        unit, alive, bins = need / cap, np.ones(len(items), bool), []
        left = len(items)
        while left:
            room, own = cap.copy(), []
            while left and room[1] >= 1 and room[0] >= 1:
                score = np.where(alive, unit @ (room / cap), -1.0)
                inside = alive & (need <= room).all(axis=1)
                if inside.any():
                    k = int(np.argmax(np.where(inside, score, -1.0)))
                    own.append(items[k])
                    room -= need[k]
                    alive[k], left = False, left - 1
                    continue
                k = int(np.argmax(score))
                n = items[k].fits(int(room[0]), int(room[2])) if self.cut else 0
                if n <= 0:
                    break
                head, items[k] = items[k].split(n)
                own.append(head)
                room -= (n, 1, head.n_loss)
                need[k] = len(items[k].ids), 1, items[k].n_loss
                unit[k] = need[k] / cap
            bins.append(own)
        return bins

    def tail(self, items: list[Item]) -> list[list[Item]]:
        """A bin that isn't full, cut into sequences whose lengths are powers of two."""
        total, bins = sum(len(i.ids) for i in items), []
        items = list(items)[::-1]
        while total:
            size = 1 << (total.bit_length() - 1)
            total, own = total - size, []
            while size:
                item = items.pop()
                if len(item.ids) > size:
                    item, rest = item.split(size)
                    items.append(rest)
                own.append(item)
                size -= len(item.ids)
            bins.append(own)
        return bins


def pack_stream(examples: Iterator[list[Item]], limits: Limits, cut: bool) -> Iterator[list[list[Item]]]:
    """Lists of finished bins for windows of examples, at most the last of them short."""
    packer, held = Packer(limits, cut), []
    for window in examples:
        done = []
        for item in window:
            bins, rest = packer.full(item)
            done += bins
            held += [rest] if rest is not None else []
        bins = packer.pack(held)
        held = bins.pop() if bins else []
        if cut:
            short = [b for b in bins if sum(len(i.ids) for i in b) < limits.tokens]
            done += [b for b in bins if sum(len(i.ids) for i in b) == limits.tokens]
            done += [x for b in short for x in packer.tail(b)]
        else:
            done += bins
        yield done
    if held:
        yield packer.tail(held) if cut else [held]


def _rows(bins: list[list[Item]], base: int, kind: pa.DataType, with_ids: bool) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(7)]
    ids = []
    for s, own in enumerate(bins):
        offset = 0
        for i in own:
            data = i.ids.astype("<u4", copy=False)
            row = (i.key, i.start, len(data), zlib.crc32(data.tobytes()), i.whole, base + s, offset)
            for c, v in zip(cols, row, strict=True):
                c.append(v)
            ids.append(data.astype(np.int32))
            offset += len(data)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    arrays = [pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]]]
    if with_ids:
        arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
    return pa.RecordBatch.from_arrays(arrays, names)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    end_id: int = 2,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its token ids and ``end_id``; null and empty texts have ``end_id`` alone.  All its ids bear loss.  Every
    id lies in one piece; sequences are full or as long as a power of two.  Rows that repeat an id are packed
    each for itself, a null id stays null, other columns are not looked at, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, kind, base = word_ids(tokenizer), pa.int64(), TaskContext.get().partitionId() << 32

        def windows() -> Iterator[list[Item]]:
            for batch in batches:
                data, offsets = text_buffers(batch.column(1))
                keys = batch.column(0).to_pylist()
                items = []
                for k, ids in zip(keys, coder.encode(data, offsets), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    items.append(Item(k, ids, 0, len(ids)))
                yield items

        for bins in pack_stream(windows(), limits, True):
            if bins:
                yield _rows(bins, base, kind, with_ids)
                base += len(bins)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def pack_conversations(
    turns: DataFrame,
    tokenizer: str,
    *,
    end_id: int = 2,
    limits: Limits = Limits(4096, 32, 3072),
    loss_role: str = "assistant",
    with_ids: bool = False,
) -> DataFrame:
    """Instruction data: conversations (conv_id, turn, role, text) packed whole, loss on ``loss_role``'s turns only.

    A conversation is its turns by (turn, role, text), each followed by ``end_id``; one that exceeds the limits is cut.  The
    columns are those of ``pack_documents``, doc_id being conv_id, and n_loss of each piece.  Null texts are empty,
    null roles bear no loss, rows with a null conv_id are one conversation, repeated rows count as often as they occur.
    A conversation is read by one task as a whole.
    """
    small_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, base = word_ids(tokenizer), TaskContext.get().partitionId() << 32

        def windows() -> Iterator[list[Item]]:
            for batch in batches:
                items = []
                for key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    parts = coder.encode(*text_buffers(pa.array([t["text"] for t in own], pa.string())))
                    parts = [np.append(p, np.uint32(end_id)) for p in parts]
                    flags = np.concatenate([np.full(len(p), t["role"] == loss_role) for p, t in zip(parts, own, strict=True)])
                    ids = np.concatenate(parts)
                    items.append(Item(key, ids, 0, len(ids), np.r_[0, np.cumsum(flags)]))
                yield items

        for bins in pack_stream(windows(), limits, False):
            if bins:
                rows = _rows(bins, base, pa.int64(), with_ids)
                loss = pa.array([i.n_loss for b in bins for i in b], pa.int64())
                yield pa.RecordBatch.from_arrays([*rows.columns, loss], [*rows.schema.names, "n_loss"])
                base += len(bins)

    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", "role", "text").alias("t"))
    own = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    own = own.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return own.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else "") + ", n_loss long")
