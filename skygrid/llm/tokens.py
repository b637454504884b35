"""Token ids of whole texts, with each distinct word encoded once per worker."""

from __future__ import annotations

import os

import numpy as np

from skygrid.llm.common import WORDS, kind_runs, row_chunks, run_hashes, runs

MAX_WORDS, MAX_BYTES, GROUP = 1_500_000, 64 << 20, 200
_held: dict[str, WordIds] = {}

#: Letters 1, digits 2, punctuation 3; bytes of other characters count as letters.
_KINDS = WORDS.copy()
_KINDS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 3
_KINDS[range(48, 58)] = 2
#: Bytes of pieces that are encoded whole: controls, apostrophes (contractions), < (special tokens), and characters beyond ASCII
#: but for the Latin letters U+00C0 to U+00FF.
_ODD = np.zeros(256, bool)
_ODD[[*range(0, 9), *range(14, 32), 127, ord("'"), ord("<"), *range(128, 256)]] = True
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of pieces whose ids, one after another, are the ids of a text.

    Runs of letters, digits or punctuation between white space are pieces, as the vocabulary splits there whatever stands
    around them; where that depends on more than the bytes' kinds, all that stands between white space is one.
    Ids don't depend on A-Z or a-z in the former.
    """
    odd = _ODD[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & _LATIN[data[1:]]) if len(data) > 1 else np.zeros(0, np.int64)
    odd[latin] = False
    odd[latin + 1] = False
    kinds = _KINDS[data]
    if odd.any():
        starts, ends, _ = runs(data, offsets)
        count = np.concatenate([[0], np.cumsum(odd)])
        whole = count[ends] > count[starts]
        change = np.zeros(len(data) + 1, np.int8)
        change[starts[whole]] += 1
        change[ends[whole]] -= 1
        kinds[np.cumsum(change[:-1]) > 0] = 4
    starts, ends, rows = kind_runs(kinds, offsets)
    hashes = run_hashes(data, starts, ends)
    own = np.flatnonzero(kinds[starts] == 4) if len(starts) else starts
    if len(own):
        hashes[own] = ~run_hashes(data, starts[own], ends[own], fold=False)
    return starts, ends, rows, hashes


class WordIds:
    """Encodes texts piece by piece for a lower-casing vocabulary that drops white space between words.

    New pieces are joined by a special token, encoded together by the tokenizer and cut apart at it.  Pieces are known by
    64-bit hashes.  The memory is bounded: past 1.5 million pieces or 64 MB it starts anew.
    """

    def __init__(self, path: str, separator: str = "<|startoftext|>") -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator, self.mark = separator, self.tokenizer.token_to_id(separator)
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bytes, self.n = 0, 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)

    def _code(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and the number of each word's."""
        joint = f" {self.separator} "
        groups = [words[i : i + GROUP] for i in range(0, len(words), GROUP)]
        coded = self.tokenizer.encode_batch([joint.join(g) for g in groups], add_special_tokens=False)
        ids = np.concatenate([np.array([*e.ids, self.mark], np.uint32) for e in coded])
        ends = np.flatnonzero(ids == self.mark)
        lengths = np.diff(np.concatenate([[-1], ends])) - 1
        if len(lengths) != len(words):
            raise AssertionError("the vocabulary lost a separator")
        return ids[ids != self.mark], lengths

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        special = np.array([b"<|" in w for w in words])
        text = [w.decode("utf-8", "replace") for w in words]
        parts, counts, order = [], [], []
        plain = np.flatnonzero(~special)
        if len(plain):
            ids, lengths = self._code([text[i] for i in plain])
            parts, counts, order = [ids], [lengths], [plain]
        for i in np.flatnonzero(special):
            ids = np.array(self.tokenizer.encode(text[i], add_special_tokens=False).ids, np.uint32)
            parts, counts, order = [*parts, ids], [*counts, [len(ids)]], [*order, [i]]
        ids, lengths, order = np.concatenate(parts), np.concatenate(counts).astype(np.int64), np.concatenate(order).astype(np.int64)
        used, n = int(self.starts[self.n]), len(order)
        need = used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(need, len(self.ids)), np.uint32)])
        self.ids[used:need] = ids
        if self.n + n + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(n + 1, len(self.starts)), np.int64)])
        self.starts[self.n + 1 : self.n + 1 + n] = used + np.cumsum(lengths)
        keys = np.concatenate([self.keys, hashes[order]])
        at = np.concatenate([self.at, np.arange(self.n, self.n + n)])
        by = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[by], at[by]
        self.n += n
        self.bytes += sum(map(len, words))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each row of UTF-8 texts."""
        out = []
        for i, j in row_chunks(offsets, 4 << 20):
            out += self._encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        return out

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        if self.n > MAX_WORDS or self.bytes > MAX_BYTES:
            self.clear()
        starts, ends, rows, hashes = pieces(data, offsets)
        if not len(starts):
            return [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        distinct, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.keys, assume_unique=True)
        if new.any():
            raw = data.tobytes()
            self._learn(distinct[new], [raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        at = self.at[np.searchsorted(self.keys, distinct)][of]
        begin = self.starts[at]
        lengths = self.starts[at + 1] - begin
        total = np.cumsum(lengths)
        ids = self.ids[np.repeat(begin - total + lengths, lengths) + np.arange(int(total[-1]))]
        last = np.searchsorted(rows, np.arange(len(offsets) - 1), side="right")
        return np.split(ids, np.concatenate([[0], total])[last[:-1]])


def word_ids(path: str) -> WordIds:
    """The worker's encoder for a vocabulary file."""
    if path not in _held:
        _held.clear()
        _held[path] = WordIds(path)
    return _held[path]
