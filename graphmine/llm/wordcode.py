"""Whole texts to ids through a table of the words met so far.

A text is cut into units at places where the coder's result on the whole text is
the results on the units, one after the other. Distinct units are coded once
and kept, so a chunk costs a sort and a gather.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import textbuf as tb
from .shared import KEPT


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pool[start[i]:start[i] + length[i]] of all i in a row, and the n + 1 offsets."""
    offs = np.concatenate([[0], np.cumsum(length)])
    return pool[np.repeat(start - offs[:-1], length) + np.arange(offs[-1])], offs


class WordTable:
    """code(data, starts, ends) gives the ids of spans in a row and each one's count.

    Spans are found by a hash; their bytes are then compared with the kept ones, and
    a span whose hash belongs to other bytes is coded by itself.
    """

    #: Spans that are kept; then the table starts anew.
    LIMIT = 800_000

    def __init__(self, code: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], dtype=np.int32):
        self.code, self.dtype, self.hash = code, dtype, tb.span_hashes
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        #: Where each key's ids and bytes lie in the pools, and how many there are.
        self.at, self.size, self.byte_at, self.byte_size = (np.zeros(0, np.int64) for _ in range(4))
        self.ids, self.bytes = _Pool(self.dtype), _Pool(np.uint8)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: np.ndarray) -> None:
        ids, size = self.code(data, starts, ends)
        text, offs = gather(data, starts, ends - starts)
        at = self.ids.add(ids) + np.cumsum(size) - size
        byte_at = self.bytes.add(text) + offs[:-1]
        keys = np.concatenate([self.keys, key])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        for name, more in (("at", at), ("size", size), ("byte_at", byte_at), ("byte_size", ends - starts)):
            setattr(self, name, np.concatenate([getattr(self, name), more])[order])

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all spans in a row, and their n + 1 offsets."""
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        key, first, back = np.unique(self.hash(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(key) > self.LIMIT:
            self._clear()
        if len(self.keys):
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            new = self.keys[where] != key
        else:
            new = np.ones(len(key), bool)
        if new.any():
            self._learn(data, starts[first[new]], ends[first[new]], key[new])
        where = np.searchsorted(self.keys, key)[back]
        other = self._unequal(data, starts, ends, where)
        if not len(other):
            return gather(self.ids.values, self.at[where], self.size[where])
        size = self.size[where].copy()
        own, size[other] = self.code(data, starts[other], ends[other])
        pool = np.concatenate([self.ids.values[: self.ids.used], own])
        at = self.at[where].copy()
        at[other] = self.ids.used + np.cumsum(size[other]) - size[other]
        return gather(pool, at, size)

    def _unequal(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Spans whose bytes aren't those kept under their hash."""
        n = ends - starts
        same = self.byte_size[where] == n
        mine, kept = np.flatnonzero(same), where[same]
        a, offs = gather(data, starts[mine], n[mine])
        b, _ = gather(self.bytes.values, self.byte_at[kept], n[mine])
        if len(mine) == len(n) and np.array_equal(a, b):
            return mine[:0]
        wrong = np.concatenate([[0], np.cumsum(a != b)])
        same[mine] = wrong[offs[1:]] == wrong[offs[:-1]]
        return np.flatnonzero(~same)


class _Pool:
    """An array that grows by doubling."""

    def __init__(self, dtype):
        self.values, self.used = np.zeros(1 << 16, dtype), 0

    def add(self, more: np.ndarray) -> int:
        at = self.used
        while at + len(more) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[at : at + len(more)] = more
        self.used = at + len(more)
        return at


_CONTROL = np.zeros(256, bool)
_CONTROL[[11, 12, 13, *range(28, 32)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 32]] = True


def _odd(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the character that ends at byte `last` may be white space beyond space, tab and line feed (a wide guess does no harm)."""
    b, b1, b2 = data[last], data[np.maximum(last - 1, 0)], data[np.maximum(last - 2, 0)]
    return _CONTROL[b] | ((b1 == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((b2 >= 0xE1) & (b2 <= 0xE3) & (b1 >= 0x80) & (b >= 0x80))


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units of all texts, and each text's offsets into them.

    A unit starts where white space follows another character. No token of a
    byte-level BPE holds white space after other characters, so none lies across.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    blank = _BLANK[data]
    cut = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    cut = cut[~_odd(data, cut - 1)]
    first = np.zeros(len(data), bool)
    first[cut] = True
    first[offs[:-1][np.diff(offs) > 0]] = True
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offs)


class ByteBpe:
    """Ids of whole texts as the tokenizers library gives them (add_special_tokens=False)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        added = self.tokenizer.get_added_tokens_decoder()
        self.bytes_of = np.zeros(max([*vocab.values(), *added]) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)
        for i, token in added.items():
            self.bytes_of[i] = len(token.content.encode())
        self.table = WordTable(self._code)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _code(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # units that begin with white space and end otherwise can be coded in one text
        alone = ~_BLANK[data[starts]] | _BLANK[data[ends - 1]] | _odd(data, ends - 1)
        size = np.zeros(len(starts), np.int64)
        ids: list = [None] * 2
        some = np.flatnonzero(~alone)
        joined, at = gather(data, starts[some], (ends - starts)[some])
        ids[0] = self._encode([joined.tobytes().decode()])[0] if len(some) else np.zeros(0, np.int32)
        reach = np.cumsum(self.bytes_of[ids[0]])
        if len(some):
            stop = np.searchsorted(reach, at[1:])
            if stop[-1] >= len(reach) or not np.array_equal(reach[stop], at[1:]):
                raise ValueError("a token lies across two units")
            size[some] = np.diff(np.concatenate([[0], stop + 1]))
        each = self._encode([data[a:b].tobytes().decode() for a, b in zip(starts[alone], ends[alone], strict=True)]) if alone.any() else []
        size[alone] = [len(x) for x in each]
        out = np.zeros(size.sum(), np.int32)
        offs = np.concatenate([[0], np.cumsum(size)])
        for mine, got in ((some, ids[0]), (np.flatnonzero(alone), np.concatenate(each) if each else ids[0][:0])):
            if len(mine):
                out[np.repeat(offs[mine] - np.concatenate([[0], np.cumsum(size[mine])])[:-1], size[mine]) + np.arange(len(got))] = got
        return out, size

    def __call__(self, data: np.ndarray, offs: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a chunk's texts in a row and the texts' offsets; `end` is put after each text."""
        starts, ends, of = units(data, offs)
        ids, at = self.table(data, starts, ends)
        at = at[of]
        if end is None:
            return ids, at
        n = len(at) - 1
        out = np.full(len(ids) + n, end, np.int32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
        return out, at + np.arange(n + 1)


_coders: dict[str, ByteBpe] = {}
KEPT.append(_coders)


def byte_bpe(path: str) -> ByteBpe:
    """The coder of this Python worker."""
    if path not in _coders:
        _coders[path] = ByteBpe(path)
    return _coders[path]
