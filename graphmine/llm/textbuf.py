"""Flat UTF-8 views of Arrow string columns, and vectorised word hashing.

Every text operator of this subpackage works on whole Arrow batches: one byte
array holds all texts of a chunk, and words are (start, end) offsets into it.
A null text counts as an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; one longer text is a chunk alone.
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word separators: space, and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of consecutive chunks."""
    data, offs = flat(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Spans up to this many bytes are hashed eight bytes at a time in numpy; longer ones by BLAKE2.
_SHORT = 64
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes wherever they stand.

    Each step mixes eight bytes into all bits of the state, so that unequal spans
    agree by chance only, whatever their structure.
    """
    if lower:
        data = LOWER[data]
    n = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), padded.data, strides=(1,))
    h = mix(mix(n.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93)) ^ (eight[starts] & _MASKS[np.minimum(n, 8)]))
    done, more = 8, np.flatnonzero(n > 8)
    while len(more) and done < _SHORT:
        part = eight[starts[more] + done] & _MASKS[np.minimum(n[more] - done, 8)]
        h[more] = mix(h[more] * np.uint64(0x9E3779B97F4A7C15) ^ part)
        done += 8
        more = more[n[more] > done]
    for i in more:
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and n + 1 offsets of the texts' words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offs)


def shingle_hashes(word_hash: np.ndarray, word_offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and the texts' offsets into them.

    A text of fewer than k words, but one at least, has its whole sequence as
    its only shingle.
    """
    n_words = np.diff(word_offs)
    count = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    offs = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(word_offs[:-1] - offs[:-1], count) + np.arange(offs[-1])
    out = np.zeros(offs[-1], np.uint64)
    size = np.repeat(np.minimum(n_words, k), count)
    for j in range(k):
        at = first + j
        more = size > j
        term = np.zeros(len(out), np.uint64)
        term[more] = mix(word_hash[at[more]] + np.uint64(0xA0761D6478BD642F * (j + 1) & (1 << 64) - 1))
        out = out * np.uint64(0xE7037ED1A0B428DB) + term
    return mix(out + size.astype(np.uint64)), offs


def distinct_in_rows(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order."""
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    order = np.argsort(values)
    if len(offs) <= 1 << 16:  # a stable sort of two-byte numbers takes linear time
        order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(row[order], kind="stable")]
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.searchsorted(r, np.arange(len(offs)))


def binaries(payload: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A binary column whose row i is payload[offs[i]:offs[i + 1]] as little-endian bytes."""
    data = np.ascontiguousarray(payload)
    at = (np.asarray(offs, np.int64) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def unbinaries(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values and offsets of a binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    size = np.dtype(dtype).itemsize
    if not len(column):
        return np.zeros(0, dtype), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), dtype), (offs - offs[0]) // size
