"""Removal of repeated passages with sparse suffix arrays.

Of all suffixes (from a word to the text's end) only those at minimiser positions
are kept: in every window of `min_words` words, the place whose k words hash lowest. The
choice depends on the window's content alone, so a passage that stands in two places
has its suffixes kept at the same places in both.

1. `_seeds` sorts the kept suffixes by their first k words and compares neighbours: a
   suffix that agrees with no other is dropped. What is left is a small part of
   the texts.
2. `_windows` extends the left ones to the left and right: each window of min_words
   words that chose such a suffix is hashed, the windows are sorted, and neighbours
   that agree are repeats. Windows in a row make up the passage, at its full length.

Both sorts run on packed arrays dealt to buckets by hash. Windows that a task
meets several times are settled there and one of them goes on, so a passage that
a third of all texts share loads no bucket.

The first occurrence of a passage, by (doc_id, place), stays; the words of later ones
are removed. Every removed word has a copy in a passage that stays. Words are runs of
other characters than white space, compared as they are, by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .shared import IdFilter, discard, pieces, released, save, tidy

K = 10
#: Words of the table for each bucket of windows: a group, and what a task packs for it, stay small.
BUCKET_WORDS = 2_000_000
#: Words and windows that a task holds before it hands them on.
HOLD = 600_000
_ROOT = 0xD1342543DE82EF95
_ROOT_INV = pow(_ROOT, -1, 1 << 64)


def _run_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; places without n words are left out."""
    m = len(word_hash)
    if m < n:
        return np.zeros(0, np.uint64)
    p = np.full(m + 1, _ROOT, np.uint64)
    p[0] = 1
    inv = np.full(m + 1, _ROOT_INV, np.uint64)
    inv[0] = 1
    p, inv = np.cumprod(p, dtype=np.uint64), np.cumprod(inv, dtype=np.uint64)
    sums = np.zeros(m + 1, np.uint64)
    np.cumsum(word_hash * p[:m], out=sums[1:])
    return tb.mix((sums[n:] - sums[:-n]) * inv[: m - n + 1])


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the lowest of `width` values from each place on, the first of equals."""
    m = len(values) - width + 1
    v, at = values, np.arange(len(values))
    p = 1
    while 2 * p <= width:
        right = v[p:] < v[:-p]
        v, at = np.where(right, v[p:], v[:-p]), np.where(right, at[p:], at[:-p])
        p *= 2
    shift = width - p
    right = v[shift : shift + m] < v[:m]
    return np.where(right, at[shift : shift + m], at[:m])


def _windows_of(data: np.ndarray, offs: np.ndarray, min_words: int, k: int):
    """(text, first word in the text, seed hash, place of the seed, window hash) of all windows, and the texts' word counts."""
    s, e, w = tb.words(data, offs)
    h = tb.span_hashes(data, s, e)
    n = np.diff(w)
    if len(h) < min_words:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none, none.astype(np.uint64), n
    text = np.repeat(np.arange(len(n)), n)
    first = np.flatnonzero(text[min_words - 1 :] == text[: len(text) - min_words + 1])
    seed = _run_hashes(h, k)
    at = _lowest(seed, min_words - k + 1)[first]
    return text[first], first - w[text[first]], seed[at], at, _run_hashes(h, min_words)[first], n


def _uids(column: pa.Array, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """An id for each row of an id column: equal for rows of equal doc_id and text."""
    return tb.mix(tb.span_hashes(data, offs[:-1], offs[1:]) + tb.mix(_ids(column).view(np.uint64) ^ _salt(column))).view(np.int64)


_NULL_ID = np.iinfo(np.int64).min


def _ids(column: pa.Array) -> np.ndarray:
    """The ids, in their order; a null one is the smallest."""
    return column.fill_null(_NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _salt(column: pa.Array) -> np.ndarray:
    """What tells a null id from the smallest one in a uid."""
    return column.is_null().to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _seeds(docs: DataFrame, min_words: int, k: int, buckets: int) -> DataFrame:
    """Rows of each document (doc_id, uid, n_words), and packed seeds by bucket."""

    def scan(batches):
        held: list[np.ndarray] = []

        def flush():
            key, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            some, cut = np.unique(bucket[by], return_index=True)
            cut = np.append(cut, len(by))
            one = [key[by[a:b]][count[by[a:b]] == 1].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            more = [key[by[a:b]][count[by[a:b]] > 1].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            m = len(some)
            return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(some, pa.int32()), pa.array(one, pa.binary()), pa.array(more, pa.binary())], ["doc_id", "uid", "n_words", "bucket", "one", "more"])

        size = 0
        for batch in batches:
            for lo, hi, data, offs in tb.chunks(batch.column(1)):
                _, _, seed, at, _, n = _windows_of(data, offs, min_words, k)
                if len(at):
                    fresh = np.ones(len(at), bool)
                    fresh[1:] = at[1:] != at[:-1]
                    held.append(seed[fresh])
                    size += int(fresh.sum())
                m = hi - lo
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, m), pa.array(_uids(batch.column(0).slice(lo, hi - lo), data, offs)), pa.array(n.astype(np.int64)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], ["doc_id", "uid", "n_words", "bucket", "one", "more"])
                if size >= HOLD:
                    yield from pieces(flush())
                    size = 0
        if held:
            yield from pieces(flush())

    return save(docs.mapInArrow(tidy(scan), "doc_id long, uid long, n_words long, bucket int, one binary, more binary"), "seeds")


def _repeated(table: pa.Table) -> pa.Table:
    """Seeds of one bucket that occur more than once."""
    one = np.concatenate([np.frombuffer(b.as_py(), np.uint64) for b in table.column("one")])
    more = np.concatenate([np.frombuffer(b.as_py(), np.uint64) for b in table.column("more")])
    one.sort()
    again = np.unique(np.concatenate([more, one[1:][one[1:] == one[:-1]], one[np.isin(one, more)]]))
    return pa.table({"seed": again.view(np.int64)})


_HIT = "kind int, bucket int, doc binary, uid binary, at binary, hash binary, again binary"


def _pack(kind: int, bucket: np.ndarray, buckets: int, cols: list[np.ndarray]) -> pa.RecordBatch | None:
    by = np.argsort(bucket, kind="stable")
    some, cut = np.unique(bucket[by], return_index=True)
    if not len(some):
        return None
    cut = np.append(cut, len(by))
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(some), pa.int32()), pa.array(some, pa.int32()), *(pa.array([c[by[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for c in cols)], [c.split()[0] for c in _HIT.split(", ")])


def _windows(docs: DataFrame, min_words: int, k: int, wanted: IdFilter, buckets: int) -> DataFrame:
    """kind 0: windows by bucket of their hash, still to be compared. kind 1: repeats that are settled, by bucket of their document."""

    def scan(batches):
        held: list = []

        def flush():
            doc, uid, at, key = (np.concatenate([h[i] for h in held]) for i in range(4))
            held.clear()
            by = np.lexsort((at, uid, doc, key))
            doc, uid, at, key = doc[by], uid[by], at[by], key[by]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            again = np.zeros(len(key), np.uint8)
            again[:-1] = first[:-1] & ~first[1:]
            if (out := _pack(0, (key[first] % np.uint64(buckets)).astype(np.int64), buckets, [doc[first], uid[first], at[first], key[first], again[first]])) is not None:
                yield from pieces(out)
            # a repeat of a window of the same task isn't the first occurrence, except in an equal row
            late = ~first
            head = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            later = ~((uid == uid[head]) & (at == at[head]))
            if (out := _pack(1, _home(uid[late], buckets), buckets, [doc[late], uid[late], at[late], key[late], later[late].astype(np.uint8)])) is not None:
                yield from pieces(out)

        size = 0
        for batch in batches:
            doc = _ids(batch.column(0))
            for lo, hi, data, offs in tb.chunks(batch.column(1)):
                text, at, seed, place, window, _ = _windows_of(data, offs, min_words, k)
                if not len(text):
                    continue
                new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                keep = np.repeat(wanted(seed[new].view(np.int64)), np.diff(np.append(new, len(seed))))
                t = text[keep]
                held.append((doc[lo:hi][t], _uids(batch.column(0).slice(lo, hi - lo), data, offs)[t], at[keep].astype(np.int32), window[keep]))
                size += len(t)
                if size >= HOLD:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return save(docs.mapInArrow(tidy(scan), _HIT), "windows")


def _home(uid: np.ndarray, buckets: int) -> np.ndarray:
    return (tb.mix(uid.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _columns(table: pa.Table) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(b.as_py(), t) for b in table.column(c)]) for c, t in (("doc", np.int64), ("uid", np.int64), ("at", np.int32), ("hash", np.uint64), ("again", np.uint8))]


def _compare(table: pa.Table, buckets: int) -> pa.Table:
    """Repeats among the windows of one bucket; `again` of a result: it isn't the first occurrence."""
    doc, uid, at, key, again = _columns(table)
    by = np.lexsort((at, uid, doc, key))
    doc, uid, at, key, again = doc[by], uid[by], at[by], key[by], again[by]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    last = np.append(first[1:], True)
    repeat = ~(first & last) | (again > 0)
    # equal rows of one document both count as the first occurrence
    head = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    later = ~((uid == uid[head]) & (at == at[head]))
    out = _pack(1, _home(uid[repeat], buckets), buckets, [doc[repeat], uid[repeat], at[repeat], key[repeat], later[repeat].astype(np.uint8)])
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("doc", "uid", "at", "hash", "again"))])
    return pa.Table.from_batches([out] if out is not None else [], schema)


def _parts(batches, rows: int = 500):
    """The batches in parts of few rows, so that few texts are copied at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _islands(uid: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, start, end) of the unions of [at, at + size), for sorted uid and at."""
    if not len(uid):
        return uid, at, at
    new = np.ones(len(uid), bool)
    new[1:] = (uid[1:] != uid[:-1]) | (at[1:] > at[:-1] + size)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(uid) - 1)
    return uid[new], at[new].astype(np.int64), at[last].astype(np.int64) + size


def _spans(table: pa.Table, min_words: int) -> pa.Table:
    """The word ranges of each document of one bucket: all repeated passages, and those to remove."""
    _, uid, at, _, again = _columns(table)
    by = np.lexsort((at, uid))
    uid, at, again = uid[by], at[by], again[by] > 0
    ids = np.unique(uid)
    cols: dict[str, pa.Array] = {"uid": pa.array(ids)}
    for name, keep in (("repeated", slice(None)), ("removed", again)):
        u, a, b = _islands(uid[keep], at[keep], min_words)
        offs = np.searchsorted(u, np.append(ids, ids[-1] + 1 if ids[-1] < np.iinfo(np.int64).max else ids[-1]), "left")
        offs[-1] = len(u)
        for part, values in (("start", a), ("end", b)):
            cols[f"{name}_{part}"] = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values.astype(np.int32)))
    return pa.table(cols)


_SPANS = "uid long, repeated_start array<int>, repeated_end array<int>, removed_start array<int>, removed_end array<int>"


def repeated_passages(docs: DataFrame, min_words: int = 50, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): doc_id, uid and n_words of each row; and by uid the word ranges of its repeated passages and of those to remove.

    A passage is repeated if at least min_words words in a row stand at two places, of
    two documents or of one. Rows of equal doc_id and text have one uid and count
    as one place each; both are first occurrences. A null or short text has no
    passage; a null id comes first in the order. Further columns are ignored.
    """
    if min_words < k:
        raise ValueError("a passage must have at least k words")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = _seeds(docs, min_words, k, max(48, docs.count() // 10_000))
    rows = profile.where("bucket is null").select("doc_id", "uid", "n_words")
    seeds = save(profile.where("bucket is not null").groupBy("bucket").applyInArrow(lambda t: released(_repeated(t)), "seed long"), "repeated")
    total = rows.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(12, -(-total // BUCKET_WORDS))
    wanted = IdFilter.of(seeds, "seed", seeds.count())
    discard(seeds)
    found = _windows(docs, min_words, k, wanted, buckets)
    compared = found.where("kind = 0").groupBy("bucket").applyInArrow(lambda t: released(_compare(t, buckets)), _HIT)
    spans = found.where("kind = 1").union(compared).groupBy("bucket").applyInArrow(lambda t: released(_spans(t, min_words)), _SPANS)
    spans = save(spans, "spans")
    discard(found)
    return rows, spans


def passage_report(docs: DataFrame, min_words: int = 50, k: int = K) -> DataFrame:
    """For each row: doc_id, n_words, n_repeated and n_removed (words in repeated passages, and in those to remove), repeated and removed (word ranges start:end, comma-joined)."""
    rows, spans = repeated_passages(docs, min_words, k)
    # equal rows have one uid: one line of spans serves them all
    out = rows.join(spans, "uid", "left")
    length = lambda c: F.coalesce(F.aggregate(F.zip_with(f"{c}_start", f"{c}_end", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y), F.lit(0).cast("long"))
    text = lambda c: F.coalesce(F.array_join(F.zip_with(f"{c}_start", f"{c}_end", lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string"))), ","), F.lit(""))
    return out.select("doc_id", "n_words", length("repeated").alias("n_repeated"), length("removed").alias("n_removed"), text("repeated").alias("repeated"), text("removed").alias("removed"))


def remove_passages(docs: DataFrame, min_words: int = 50, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same table with the words of all later occurrences of repeated passages cut from the text.

    With a removed word goes the white space after it. Texts without such words, and
    nulls, stay as they are; no row goes. Columns named _uid, removed_start or removed_end are an error.
    """
    if clash := {"_uid", "removed_start", "removed_end"} & set(docs.columns):
        raise ValueError(f"the table has columns {sorted(clash)}")
    _, spans = repeated_passages(docs, min_words, k, id_col, text_col)
    # each uid has one line of spans
    cut = save(spans.where(F.size("removed_start") > 0).select("uid", "removed_start", "removed_end"), "cut")
    discard(spans)
    wanted = IdFilter.of(cut, "uid", cut.count())
    cols = docs.columns
    key, body = cols.index(id_col), cols.index(text_col)

    def split(hit: bool):
        """Rows that may have words to cut, with their uid, or all others: only the former are shuffled."""

        def scan(batches):
            for batch in _parts(batches):
                ids = batch.column(key).cast(pa.int64())
                uid = [_uids(ids.slice(lo, hi - lo), data, offs) for lo, hi, data, offs in tb.chunks(batch.column(body))]
                uid = np.concatenate(uid) if uid else np.zeros(0, np.int64)
                out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(uid)], [*cols, "_uid"])
                yield out.filter(pa.array(wanted(uid) == hit))

        return docs.mapInArrow(tidy(scan), schema + ", _uid long")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    marked = split(True).join(cut.withColumnRenamed("uid", "_uid"), "_uid", "left").select(*cols, "removed_start", "removed_end")

    def trim(batches):
        for batch in _parts(batches):
            text = batch.column(body)
            out = None
            for i, (a, b) in enumerate(zip(batch.column(len(cols)), batch.column(len(cols) + 1), strict=True)):
                if a.is_valid:
                    out = out or text.to_pylist()
                    data = np.frombuffer(out[i].encode(), np.uint8)
                    s, _, _ = tb.words(data, np.array([0, len(data)]))
                    s = np.append(s, len(data))
                    keep = np.ones(len(data), bool)
                    for x, y in zip(a.as_py(), b.as_py(), strict=True):
                        keep[s[x] : s[y]] = False
                    out[i] = data[keep].tobytes().decode()
            columns = list(batch.columns[: len(cols)])
            if out is not None:
                columns[body] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, cols)

    return split(False).select(*cols).union(marked.mapInArrow(tidy(trim), schema))
