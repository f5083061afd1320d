"""Token-id files in Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector and 60 bits of equally wide ids; the selector
says how many. An id of more than 60 bits is written as an escape, two
words of 32 bits each. Ids go in blocks of BLOCK ids; a file holds the word
offset of each block, so that a block is decoded alone and all words of a
selector are decoded at once.

File, little-endian: 8 bytes of magic, then as unsigned 64-bit numbers the block
size and the numbers of texts, ids, blocks and words; the texts' doc_id (64-bit),
whether it is null (8-bit) and id count (64-bit); nblocks + 1 word offsets;
the words.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbuf as tb
from .shared import fresh_path, save, shuffle_width
from .wordcode import byte_bpe

MAGIC = b"GMS8IDS1"
BLOCK = 4096
#: Ids of a file at most, about.
FILE_IDS = 1 << 22
#: (ids in a word, bits of each), by selector; two selectors more are the halves of an escape.
LAYOUT = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
HIGH, LOW = 14, 15


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, n_blocks + 1 word offsets) of non-negative ids below 2 ** 64."""
    ids = np.asarray(ids).astype(np.uint64)
    n_blocks = -(-len(ids) // block)
    if not n_blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    pad = 60
    grid = np.zeros((n_blocks, block + pad), np.uint64)
    full = np.zeros(n_blocks * block, np.uint64)
    full[: len(ids)] = ids
    grid[:, :block] = full.reshape(n_blocks, block)
    width = np.frexp((grid & np.uint64(0xFFFFFFFF)).astype(np.float64))[1].astype(np.uint8)
    if ids.max() >> np.uint64(32):
        width = np.where(grid >> np.uint64(32), 32 + np.frexp((grid >> np.uint64(32)).astype(np.float64))[1], width).astype(np.uint8)
    most = {1: width}
    p = 1
    while 2 * p <= 32:
        most[2 * p] = np.maximum(most[p][:, :-p], most[p][:, p:])
        p *= 2
    # where a selector fits, all later ones do
    pick = np.zeros((n_blocks, block), np.uint8)
    for n, bits in LAYOUT:
        p = 1 << (n.bit_length() - 1)
        pick += np.maximum(most[p][:, :block], most[p][:, n - p : n - p + block]) > bits
    step = np.array([n for n, _ in LAYOUT] + [1, 1])[pick]
    length = np.full(n_blocks, block)
    length[-1] = len(ids) - (n_blocks - 1) * block
    live, at = np.arange(n_blocks), np.zeros(n_blocks, np.int64)
    begun = np.zeros((n_blocks, block), bool)
    while len(live):
        begun[live, at[live]] = True
        at[live] += step[live, at[live]]
        live = live[at[live] < length[live]]
    blk, col = np.nonzero(begun)
    sel = pick[blk, col]
    wide = (sel == HIGH).astype(np.int64)
    place = np.concatenate([[0], np.cumsum(1 + wide)])
    words = np.zeros(place[-1], np.uint64)
    for s in np.unique(sel):
        mine = sel == s
        if s == HIGH:
            v = grid[blk[mine], col[mine]]
            words[place[:-1][mine]] = np.uint64(HIGH) << np.uint64(60) | v >> np.uint64(32)
            words[place[:-1][mine] + 1] = np.uint64(LOW) << np.uint64(60) | v & np.uint64(0xFFFFFFFF)
            continue
        n, bits = LAYOUT[s]
        w = np.full(int(mine.sum()), np.uint64(s) << np.uint64(60), np.uint64)
        b, c = blk[mine], col[mine]
        for j in range(n):
            w |= grid[b, c + j] << np.uint64(bits * j)
        words[place[:-1][mine]] = w
    first = np.searchsorted(blk, np.arange(n_blocks + 1))
    return words, place[first].astype(np.uint64)


def decode(words: np.ndarray, word_offs: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    """The ids of all the blocks that word_offs spans; n_ids is their number."""
    words, base = words[int(word_offs[0]) : int(word_offs[-1])], word_offs.astype(np.int64) - int(word_offs[0])
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = np.array([n for n, _ in LAYOUT] + [1, 0])[sel]
    ends = np.cumsum(count)
    starts = ends - count
    n_blocks = len(base) - 1
    # padding in a block's last word is cut: each block starts at its own place
    in_block = np.repeat(np.arange(n_blocks), np.diff(base))
    first = starts[np.minimum(base[:-1], max(len(words) - 1, 0))] if len(words) else np.zeros(0, np.int64)
    starts = starts - first[in_block] + in_block * block
    limit = np.minimum((in_block + 1) * block, n_ids)
    out = np.zeros(n_blocks * block, np.uint64)
    for s in np.unique(sel):
        mine = np.flatnonzero(sel == s)
        if s == LOW:
            continue
        if s == HIGH:
            out[starts[mine]] = (words[mine] & np.uint64(0xFFFFFFFF)) << np.uint64(32) | words[mine + 1] & np.uint64(0xFFFFFFFF)
            continue
        n, bits = LAYOUT[s]
        for j in range(n):
            to = starts[mine] + j
            ok = to < limit[mine]
            out[to[ok]] = words[mine[ok]] >> np.uint64(bits * j) & np.uint64((1 << bits) - 1)
    return out[:n_ids]


def to_file(doc_ids: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, offs = encode(ids)
    head = np.array([BLOCK, len(counts), len(ids), len(offs) - 1, len(words)], "<u8")
    return b"".join([MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), null.astype("u1").tobytes(), counts.astype("<u8").tobytes(), offs.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def from_file(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, null, counts, ids) of a file."""
    if blob[:8] != MAGIC:
        raise ValueError("not a token-id file")
    block, n, n_ids, n_blocks, n_words = (int(x) for x in np.frombuffer(blob, "<u8", 5, 8))
    at = 48
    doc_ids = np.frombuffer(blob, "<i8", n, at)
    null = np.frombuffer(blob, "u1", n, at + 8 * n).astype(bool)
    counts = np.frombuffer(blob, "<u8", n, at + 9 * n).astype(np.int64)
    offs = np.frombuffer(blob, "<u8", n_blocks + 1, at + 17 * n)
    words = np.frombuffer(blob, "<u8", n_words, at + 17 * n + 8 * (n_blocks + 1))
    return doc_ids, null, counts, decode(words, offs, n_ids, block)


def _put(folder: str, name: str, blob: bytes) -> None:
    """Write a file whole or not at all; a task that runs again puts the same file."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    part = f"{root}/_part-{name}-{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(part) as f:
        f.write(blob)
    store.move(part, f"{root}/{name}")


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts to files in ascending id order; (file, n_texts, n_ids) of each file.

    `folder` is a URI that every executor can write (file:, or another scheme
    that pyarrow.fs knows). A null or empty text has only the id `end`. Rows with
    equal ids all stay, ordered by text; a null id comes first. Further columns
    are ignored; an empty table writes no file.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = docs.repartitionByRange(shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def scan(batches):
        coder, part, k = byte_bpe(tokenizer), TaskContext.get().partitionId(), 0
        held: list = []

        def flush():
            nonlocal k
            doc, null, count, ids = (np.concatenate([h[i] for h in held]) for i in range(4))
            name = f"{part:08d}-{k:06d}.s8b"
            _put(folder, name, to_file(doc, null, count, ids))
            k += 1
            held.clear()
            return pa.RecordBatch.from_pydict({"file": [name], "n_texts": pa.array([len(count)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64())})

        size = 0
        for batch in batches:
            doc = batch.column(0)
            null = doc.is_null().to_numpy(zero_copy_only=False)
            doc = doc.fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in tb.chunks(batch.column(1)):
                ids, at = coder(data, offs, end)
                held.append((doc[lo:hi], null[lo:hi], np.diff(at), ids))
                size += len(ids)
                if size >= FILE_IDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return save(dealt.mapInArrow(scan, "file string, n_texts long, n_ids long"), "id-files")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, file, start, ids) of every text in the files, start counted from the file's first id."""

    def scan(batches):
        for batch in batches:
            for path, blob in zip(batch.column(0), batch.column(1), strict=True):
                doc, null, counts, ids = from_file(blob.as_py())
                offs = np.concatenate([[0], np.cumsum(counts)])
                for lo in range(0, len(doc), 1000):
                    hi = min(lo + 1000, len(doc))
                    at = pa.array((offs[lo : hi + 1] - offs[lo]).astype(np.int32))
                    values = pa.array(ids[offs[lo] : offs[hi]].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi], mask=null[lo:hi]), pa.array([path.as_py().rpartition("/")[2]] * (hi - lo)), pa.array(offs[lo:hi]), pa.ListArray.from_arrays(at, values)], ["doc_id", "file", "start", "ids"])

    return _files(spark, folder).mapInArrow(scan, "doc_id long, file string, start long, ids array<long>")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select("path", "content")


def id_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every text, from the files alone; start counts the ids of all texts before it."""

    def scan(batches):
        for batch in batches:
            for path, blob in zip(batch.column(0), batch.column(1), strict=True):
                doc, null, counts, ids = from_file(blob.as_py())
                raw, offs = memoryview(ids.astype("<u4").tobytes()), np.concatenate([[0], np.cumsum(counts)])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=null), pa.array([path.as_py().rpartition("/")[2]] * len(doc)), pa.array(offs[:-1]), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "file", "at", "n_tokens", "ids_crc32"])

    rows = save(_files(spark, folder).mapInArrow(scan, "doc_id long, file string, at long, n_tokens long, ids_crc32 long"), "id-digests")
    # one row for each file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(base, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_id_files(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    """Write the ids of all documents below the shared folder and give the digests read back from there."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "ids")
    if write_ids(docs, folder, tokenizer, end).isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return id_digests(spark, folder)
