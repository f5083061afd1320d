"""Packing of training examples into sequences by vector bin packing.

Each piece of an example needs tokens, one segment and loss-bearing tokens; a sequence
has a limit on each. A document longer than a sequence is cut at multiples of the
sequence length: the full pieces are sequences of their own, the rest is packed.
The dot-product heuristic fills one sequence after the other: of the kinds of
pieces that still fit, it places the one whose needs, weighted by how scarce each
resource is over the block, best agree with what the sequence has left.

Pieces are packed in blocks of about BLOCK pieces dealt by a hash, so that the work of a
task and its memory are bounded whatever the input; a block leaves at most a few
sequences unfilled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .shared import save, tidy
from .wordcode import byte_bpe

BLOCK = 8192


def place(needs: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, order within it) of each row of needs; a row has the need of each resource.

    A row that exceeds a limit alone is an error. Rows with equal needs are placed
    in their given order.
    """
    if not len(needs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if (needs > limits).any():
        raise ValueError("a piece exceeds the limits of a sequence")
    kind, back, count = np.unique(needs, axis=0, return_inverse=True, return_counts=True)
    back = back.ravel()
    by_kind = np.argsort(back, kind="stable")
    nxt = np.concatenate([[0], np.cumsum(count)])[:-1]
    share = kind / limits
    scarce = (needs / limits).mean(axis=0)
    weighted = share * scarce
    left_of = count.copy()
    out_bin, out_order = np.zeros(len(needs), np.int64), np.zeros(len(needs), np.int64)
    live = np.arange(len(kind))
    todo, b, used, room = len(needs), 0, 0, limits.astype(np.int64).copy()
    while todo:
        live = live[left_of[live] > 0] if todo % 64 == 0 else live
        ok = (kind[live] <= room).all(axis=1) & (left_of[live] > 0)
        if not ok.any():
            b, used, room = b + 1, 0, limits.astype(np.int64).copy()
            continue
        fit = live[ok]
        k = fit[np.argmax(weighted[fit] @ (room / limits))]
        row = by_kind[nxt[k]]
        nxt[k] += 1
        left_of[k] -= 1
        out_bin[row], out_order[row] = b, used
        used += 1
        room -= kind[k]
        todo -= 1
    return out_bin, out_order


def pack(pieces: DataFrame, max_tokens: int = 1024, max_segments: int = 256, max_loss: int | None = None) -> DataFrame:
    """Add sequence_id and offset to a table with `length` and `n_loss` (tokens and loss-bearing tokens of each piece).

    A piece of max_tokens is a sequence of its own; one of more is an error, as is a
    null. Equal rows are separate pieces. Further columns stay; one named like an added one is an
    error. The blocks follow the places of the rows: give it a saved table, so that a task
    that runs again finds the same ones.
    """
    limits = np.array([max_tokens, max_segments, max_tokens if max_loss is None else max_loss], np.int64)
    cols = pieces.columns
    if clash := {"sequence_id", "offset", "_block"} & set(cols):
        raise ValueError(f"the table has columns {sorted(clash)}")
    n = pieces.count()
    blocks = max(1, -(-n // BLOCK))
    # the row's place keeps equal rows from one block
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))

    def fill(table: pa.Table) -> pa.Table:
        block = table.column("_block")[0].as_py()
        by = [(c, "ascending") for c in cols if not pa.types.is_nested(table.schema.field(c).type)]
        table = table.drop_columns(["_block"]).sort_by(by)
        length, loss = (table.column(c).to_numpy().astype(np.int64) for c in ("length", "n_loss"))
        seq, order = place(np.stack([length, np.ones_like(length), loss], axis=1), limits)
        rank = np.lexsort((order, seq))
        end = np.cumsum(length[rank])
        s = seq[rank]
        begin = end - length[rank]
        base = begin[np.searchsorted(s, s)]
        offset = np.empty_like(length)
        offset[rank] = begin - base
        return table.append_column("sequence_id", pa.array(seq * blocks + block)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("_block").applyInArrow(fill, schema)


def document_pieces(docs: DataFrame, tokenizer: str, end: int = 0, max_tokens: int = 1024, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None) -> DataFrame:
    """(doc_id, start, length, n_loss, ids_crc32, doc_tokens) of the pieces of all documents.

    loss_col: a boolean column; where it isn't true, a document's tokens bear no loss.

    A null or empty text has one token, the end id. The first token of a document bears no
    loss: nothing predicts it. Rows with equal ids are separate documents; a null
    id stays null.
    """
    bears = F.lit(True) if loss_col is None else F.coalesce(F.col(loss_col).cast("boolean"), F.lit(False))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), bears.alias("bears"))

    def scan(batches):
        coder = byte_bpe(tokenizer)
        for batch in batches:
            for lo, hi, data, offs in tb.chunks(batch.column(1)):
                ids, at = coder(data, offs, end)
                n = np.diff(at)
                parts = -(-n // max_tokens)
                doc = np.repeat(np.arange(hi - lo), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * max_tokens
                length = np.minimum(n[doc] - start, max_tokens)
                raw, a = memoryview(ids.astype("<u4").tobytes()), at[doc] + start
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), (a + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array((length - (start == 0)) * batch.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False)[doc]), pa.array(crc, pa.int64()), pa.array(n[doc])], ["doc_id", "start", "length", "n_loss", "ids_crc32", "doc_tokens"])

    return docs.mapInArrow(tidy(scan, keep=True), "doc_id long, start long, length long, n_loss long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 0, max_tokens: int = 1024, max_segments: int = 256) -> DataFrame:
    """The pieces of all documents with their sequence and offset there; an empty table gives none."""
    return pack(save(document_pieces(docs, tokenizer, end, max_tokens), "pieces"), max_tokens, max_segments)


def pack_conversations(turns: DataFrame, tokenizer: str, end: int = 0, max_tokens: int = 1024, max_segments: int = 64, max_loss: int = 512, learned: str = "assistant") -> DataFrame:
    """Pack the turns (conv_id, role, text) of instruction data: only tokens of the learned role bear loss, and a sequence holds at most max_loss of these.

    Each turn is an example of its own, so that no conversation gathers in one task; a turn is cut at
    the smaller of the two limits where its tokens bear loss. Nulls and repeats as in document_pieces.
    """
    marked = turns.withColumn("_learned", F.col("role").eqNullSafe(learned))
    cut = min(max_tokens, max_loss)
    parts = [document_pieces(marked.where("_learned"), tokenizer, end, cut, "conv_id", "text", "_learned"), document_pieces(marked.where("not _learned"), tokenizer, end, max_tokens, "conv_id", "text", "_learned")]
    return pack(save(parts[0].union(parts[1]).withColumnRenamed("doc_id", "conv_id"), "pieces"), max_tokens, max_segments, max_loss)
