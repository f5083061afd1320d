"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of many words lie in one flat array. In each round every word finds the
best-scored pair of neighbours (a segmented minimum of ranks), all its leftmost
non-overlapping occurrences merge at once, and the array is compacted; words without a
pair leave. Characters without a piece become byte pieces at the end. Words, that is runs
of spaces with what follows, are independent, as no piece has a space after another
character; each distinct one is coded once a worker (see wordcode).

For models of type BPE with byte fallback, identity normalisation, a dummy prefix and
kept white space; others are refused.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .shared import KEPT
from .wordcode import WordTable, gather

BLANK = "▁"


class PieceBpe:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        normal = {p: i for i, (p, s) in enumerate(zip(self.pieces, special, strict=True)) if not s}
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if not all(sp.is_byte(int(i)) for i in self.byte_id) or any(BLANK in p.lstrip(BLANK) for p in normal) or sp.encode("  a  ") != sp.encode(" ▁a▁ ") or sp.encode("ﬁ") == sp.encode("fi"):
            raise ValueError("the model isn't a BPE with byte fallback, identity normalisation and kept white space")
        letters = sorted({c for p in normal for c in p})
        extra = [c for c in letters if c not in normal]
        self.size = n + len(extra)
        number = normal | {c: n + i for i, c in enumerate(extra)}
        self.char_point = np.array([ord(c) for c in letters], np.int64)
        self.char_id = np.array([number[c] for c in letters], np.int64)
        score = np.array([sp.get_score(i) for i in range(n)])
        rank = np.argsort(np.argsort(-score, kind="stable"), kind="stable")
        pairs = {}
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                if (a := number.get(piece[:k])) is not None and (b := number.get(piece[k:])) is not None:
                    pairs[a * self.size + b] = i
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[p] for p in self.pair.tolist()], np.int64)
        self.rank = rank[self.merged].astype(np.int64)
        self.none = np.int64(1 << 40)
        # bytes of each piece, for decoding
        blob = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        self.blob_at = np.concatenate([[0], np.cumsum([len(b) for b in blob])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.leads = np.array([p.startswith(BLANK) for p in self.pieces])
        self.text_of = [str(i) for i in range(n)]
        self.table = WordTable(self._code)

    def _pairs(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in the pair table of each symbol with its right neighbour."""
        key = np.where((word[1:] == word[:-1]) & (sym[1:] >= 0) & (sym[:-1] >= 0), sym[:-1] * self.size + sym[1:], -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.append(np.where(self.pair[at] == key, self.rank[at], self.none), self.none), np.append(at, 0)

    def _code(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, offs = gather(data, starts, ends - starts)
        first = np.flatnonzero((flat & 0xC0) != 0x80)
        points = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        points = np.where(points == 32, ord(BLANK), points)
        at = np.minimum(np.searchsorted(self.char_point, points), len(self.char_point) - 1)
        sym = np.where(self.char_point[at] == points, self.char_id[at], -1)
        width = np.diff(np.append(first, len(flat)))
        word = np.searchsorted(offs, first, "right") - 1
        done: list[tuple[np.ndarray, ...]] = []
        while len(sym):
            rank, place = self._pairs(sym, word)
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, begin)
            count = np.diff(np.append(begin, len(sym)))
            best_of = np.repeat(best, count)
            over = best_of == self.none
            if over.any():
                done.append((word[over], sym[over], first[over], width[over]))
                keep = ~over
                sym, word, first, width, rank, place, best_of = (x[keep] for x in (sym, word, first, width, rank, place, best_of))
                if not len(sym):
                    break
            hit = rank == best_of
            # of overlapping hits, as in a row of equal symbols, every second from the left
            start = hit & ~np.append(False, hit[:-1])
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
            hit &= run % 2 == 0
            to = np.flatnonzero(hit)
            sym = sym.copy()
            sym[to] = self.merged[place[to]]
            width = width.copy()
            width[to] += width[to + 1]
            keep = np.ones(len(sym), bool)
            keep[to + 1] = False
            sym, word, first, width = sym[keep], word[keep], first[keep], width[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        word, sym, first, width = (np.concatenate([d[i] for d in done]) for i in range(4))
        by = np.argsort(first, kind="stable")
        word, sym, first, width = word[by], sym[by], first[by], width[by]
        raw = (sym < 0) | (sym >= len(self.pieces))
        n = np.where(raw, width, 1)
        ids = np.repeat(sym, n).astype(np.int32)
        if raw.any():
            bytes_, _ = gather(flat, first[raw], width[raw])
            ids[np.repeat(raw, n)] = self.byte_id[bytes_]
        return ids, np.bincount(word, weights=n, minlength=len(starts)).astype(np.int64)

    def encode(self, column: pa.Array):
        """(first row, row after the last, ids, offsets) of chunks of a string column."""
        column = pc.fill_null(column, "")
        column = pc.replace_substring(column, BLANK, " ")
        # the dummy prefix; an empty text gets none
        column = pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise(pa.scalar("", column.type), column, " "))
        for lo, hi, data, offs in tb.chunks(column):
            blank = data == 32
            cut = np.zeros(len(data), bool)
            cut[1:] = blank[1:] & ~blank[:-1]
            cut[offs[:-1][np.diff(offs) > 0]] = True
            starts = np.flatnonzero(cut)
            ids, at = self.table(data, starts, np.append(starts[1:], len(data)))
            yield lo, hi, ids, at[np.searchsorted(starts, offs)]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """The texts of rows of ids, in UTF-8; bytes that form no character become U+FFFD, one each."""
        size = self.blob_at[ids + 1] - self.blob_at[ids]
        flat, at = gather(self.blob, self.blob_at[ids], size)
        raw, at = flat.tobytes(), at[offs]
        # the dummy prefix goes
        lead = (np.diff(offs) > 0) & self.leads[np.append(ids, 0)[np.minimum(offs[:-1], len(ids))]]
        out = []
        for a, b in zip((at[:-1] + lead).tolist(), at[1:].tolist(), strict=True):
            text = raw[a:b]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = _repaired(text)
            out.append(text)
        return out


def _repaired(text: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(text):
        for n in (1, 2, 3, 4):
            try:
                out += text[i : i + n].decode().encode()
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out += "�".encode()
            i += 1
    return bytes(out)


_coders: dict[str, PieceBpe] = {}
KEPT.append(_coders)


def piece_bpe(path: str) -> PieceBpe:
    """The coder of this Python worker."""
    if path not in _coders:
        _coders[path] = PieceBpe(path)
    return _coders[path]


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Add the ids of a text column (array of int); a null or empty text has none."""
    at = docs.columns.index(text_col)
    cols = [*docs.columns, out_col]

    def scan(batches):
        coder = piece_bpe(model)
        for batch in batches:
            for lo, hi, ids, offs in coder.encode(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))], cols)

    return docs.mapInArrow(scan, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{out_col}` array<int>")


def decode_pieces(table: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text of a column of ids; null ids give null."""
    at = table.columns.index(ids_col)
    cols = [*table.columns, out_col]

    def scan(batches):
        coder = piece_bpe(model)
        for batch in batches:
            rows = batch.column(at)
            null = rows.is_null().to_numpy(zero_copy_only=False)
            flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            offs = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))])
            texts = pa.array([None if x else t.decode() for t, x in zip(coder.decode(flat, offs), null, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], cols)

    return table.mapInArrow(scan, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema) + f", `{out_col}` string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, the ids encoded and decoded in one pass.

    A null text counts as empty and has no ids; null or equal ids stay separate rows;
    further columns are ignored.
    """

    def scan(batches):
        coder = piece_bpe(model)
        for batch in batches:
            for lo, hi, ids, offs in coder.encode(batch.column(1)):
                decoded = [hashlib.sha256(t).hexdigest() for t in coder.decode(ids, offs)]
                names, each = coder.text_of, ids.tolist()
                listed = [hashlib.sha256(",".join([names[i] for i in each[a:b]]).encode()).hexdigest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(listed), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(scan, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
