"""Many delimited text files as one table: encodings tried in order, headers mapped file by file, bad lines reported as rows."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that a file is handed on in.
BATCH = 10_000
ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")


def _decoded(content: bytes, encodings: tuple[str, ...]) -> tuple[str, str] | None:
    for name in encodings:
        try:
            return content.decode(name), name
        except UnicodeDecodeError:
            continue
    return None


def _lines(text: str, sep: str, wanted: dict[str, list[str]]) -> Iterator[tuple]:
    """(cells, index, error, raw) of each record; first of all a lone error if the header lacks a column."""
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=sep, escapechar="\\")
    rows = iter(reader)
    header = next((r for r in rows if r), [])
    place: dict[str, int] = {}
    for i, name in enumerate(header):
        place.setdefault(name.strip().lstrip("﻿").lower(), i)
    at = []
    for name, aliases in wanted.items():
        hit = next((place[a.lower()] for a in (name, *aliases) if a.lower() in place), None)
        if hit is None:
            yield [None] * len(wanted), None, f"no column {name}", None
            return
        at.append(hit)
    index = 0
    while True:
        try:
            row = next(rows)
        except StopIteration:
            return
        except csv.Error as e:
            yield [None] * len(wanted), index, str(e), None
            index += 1
            continue
        if not row:
            continue
        if len(row) > len(header):
            yield [None] * len(wanted), index, f"{len(row)} cells, {len(header)} in the header", sep.join(row)
        else:
            cells = [row[i].strip() if i < len(row) else "" for i in at]
            yield [c or None for c in cells], index, None, None
        index += 1


def tolerant_tables(spark: SparkSession, paths: list[str] | str, wanted: dict[str, list[str]], encodings: tuple[str, ...] = ENCODINGS, file_path: bool = False) -> DataFrame:
    """(wanted columns.., source_file, row_index, encoding, error, raw) of CSV and TSV files, all cells as text, in one scan however many files there are.

    wanted: each column with the other names it may have, compared without case. A file is decoded by the
    first encoding that reads all of it, its separator follows its suffix (.tsv and .tab: a tab), a backslash escapes. row_index counts a file's
    records from 0. A record of more cells than the header, one that can't be parsed, a file without a wanted column and one that no
    encoding reads are rows with an error (the last two one row, without index); missing cells at a
    record's end and blank ones are null. source_file is a file's name, or with file_path its whole path. A file is read whole by one task (2 GB at most), by any file system that Spark reads.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    names = [*wanted, "source_file", "row_index", "encoding", "error", "raw"]
    kinds = [*[pa.string()] * len(wanted), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = _decoded(content.as_py(), encodings)
                name = path if file_path else path.rsplit("/", 1)[-1]
                rows: list[tuple] = []
                if got is None:
                    rows.append((*[None] * len(wanted), name, None, None, "no encoding reads the file", None))
                else:
                    sep = "\t" if name.lower().endswith((".tsv", ".tab")) else ","
                    for cells, index, error, raw in _lines(got[0], sep, wanted):
                        rows.append((*cells, name, index, got[1], error, raw))
                        if len(rows) == BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = ", ".join(f"`{n}` {'long' if k == pa.int64() else 'string'}" for n, k in zip(names, kinds, strict=True))
    return files.mapInArrow(scan, schema)


def good_rows(df: DataFrame) -> DataFrame:
    """The rows without an error."""
    return df.where(F.col("error").isNull()).drop("error", "raw")


def bad_lines(df: DataFrame) -> DataFrame:
    """(source_file, row_index, error, raw) of what couldn't be read."""
    return df.where(F.col("error").isNotNull()).select("source_file", "row_index", "error", "raw")
