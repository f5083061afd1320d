"""Vectors in .npz files: arrays dids, smiles (texts) and embeddings (float32), as a data source of Spark.

A table is a folder of .npz files, or one file. A task that writes puts its files below `_parts`; only the files that its commit
message names are moved into the folder, so a task that is lost or run twice adds nothing. A file is read in slices of
rows, each a task's: the arrays lie uncompressed, and a slice is read at its place. The folder has to be mounted by the
driver and all executors.

    spark.dataSource.register(NpzVectors)
    df.select("id", "text", "vector").write.format("npz").mode("append").save("/shared/vectors")
    spark.read.format("npz").load("/shared/vectors")
"""

from __future__ import annotations

import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Rows of a file that is written, and of a slice that is read.
FILE_ROWS, SLICE_ROWS = 50_000, 20_000
NAMES = ("dids", "smiles", "embeddings")


def local_path(options: dict) -> str:
    path = options["path"]
    if "://" in path and not path.startswith("file://"):
        raise ValueError("npz folders are read and written by mounted paths")
    return path.removeprefix("file://").removeprefix("file:")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class NpzWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.parts = os.path.join(path, f"_parts-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.parts, exist_ok=True)
        files: list[str] = []
        rows: list = []

        def flush() -> None:
            vectors = [r["vector"] for r in rows]
            if any(v is None for v in vectors) or len({len(v) for v in vectors}) > 1:
                raise ValueError("a file holds vectors of one length, and no null")
            name = f"part-{uuid.uuid4().hex}.npz"
            arrays = (np.array([r["id"] or "" for r in rows]), np.array([r["text"] or "" for r in rows]), np.array(vectors, np.float32))
            np.savez(os.path.join(self.parts, name), **dict(zip(NAMES, arrays, strict=True)))
            files.append(name)
            rows.clear()

        for row in iterator:
            rows.append(row)
            if len(rows) == FILE_ROWS:
                flush()
        if rows:
            flush()
        return Written(files)

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for name in os.listdir(self.path) if os.path.isdir(self.path) else ():
                if name.endswith(".npz"):
                    os.remove(os.path.join(self.path, name))
        for message in messages:
            for name in message.files if message else ():
                os.replace(os.path.join(self.parts, name), os.path.join(self.path, name))
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


@dataclass
class Slice(InputPartition):
    file: str
    start: int
    stop: int


def _open(archive: zipfile.ZipFile, name: str):
    """A member behind its header, and the header's shape and type."""
    member = archive.open(f"{name}.npy")
    version = np.lib.format.read_magic(member)
    shape, fortran, kind = np.lib.format.read_array_header_1_0(member) if version == (1, 0) else np.lib.format.read_array_header_2_0(member)
    if fortran or kind.hasobject:
        raise ValueError("an array of another order or kind")
    return member, shape, kind


class NpzReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Slice]:
        files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith(".npz"))
        out = []
        for file in files:
            with zipfile.ZipFile(file) as archive:
                rows = _open(archive, NAMES[0])[1][0]
            out += [Slice(file, lo, min(lo + SLICE_ROWS, rows)) for lo in range(0, rows, SLICE_ROWS)]
        return out or [Slice("", 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:
            return
        got = []
        with zipfile.ZipFile(partition.file) as archive:
            for name in NAMES:
                member, shape, kind = _open(archive, name)
                row = kind.itemsize * int(np.prod(shape[1:], dtype=np.int64))
                member.seek(partition.start * row, os.SEEK_CUR)
                n = partition.stop - partition.start
                got.append(np.frombuffer(member.read(n * row), kind).reshape(n, *shape[1:]))
        ids, texts, vectors = got
        flat = pa.array(vectors.astype(np.float32).ravel())
        offs = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(str).tolist()), pa.array(texts.astype(str).tolist()), pa.ListArray.from_arrays(offs, flat)], ["id", "text", "vector"])


class NpzVectors(DataSource):
    """(id, text, vector) of a folder of .npz files."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "id string, text string, vector array<float>"

    def reader(self, schema) -> NpzReader:
        return NpzReader(local_path(self.options))

    def writer(self, schema, overwrite: bool) -> NpzWriter:
        return NpzWriter(local_path(self.options), overwrite)
