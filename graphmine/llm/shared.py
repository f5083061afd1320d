"""Files that the driver and all executors see, and small bounded summaries."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a temporary one in local mode, as in tests; elsewhere an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="graphmine-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


#: Tables written by save() and still there, oldest first.
_saved: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/graphmine-{name}-{uuid.uuid4().hex}"
    _saved.append(path)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: its lineage ends there, and no executor's loss repeats the work before it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved() -> int:
    """A mark for drop_saved: the number of tables so far."""
    return len(_saved)


def drop_saved(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables saved after the mark, but for those that `keep` read. Call it only when nothing else reads them."""
    stay = {f.rsplit("/", 1)[0].split("graphmine-", 1)[1] for df in keep for f in df.inputFiles()}
    gone = [p for p in _saved[since:] if p.split("graphmine-", 1)[1] not in stay]
    _saved[since:] = [p for p in _saved[since:] if p not in gone]
    sc = spark.sparkContext
    for path in gone:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that save() has returned, and let go of the shuffle files of finished jobs. Call it only when nothing else reads them."""
    spark = tables[0].sparkSession
    sc = spark.sparkContext
    for df in tables:
        names = {f.rsplit("/", 1)[0].split("graphmine-", 1)[1] for f in df.inputFiles()}
        for path in [p for p in _saved if p.split("graphmine-", 1)[1] in names]:
            _saved.remove(path)
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    sweep(spark)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so when the driver has collected the plans that made them, which may else take long on an idle heap."""
    gc.collect()  # plans that Python still holds in cycles
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Give memory that a Python worker has freed back to the system; workers serve many stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


#: What modules keep in a Python worker from task to task, as dicts: each coder holds some 70 MB.
KEPT: list[dict] = []


def tidy(scan, keep: bool = False):
    """A function of batches that releases its memory at its end, and unless `keep` what other operators have left in its worker."""

    def run(batches):
        if not keep:
            for left in KEPT:
                left.clear()
        yield from scan(batches)
        release()

    return run


def released(table: pa.Table) -> pa.Table:
    """The result of a group, after the memory of the work on it is released."""
    release()
    return table


#: Bytes of packed arrays that go to Spark in one batch.
PIECE_BYTES = 2 << 20


def pieces(batch: pa.RecordBatch, size: int = PIECE_BYTES):
    """The rows of a batch in batches of about `size` bytes; a larger row is a batch alone."""
    step = max(1, batch.num_rows * size // max(1, batch.nbytes))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A summed table travels in so many slices, so that no task gathers more than one slice of each partition's table.
SLICES = 16


def slices_of(table: np.ndarray) -> list[bytes]:
    return [part.tobytes() for part in np.split(table, SLICES)]


def combine_slices(df: DataFrame, slice_col: str, blob_col: str, dtype: str, how: str, then=None) -> np.ndarray:
    """Element-wise sum ("sum", as int64) or OR ("or") of equally long tables of which each row holds one slice, and then(that) where given.

    The result has a fixed length that doesn't depend on the number of rows; it
    is the only thing that reaches the driver.
    """
    kind = np.dtype(dtype)
    out_kind = np.dtype(np.int64) if how == "sum" else kind
    out_kind = then(np.zeros(1, out_kind)).dtype if then else out_kind

    def merge(table: pa.Table) -> pa.Table:
        total = None
        for blob in table.column(1):
            part = np.frombuffer(blob.as_buffer(), kind)
            part = part.astype(np.int64) if how == "sum" else part
            total = part.copy() if total is None else (total + part if how == "sum" else total | part)
        total = then(total) if then else total
        return pa.table({"slice": table.column(0).slice(0, 1), "blob": pa.array([total.tobytes()], pa.binary())})

    rows = df.select(F.col(slice_col).alias("slice"), F.col(blob_col).alias("blob")).groupBy("slice").applyInArrow(merge, "slice int, blob binary").collect()
    return np.concatenate([np.frombuffer(r["blob"], out_kind) for r in sorted(rows, key=lambda r: r["slice"])]) if rows else np.zeros(0, out_kind)


class IdFilter:
    """A Bloom filter of long ids, broadcast with at most 32 MB; it may keep an id too many, never drops one."""

    def __init__(self, shared):
        self.shared = shared

    @staticmethod
    def _places(ids: np.ndarray, size: int) -> np.ndarray:
        from .textbuf import mix

        ids = ids.astype(np.int64).view(np.uint64)
        return np.concatenate([mix(ids + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size) for k in (1, 2, 3, 4)])

    @classmethod
    def of(cls, ids: DataFrame, column: str, count: int) -> IdFilter:
        size = 1 << min(28, max(16, int(16 * max(count, 1)).bit_length()))

        def build(batches):
            bits = np.zeros(size // 8, np.uint8)
            seen = False
            for batch in batches:
                got = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
                at = cls._places(got, size)
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
                seen = True
            if seen:
                yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "blob": pa.array(slices_of(bits), pa.binary())})

        bits = combine_slices(ids.select(column).mapInArrow(build, "slice int, blob binary"), "slice", "blob", "uint8", "or")
        return cls(ids.sparkSession.sparkContext.broadcast(bits if len(bits) else np.zeros(size // 8, np.uint8)))

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        bits = self.shared.value
        at = self._places(ids, 8 * len(bits))
        hit = bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
        return hit.reshape(4, -1).all(axis=0)
