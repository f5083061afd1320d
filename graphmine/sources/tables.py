"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables written by save_table() and still there, oldest first.
_saved: list[str] = []


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="graphmine-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def save_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table below spark.checkpoint.dir and read it again: its lineage ends there, and its size is known to later plans.

    Where the setting is unset, a temporary folder serves in local mode, as in tests; elsewhere that is an
    error. Results that are still to be read may need the table, so it stays until `drop_tables` or the end
    of a `temporary_tables` block.
    """
    path = f"{_folder(df.sparkSession)}/graphmine-{name}-{uuid.uuid4().hex}"
    _saved.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """The number of tables so far, for drop_tables."""
    return len(_saved)


def drop_tables(spark: SparkSession, since: int = 0, *keep: DataFrame) -> int:
    """Delete the tables saved after a mark, but for those that `keep` read; gives their number. Nothing else may still read them."""
    stay = {f.rsplit("/", 1)[0].split("graphmine-", 1)[1] for df in keep for f in df.inputFiles() if "graphmine-" in f}
    gone = [p for p in _saved[since:] if p.split("graphmine-", 1)[1] not in stay]
    _saved[since:] = [p for p in _saved[since:] if p not in gone]
    sc = spark.sparkContext
    for path in gone:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    return len(gone)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables saved within the block at its end; write or collect results inside it."""
    since = mark()
    try:
        yield
    finally:
        drop_tables(spark, since)
