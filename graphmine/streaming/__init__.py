"""Incremental upkeep of a registry table from a stream of new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmine.operators.registry import upsert_latest


def upsert_stream(stream: DataFrame, path: str, keys: list[str], order_col: str, checkpoint: str):
    """Start a query that keeps the latest row of each key in parquet folders path/v{batch}; a replayed batch writes the same folder again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = upsert_latest(spark.read.parquet(f"{path}/v{number - 1}"), batch, keys, [F.desc(order_col)])
        else:
            rows = upsert_latest(batch.limit(0), batch, keys, [F.desc(order_col)])
        rows.write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
