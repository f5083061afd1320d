"""Sources and sinks: tolerant text tables, indexes, bundles, manifests, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmine.functions import blank_to_null, strip_layer
from graphmine.sources.text_tables import ENCODINGS, bad_lines, good_rows, tolerant_tables


def resolve(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Columns under their standard names, each the first alias present in any case; else the columns in order."""
    have = {c.lower().strip().lstrip("﻿"): c for c in df.columns}
    picked = []
    for i, (name, aliases) in enumerate(wanted.items()):
        hit = next((have[a.lower()] for a in [name, *aliases] if a.lower() in have), None)
        if hit is None:
            if i >= len(df.columns):
                raise ValueError(f"no column for {name}")
            hit = df.columns[i]
        picked.append(F.col(f"`{hit}`").alias(name))
    return df.select(*picked)


def source_rows(spark: SparkSession, paths: list[str], key: str = "cid", text: str = "isosmiles", limit: int | None = None) -> DataFrame:
    """Rows of CSV files as text: key, text, source_file, row_index, in one scan of all files.

    Headers are trimmed and freed of a byte order mark; a file without both columns is skipped
    whole, as are lines that can't be read (`text_tables.bad_lines` reports both); blank texts are dropped; a missing key becomes unknown_{row_index}.
    """
    rows = good_rows(tolerant_tables(spark, paths, {key: [], text: []}))
    rows = named_rows(rows, key, text, "row_index").select(key, text, "source_file", "row_index")
    return rows if limit is None else rows.orderBy("source_file", "row_index").limit(limit)


def named_rows(df: DataFrame, key: str, text: str, index: str) -> DataFrame:
    """Rows with a text; a missing key becomes unknown_{index}."""
    return df.withColumn(text, blank_to_null(F.col(text))).where(F.col(text).isNotNull()).withColumn(key, F.coalesce(blank_to_null(F.col(key)), F.concat(F.lit("unknown_"), F.col(index))))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank trimmed lines of a text file."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def delimited(spark: SparkSession, path: str, wanted: dict[str, list[str]], encodings: tuple[str, ...] = ENCODINGS) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of CSV or TSV files by their suffix, encodings tried in order."""
    df = tolerant_tables(spark, path, wanted, encodings)
    return good_rows(df), bad_lines(df)


def first_filled(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """Add a column with the first value of some columns that isn't blank; columns that the table lacks are passed over."""
    have = [blank_to_null(F.col(c)) for c in columns if c in df.columns]
    return df.withColumn(name, F.coalesce(*have) if have else F.lit(None).cast("string"))


def hub_items(spark: SparkSession, path: str) -> DataFrame:
    """(hub, item) from a CSV with those columns, or a JSON object hub: [items]; ids without layer prefix."""
    if path.endswith(".json"):
        df = spark.read.json(path, multiLine=True)
        pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(f"`{c}`") for c in df.columns]))
        out = df.select(F.explode(pairs).alias("hub", "items")).select("hub", F.explode("items").alias("item"))
    else:
        out = resolve(spark.read.csv(path, header=True), {"hub": ["metal_symbol", "metal"], "item": ["ligand_did", "did"]})
    return out.select("hub", strip_layer(F.col("item")).alias("item")).distinct()


def hub_vectors(df: DataFrame, key: str) -> DataFrame:
    """(key, vector): all other columns as floats, what isn't a number as 0."""
    others = [c for c in df.columns if c != key]
    return df.select(key, F.array(*[F.coalesce(F.col(f"`{c}`").cast("string").try_cast("float"), F.lit(0.0).cast("float")) for c in others]).alias("vector"))


def model_runs(df: DataFrame) -> DataFrame:
    """Model list: rows with a root; a missing id becomes the root's last part."""
    root = blank_to_null(F.col("model_run_root"))
    return df.where(root.isNotNull()).withColumn("model_id", F.coalesce(blank_to_null(F.col("model_id")), F.element_at(F.split(F.rtrim(root, F.lit("/")), "/"), -1)))


def bundle_rows(df: DataFrame, id_col: str) -> DataFrame:
    """Task rows with an `ordinal`: those without text and id are dropped, a missing row id becomes the ordinal."""
    kept = df.where(blank_to_null(F.col("smiles")).isNotNull() | blank_to_null(F.col("did")).isNotNull())
    return kept.withColumn(id_col, F.coalesce(blank_to_null(F.col(id_col)), F.col("ordinal").cast("string")))


def manifests(spark: SparkSession, glob: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """JSON documents that hold a step_id, with their path; others and broken ones are left out."""
    df = spark.read.option("wholetext", True).text(glob).select(F.col("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"))
    step = F.get_json_object("value", "$.step_id")
    return df.where(~F.col("name").isin(*skip) if skip else F.lit(True)).where(step.isNotNull()).select("path", step.alias("step_id"), F.get_json_object("value", "$.status").alias("status"), "value")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and sha256 of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def preview(read, n: int = 100) -> tuple[DataFrame | None, str | None]:
    """(first n rows, None), or (None, what went wrong)."""
    try:
        df = read().limit(n)
        df.schema  # noqa: B018  resolves the path
        return df, None
    except Exception as e:  # a missing file is an answer here
        return None, str(e).split("\n")[0]


def write_sorted(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet in range partitions by the keys, sorted within: a global order without one task."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def index_lists(edges: DataFrame, key: str, value: str) -> DataFrame:
    """key and its sorted distinct values."""
    return edges.select(key, value).distinct().groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("members"))
