"""Task bundles, workspaces, statistics files, graph and vector files."""

from __future__ import annotations

import base64
import io
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from graphmine.functions import run_of_path
from graphmine.sources.tables import save_table


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Add the rows' numbers from 1 in the order of file and place, without gathering them in one task.

    Rows are numbered within their partition; the partitions' sizes, one small row each, give the starts.
    """
    marked = save_table(df.withColumn("_m", F.monotonically_increasing_id()), "ordinal")
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = marked.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    # as many rows as partitions: each meets those before it
    starts = sizes.alias("a").join(sizes.alias("b"), F.col("b._p") < F.col("a._p"), "left").groupBy("a._p").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_s"))
    return marked.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + place + 1).drop("_m", "_p", "_s")


@dataclass
class TaskBundle:
    """spec: task_id, hub, embedding, notes and the text of task.json; candidates, positives, negatives: (row_id, smiles, did, name, source)."""

    spec: dict[str, str]
    candidates: DataFrame
    positives: DataFrame
    negatives: DataFrame


_TASK_ROWS = "row_id string, smiles string, did string, name string, source string"


def _exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where)


def _task_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    have = {c.strip().lstrip("\ufeff").lower(): c for c in raw.columns}

    def cell(name: str) -> Column:
        return blank(F.col(f"`{have[name]}`")) if name in have else F.lit(None).cast("string")

    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    numbered = with_ordinal(raw, "_number").withColumn("_number", (F.col("_number") - 1).cast("string"))
    row_id = F.coalesce(cell(f"{kind}_id"), cell("id"), F.col("_number"))
    rows = numbered.select(row_id.alias("row_id"), *[cell(c).alias(c) for c in ("smiles", "did", "name", "source")])
    return rows.where("smiles is not null or did is not null")


def load_task_bundle(spark: SparkSession, folder: str, embeddings: tuple[str, ...] = ("ecfp",)) -> TaskBundle:
    """A task folder: task.json, and the files it names (candidate_file, positive_file, negative_file; by default candidates.csv, positives.csv, negatives.csv).

    Columns are found by name in any case: candidate_id, positive_id or negative_id (or id), smiles, did, name, source. A missing row id becomes
    the row's number from 0, dropped rows counted; rows with neither smiles nor did are dropped. The task id is the folder's name if the document has none. A missing document, candidate or
    positive file, a document without metal or with an unknown embedding, and files without a row are errors; negatives may be absent.
    """
    if not _exists(spark, f"{folder}/task.json"):
        raise FileNotFoundError(f"{folder}/task.json")
    text = spark.read.text(f"{folder}/task.json", wholetext=True).first()["value"]  # one small document
    got = spark.createDataFrame([(text,)], "value string").select(*[F.get_json_object("value", f"$.{k}").alias(k) for k in ("task_id", "metal", "embedding", "candidate_file", "positive_file", "negative_file", "notes")]).first().asDict()
    spec = {"task_id": got["task_id"] or folder.rstrip("/").rsplit("/", 1)[-1], "hub": (got["metal"] or "").strip(), "embedding": (got["embedding"] or embeddings[0]).strip().lower(), "notes": got["notes"] or "", "document": text}
    if not spec["hub"]:
        raise ValueError("task.json names no metal")
    if spec["embedding"] not in embeddings:
        raise ValueError(f"unknown embedding {spec['embedding']}")
    tables = {}
    for kind in ("candidate", "positive", "negative"):
        path = f"{folder}/{got[f'{kind}_file'] or f'{kind}s.csv'}"
        if _exists(spark, path):
            tables[kind] = _task_rows(spark, path, kind)
        elif kind == "negative":
            tables[kind] = spark.createDataFrame([], _TASK_ROWS)
        else:
            raise FileNotFoundError(path)
        if kind != "negative" and tables[kind].isEmpty():
            raise ValueError(f"{path} has no row with smiles or did")
    return TaskBundle(spec, tables["candidate"], tables["positive"], tables["negative"])


def rebuild_registry(spark: SparkSession, root: str, glob: str = "*.json") -> dict[str, DataFrame]:
    """Tables projects, runs, artifacts and errors from the JSON files below a workspace folder.

    A broken file becomes a row of errors and stops nothing; a rebuild on the same files gives the same rows.
    """
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    project, run = run_of_path(F.col("path"))
    files = raw.select(F.col("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).withColumn("project", project).withColumn("run", run)
    parsed = save_table(files.withColumn("step_id", F.get_json_object("value", "$.step_id")).withColumn("status", F.get_json_object("value", "$.status")).withColumn("ok", F.get_json_object("value", "$").isNotNull()), "workspace")
    good = parsed.where("ok")
    return {
        "projects": good.where("project <> ''").select("project").distinct(),
        "runs": good.where("run <> ''").groupBy("project", "run").agg(F.count("*").alias("files"), F.count_if(F.col("status") == "failed").alias("failed")),
        "artifacts": good.select("path", "project", "run", "step_id", "status", "bytes"),
        "errors": parsed.where("not ok").select("path", F.lit("not JSON").alias("error")),
    }


def row_counts(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(name, rows): the records of each CSV file of a folder; blank lines are none, and a quoted cell may hold line breaks; a file of no bytes has no row."""
    rows = spark.read.csv(path, header=False, multiLine=True, schema="_c string", mode="PERMISSIVE", escape='"').select(F.col("_metadata.file_name").alias("name"))
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"))
    counts = rows.groupBy("name").agg(F.count("*").alias("n"))
    return files.join(counts, "name", "left").select("name", F.greatest(F.coalesce("n", F.lit(0)) - (1 if header else 0), F.lit(0)).cast("long").alias("rows"))


def counted(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that holds the counters once an action has read them."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), *[c.alias(k) for k, c in counters.items()]), seen


def step_counters(df: DataFrame, step: str, **counters: Column) -> DataFrame:
    """One row (step, rows, counters..) of a table."""
    return df.agg(F.count("*").alias("rows"), *[c.alias(k) for k, c in counters.items()]).select(F.lit(step).alias("step"), "*")


def merge_stats(parts: list[DataFrame], key: str = "step") -> DataFrame:
    """Statistics of several steps in one table: a line for each step, null for what a step doesn't count."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.groupBy(key).agg(*[F.max(c).alias(c) for c in out.columns if c != key])


def write_parts(df: DataFrame, parts: dict[str, Column], folder: str) -> None:
    """Several outputs of one plan, each the rows of a condition: the plan runs once, its rows are read again for each."""
    base = save_table(df, "parts")
    for name, condition in parts.items():
        base.where(condition).write.mode("overwrite").parquet(f"{folder}/{name}")


def precomputed_or(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path if it is there, else the built one."""
    return spark.read.parquet(path) if _exists(spark, path) else build()


def node_rows(df: DataFrame, id_col: str, layer: str, **properties: str) -> DataFrame:
    """A node file: typed headers `id:ID(layer)`, `name:type`."""
    return df.select(F.col(id_col).cast("string").alias(f"id:ID({layer})"), *[F.col(name).alias(f"{name}:{kind}") for name, kind in properties.items()]).distinct()


def edge_rows(df: DataFrame, start: str, start_layer: str, end: str, end_layer: str, kind: str) -> DataFrame:
    """An edge file: typed headers of both ends, and the edge's type; each edge once."""
    return df.select(F.col(start).cast("string").alias(f":START_ID({start_layer})"), F.col(end).cast("string").alias(f":END_ID({end_layer})"), F.lit(kind).alias(":TYPE")).distinct()


def write_graph(nodes: dict[str, DataFrame], edges: dict[str, DataFrame], folder: str) -> None:
    """A CSV folder for each node and edge file, with headers."""
    for name, df in {**{f"nodes_{k}": v for k, v in nodes.items()}, **{f"edges_{k}": v for k, v in edges.items()}}.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def pack_vectors(df: DataFrame, vec: str = "vector", out: str = "npy") -> DataFrame:
    """Add the vectors as base64 text of a float32 .npy file."""

    def run(batches):
        for pdf in batches:
            texts = []
            for v in pdf[vec]:
                buffer = io.BytesIO()
                if v is not None:
                    np.save(buffer, np.asarray(v, np.float32))
                texts.append(base64.b64encode(buffer.getvalue()).decode() if v is not None else None)
            pdf[out] = texts
            yield pdf

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` string")


def unpack_vectors(df: DataFrame, npy: str = "npy", out: str = "vector") -> DataFrame:
    """Add the vectors of base64 .npy texts as array<float>; null for null and for what isn't such a file."""

    def one(text):
        try:
            return np.load(io.BytesIO(base64.b64decode(text)), allow_pickle=False).astype(np.float32).ravel().tolist()
        except (ValueError, TypeError, EOFError, OSError):
            return None

    def run(batches):
        for pdf in batches:
            pdf[out] = pd.Series([one(t) for t in pdf[npy]], dtype=object, index=pdf.index)
            yield pdf

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out) + f", `{out}` array<float>")
