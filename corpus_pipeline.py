"""The corpus pipeline: toxic documents go, near copies go, repeated passages and secrets are cut, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of
documents; where a stage changes a text, n_chars follows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmine.llm import ngram_join, packing, secrets, shared, suffix_dedup, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Rows of an Arrow batch between Spark and Python, in all stages: whole texts stand in a task's batches several times.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch from Spark to Python; the next row of more bytes ends a batch.
BATCH_BYTES = 4 << 20


def small_batches(stage):
    """The stage with Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes in its session."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))
        key = "spark.sql.execution.arrow.maxBytesPerBatch"
        if not (size := spark.conf.get(key)).isdigit() or int(size) > BATCH_BYTES:
            spark.conf.set(key, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents with a toxicity score below 0.5, trained on the given labels.

    Each row is judged by its text alone, whatever its id; a null or empty text is scored like one
    without any word. Further columns stay; an empty table gives an empty one.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, out_col="_toxicity").where("_toxicity < 0.5").drop("_toxicity")


@small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of near copies, one with the smallest id there.

    Rows are told apart by id and text: of rows equal in both one stays, and another text under the
    same id is judged by itself. Rows without words stay, null ids come last in the choice.
    """
    return ngram_join.keep_one_each(docs)


@small_batches
def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut all but the first occurrence of passages of 50 words or more; no row goes.

    Nulls and short texts stay as they are; equal rows count as one place and stay alike. n_chars
    follows the text.
    """
    out = suffix_dedup.remove_passages(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


@small_batches
def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; no row goes, each is treated by its text alone, a null text stays null. n_chars follows the text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


@small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into training sequences of at most 1024 tokens.

    Every row is a document of its own, also under a repeated or null id; a null or empty text is its end token.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("n_loss")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_passages),
    ("secret_scans", cut_secrets),
    ("packing", pack),
]

#: Trained models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents in sf_dir; a stage's own tables go when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    before = shared.saved()
    for name, stage in STAGES:
        docs = shared.save(stage(spark, docs, sf_dir), f"stage-{name}")
        shared.drop_saved(spark, before, docs)
    return docs
