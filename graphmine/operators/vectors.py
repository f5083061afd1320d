"""Vectors: fingerprints, pooling, z-scores, nearest neighbours, votes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphmine.functions import content_id, cosine


def shingles(col: Column, n: int = 3) -> Column:
    """Distinct runs of n characters of a text; a shorter one is its own only run."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(col) - (n - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(col, i, F.lit(n))))


def fingerprints(df: DataFrame, text: str, bits: int = 2048) -> DataFrame:
    """(did, text, bits, ones) of the distinct texts: sorted set bits of a fixed-width hash of shingles."""
    rows = df.select(F.col(text).alias("text")).where("text is not null").distinct()
    bit = F.transform(shingles(F.col("text")), lambda s: (F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") % bits).cast("int"))
    return rows.select(content_id(F.col("text")).alias("did"), "text", F.array_sort(F.array_distinct(bit)).alias("bits")).withColumn("ones", F.size("bits"))


def packed_bits(bits: Column, width: int = 2048) -> Column:
    """Sorted set bits as base64 text of their packed bytes, the first bit the highest of its byte."""
    byte = lambda i: F.aggregate(F.filter(bits, lambda b: F.floor(b / 8) == i), F.lit(0).cast("long"), lambda s, b: s + F.element_at(F.array(*[F.lit(1 << (7 - k)).cast("long") for k in range(8)]), (b % 8 + 1).cast("int")))
    text = F.base64(F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width // 8 - 1)), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "")))
    return F.regexp_replace(text, "\\s", "")  # base64 breaks its lines


def embed_report(df: DataFrame, id_col: str, text: str, fn, dim: int) -> DataFrame:
    """(id, vector, error) of every row, by a batched function from a list of texts to a list of vectors or None.

    The error tells why a row has no vector: no text, none returned, another length than dim, or what the function raised. A
    batch that raises is tried text by text, so that one bad text costs no other.
    """

    def one(x: str):
        try:
            return fn([x])[0], None
        except Exception as e:  # a plug-in's failure is a row of the report
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            some = [i for i, t in enumerate(texts) if t is not None]
            try:
                got = [(v, None) for v in fn([texts[i] for i in some])] if some else []
            except Exception:
                got = [one(texts[i]) for i in some]
            vectors, errors = [None] * len(texts), ["no text"] * len(texts)
            for i, (v, error) in zip(some, got, strict=True):
                sound = v is not None and len(v) == dim
                vectors[i] = list(map(float, v)) if sound else None
                errors[i] = None if sound else error or ("no vector" if v is None else f"{len(v)} numbers")
            yield pd.DataFrame({"id": pdf["id"], "vector": vectors, "error": errors})

    return df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInPandas(run, f"id {df.schema[id_col].dataType.simpleString()}, vector array<float>, error string")


def embed_items(df: DataFrame, id_col: str, text: str, fn, dim: int) -> DataFrame:
    """(id, vector) of the rows that `embed_report` has without an error."""
    return embed_report(df, id_col, text, fn, dim).where("error is null").select("id", "vector")


def mean_pool(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, position, mean) of the vectors of each key."""
    return df.select(key, F.posexplode(vec).alias("position", "v")).groupBy(key, "position").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def zscores(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Columns less their mean over their sample deviation; 0 where that is 0, null, or the cell is null."""
    stats = df.agg(*[F.avg(c).alias(f"{c}_m") for c in cols], *[F.stddev_samp(c).alias(f"{c}_s") for c in cols])
    z = [F.when(F.coalesce(F.col(f"{c}_s"), F.lit(0.0)) == 0, 0.0).otherwise(F.coalesce((F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s"), F.lit(0.0))).alias(c) for c in cols]
    return df.crossJoin(stats).select(key, *z)  # one row of statistics


#: Contexts that are broadcast at most.
MOST_CONTEXTS = 1000


def score_contexts(df: DataFrame, pools: DataFrame, key: str, vec: str) -> DataFrame:
    """(context, score and the rows' columns): the cosine of each row with each pooled context, of which there are at most MOST_CONTEXTS."""
    ctx = pools.groupBy(F.col(key).alias("context")).agg(F.sort_array(F.collect_list(F.struct("position", "mean"))).alias("p")).select("context", F.transform("p", lambda x: x["mean"]).alias("_cv"))
    if (n := ctx.limit(MOST_CONTEXTS + 1).count()) > MOST_CONTEXTS:
        raise ValueError(f"{n} contexts or more: score them {MOST_CONTEXTS} at a time")
    return df.crossJoin(F.broadcast(ctx)).withColumn("score", cosine(F.col(vec), F.col("_cv"))).drop("_cv")


def nearest_to_pools(df: DataFrame, pools: DataFrame, key: str, id_col: str, vec: str, k: int) -> DataFrame:
    """For each pooled context its k most similar rows: (context, id, score, rank)."""
    scored = score_contexts(df, pools, key, vec).select("context", F.col(id_col).alias("id"), "score")
    order = Window.partitionBy("context").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scaled_votes(votes: DataFrame, hub: str, value: str) -> DataFrame:
    """Summed votes of each hub scaled to 0..1 (all equal: 1), rounded to 4 digits."""
    total = votes.groupBy(hub).agg(F.sum(value).alias("vote"))
    ends = total.agg(F.min("vote").alias("lo"), F.max("vote").alias("hi"))
    return total.crossJoin(ends).select(hub, F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.round((F.col("vote") - F.col("lo")) / (F.col("hi") - F.col("lo")), 4)).alias("affinity"))
