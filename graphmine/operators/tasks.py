"""Evaluation tasks: pools, vectors, model runs, their results and bindings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphmine.operators import models, rank


def evaluation_pool(candidates: DataFrame, positives: DataFrame, vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, positive): candidates and positives, each id once, only those with a vector."""
    both = candidates.select(id_col, F.lit(False).alias("positive")).union(positives.select(id_col, F.lit(True).alias("positive")))
    known = vectors.where(F.col("vector").isNotNull()).select(id_col)
    return both.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("positive").alias("positive")).join(known, id_col, "left_semi")


def vector_lookup(rows: DataFrame, vectors: DataFrame, id_col: str, dim: int, policy: str = "zero") -> DataFrame:
    """Rows with their `vector`: a missing or ill-sized one becomes zeros (zero), or its row is left out (skip)."""
    sound = vectors.where(F.size("vector") == dim).select(id_col, "vector")
    if policy == "skip":
        return rows.join(sound, id_col)
    if policy != "zero":
        raise ValueError("the policy is zero or skip")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return rows.join(sound, id_col, "left").withColumn("vector", F.coalesce(F.col("vector"), zeros))


def task_results(rows: DataFrame, ranking: DataFrame, errors: DataFrame, id_col: str) -> DataFrame:
    """All task rows with rank and score where they were ranked, and the error's text where they weren't."""
    out = rows.join(ranking.select(id_col, "rank", "score"), id_col, "left").join(errors.select(id_col, F.col("error").alias("_e")), id_col, "left")
    told = F.when(F.col("rank").isNull(), F.coalesce(F.col("_e"), F.lit("not ranked")))
    return out.withColumn("error", told).drop("_e")


def evaluate_models(scores: DataFrame, positives: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (5, 10, 20, 50), negatives: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """(model_id, status, mrr, hit_k.., margin, selection_score, rank_among_models) of all expected models at once.

    scores: (model_id, context, id, score); positives, negatives, members: (context, id). The rows that a context
    was made of (members) are neither ranked nor asked for. The margin is the mean of the positives less that of the
    given negatives, null without any. A model without a finite score has the status failed and no measures, one
    without a held-out case partial; neither touches the others. Contexts made of all subsets of a task's positives
    are the work of `evaluation.evaluate_tasks`.
    """
    sound = scores.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")))
    ranked = sound if members is None else sound.join(members.select("context", "id").distinct(), ["context", "id"], "left_anti")
    asked = positives if members is None else positives.join(members.select("context", "id").distinct(), ["context", "id"], "left_anti")
    ranked = rank.rank_rows(ranked.withColumn("_g", F.to_json(F.struct("model_id", "context"))), "_g", "score", "id").drop("_g")
    # positives that a model doesn't rank come after all that it does
    size = ranked.groupBy("model_id", "context").agg(F.max("rank").alias("_n"))
    held = asked.join(size, "context").join(ranked.select("model_id", "context", "id", "rank"), ["model_id", "context", "id"], "left").withColumn("rank", F.coalesce("rank", F.col("_n") + 1))
    each = held.groupBy("model_id", "context").agg(F.avg(1.0 / F.col("rank")).alias("mrr"), *[F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in ks])
    means = each.groupBy("model_id").agg(F.avg("mrr").alias("mrr"), *[F.avg(f"hit_{k}").alias(f"hit_{k}") for k in ks])
    marked = sound.join(positives.select("context", "id").distinct().withColumn("_p", F.lit(True)), ["context", "id"], "left")
    if negatives is None:
        marked = marked.withColumn("_q", F.lit(False))
    else:
        marked = marked.join(negatives.select("context", "id").distinct().withColumn("_q", F.lit(True)), ["context", "id"], "left")
    spread = rank.margins(marked, "model_id", "score", "_p", "_q").select("model_id", "margin")
    out = expected.select("model_id").distinct().join(means, "model_id", "left").join(spread.withColumn("_scored", F.lit(True)), "model_id", "left")
    status = F.when(F.col("_scored").isNull(), "failed").when(F.col("mrr").isNull(), "partial").otherwise("ok")
    return rank.select_models(out.withColumn("status", status).drop("_scored"))


def evaluate_encoders(contexts: DataFrame, candidates: DataFrame, positives: DataFrame, encoders: dict[str, models.Encoder], dim: int, ks: tuple[int, ...] = (5, 10, 20, 50), negatives: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """evaluate_models on the scores of frozen encoders."""
    spark = contexts.sparkSession
    expected = spark.createDataFrame([(m,) for m in encoders], "model_id string")
    return evaluate_models(models.score_candidates(contexts, candidates, encoders, dim), positives, expected, ks, negatives, members)


def complete_records(records: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(records with exactly n candidates, one positive among them; one row: kept and dropped)."""
    size = F.lit(1) + F.size("nl") + F.size("ul")
    return records.where(size == n), records.agg(F.count_if(size == n).alias("kept"), F.count_if(size != n).alias("dropped"))


def bound_runs(bindings: DataFrame, runs: DataFrame, version: str) -> DataFrame:
    """All bindings of one dictionary version with their runs."""
    return bindings.where(F.col("version") == version).join(runs, ["project", "run"], "left")


def unbound_runs(runs: DataFrame, bindings: DataFrame) -> DataFrame:
    """All runs with the version that they are bound to, null if none."""
    return runs.join(bindings.select("project", "run", "version"), ["project", "run"], "left")


def resolve_reference(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Add `reference`: the id of the known row with the same keys, else the keys joined by _."""
    return rows.join(known.select(*keys, F.col("id").alias("_id")), keys, "left").withColumn("reference", F.coalesce(F.col("_id").cast("string"), F.concat_ws("_", *[F.col(k).cast("string") for k in keys]))).drop("_id")


def missing_artifacts(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows that aren't there."""
    return expected.join(present.select(*keys), keys, "left_anti")


def stale_files(files: DataFrame, bindings: DataFrame, results: DataFrame) -> DataFrame:
    """(run, path, kind): what depends on a binding whose checksum has changed.

    files: (run, path, source), results: (run, path), bindings: (run, source, checksum, current). A file is stale
    if its source changed in its run, a result if any source of its run did.
    """
    changed = bindings.where(~F.col("checksum").eqNullSafe(F.col("current"))).select("run", "source").distinct()
    down = files.join(changed, ["run", "source"], "left_semi").select("run", "path", F.lit("file").alias("kind"))
    told = results.join(changed.select("run").distinct(), "run", "left_semi").select("run", "path", F.lit("result").alias("kind"))
    return down.union(told).distinct()


def pool_report(labelled: DataFrame, sampled: DataFrame) -> DataFrame:
    """Per (target, hub): sizes of the whole pools and their ratio, and minimum, median, mean and outer deciles of the sampled distances.

    labelled, sampled: (target, hub, label, distance). A pool without rows has null measures.
    """
    is_known = F.col("label") == "KL"
    whole = labelled.groupBy("target", "hub").agg(F.count_if(is_known).alias("n_known"), F.count_if(~is_known).alias("n_other"))

    def measures(label: Column, name: str) -> list[Column]:
        d = F.when(label, F.col("distance"))
        q = F.percentile(d, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
        return [F.count(d).alias(f"{name}_n"), F.min(d).alias(f"{name}_min"), F.avg(d).alias(f"{name}_mean"), q[0].alias(f"{name}_q10"), q[1].alias(f"{name}_median"), q[2].alias(f"{name}_q90")]

    some = sampled.groupBy("target", "hub").agg(*measures(is_known, "known"), *measures(~is_known, "other"))
    ratio = F.when(F.col("n_other") > 0, F.col("n_known") / F.col("n_other"))
    return whole.withColumn("ratio", ratio).join(some, ["target", "hub"], "left")


def last_and_best(history: DataFrame, run: str, epoch: str, value: str) -> DataFrame:
    """(run, last, best, best_epoch): the value of the last epoch, and the highest one with its first epoch."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(epoch)).alias("e")))
    rows = history.groupBy(run).agg(F.max_by(value, epoch).alias("last"), best.alias("b"))
    return rows.select(run, "last", F.col("b.v").alias("best"), (-F.col("b.e")).alias("best_epoch"))


def only_where(df: DataFrame, **given) -> DataFrame:
    """Registry listings: rows that equal each given value that isn't None."""
    return reduce(lambda out, kv: out.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in given.items() if v is not None), df)


def farthest_first(df: DataFrame, group: list[str], distance: str, id_col: str) -> DataFrame:
    """Add `place` from 1 by distance descending, then id, in each group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(distance), id_col)))


def dataset_stats(df: DataFrame) -> DataFrame:
    """(column, position, rows, filled, different): a line for each column of a table."""
    stats = df.agg(F.count("*").alias("rows"), *[F.struct(F.count(f"`{c}`").alias("filled"), F.count_distinct(f"`{c}`").alias("different")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    lines = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.col("rows"), F.col(f"c{i}.filled").alias("filled"), F.col(f"c{i}.different").alias("different")) for i, c in enumerate(df.columns)])
    return stats.select(F.explode(lines).alias("l")).select("l.*")


def text_lookup(ids: DataFrame, texts: DataFrame, id_col: str) -> DataFrame:
    """The rows of a list of ids (with its further columns) that have a text row; missing ids are dropped, repeated lines count once."""
    return texts.join(ids.distinct(), id_col)
