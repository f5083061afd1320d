"""Ranking, held-out metrics, model selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphmine.sources.tables import save_table


def numbered(df: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """Add the rows' numbers from 0 in the order of some columns over the whole table.

    The table is dealt to ranges of that order, ties of the first columns going by the next ones; rows
    are numbered in their range, and the ranges' sizes give the starts, so no task sorts more than a range.
    """
    marked = save_table(df.repartitionByRange(*order).withColumn("_rank_p", F.spark_partition_id()), "ranges")
    sizes = marked.groupBy("_rank_p").agg(F.count("*").alias("_rank_n"))
    # a row for each range
    starts = sizes.alias("a").join(sizes.alias("b"), F.col("b._rank_p") < F.col("a._rank_p"), "left").groupBy("a._rank_p").agg(F.coalesce(F.sum("b._rank_n"), F.lit(0)).alias("_rank_s"))
    placed = marked.withColumn("_rank_k", F.row_number().over(Window.partitionBy("_rank_p").orderBy(*order)))
    return placed.join(F.broadcast(starts), "_rank_p").withColumn(name, F.col("_rank_s") + F.col("_rank_k") - 1).drop("_rank_p", "_rank_k", "_rank_s")


def rank_rows(df: DataFrame, group: str, score: str, id_col: str) -> DataFrame:
    """Add rank (long) from 1 by score descending, nulls last, ties by id; a null group is a group like others.

    The table is dealt to ranges of (group, score, id) and a group's rows are ranked within each range; the
    rows that a group has in the ranges before give the starts. So no task sorts a whole group, however
    large, nor all rows of one score.
    """
    order = (F.desc_nulls_last(score), F.asc(id_col))
    marked = save_table(df.repartitionByRange(F.asc_nulls_first(group), *order).withColumn("_rank_p", F.spark_partition_id()), "ranges")
    counts = marked.groupBy(F.col(group).alias("_rank_g"), F.col("_rank_p").alias("_rank_q")).agg(F.count("*").alias("_rank_n"))
    ahead = Window.partitionBy("_rank_g").orderBy("_rank_q").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_rank_s", F.coalesce(F.sum("_rank_n").over(ahead), F.lit(0))).drop("_rank_n")  # a row for each range at most in a group
    placed = marked.withColumn("_rank_k", F.row_number().over(Window.partitionBy(group, "_rank_p").orderBy(*order)))
    met = placed.join(starts, F.col(group).eqNullSafe(F.col("_rank_g")) & (F.col("_rank_p") == F.col("_rank_q")))
    return met.withColumn("rank", F.col("_rank_s") + F.col("_rank_k")).drop("_rank_p", "_rank_k", "_rank_g", "_rank_q", "_rank_s")


def ranking_metrics(ranked: DataFrame, is_true: str) -> DataFrame:
    """recall@1, recall@5 and MRR over the true rows."""
    return ranked.where(is_true).agg(F.count("*").alias("n"), F.avg(F.when(F.col("rank") <= 1, 1.0).otherwise(0.0)).alias("recall_1"), F.avg(F.when(F.col("rank") <= 5, 1.0).otherwise(0.0)).alias("recall_5"), F.avg(1.0 / F.col("rank")).alias("mrr"))


def heldout_metrics(ranked: DataFrame, context: str, held: DataFrame, ks: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    """Mean over contexts of the mean over held-out rows of 1/rank and of rank <= k; an absent one ranks after all others."""
    size = ranked.groupBy(context).agg(F.max("rank").alias("n"))
    rows = held.join(ranked.select(context, "id", "rank"), [context, "id"], "left").join(size, context, "left").withColumn("rank", F.coalesce("rank", F.coalesce("n", F.lit(0)) + 1))
    each = rows.groupBy(context).agg(F.avg(1.0 / F.col("rank")).alias("mrr"), *[F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in ks])
    return each.agg(F.count("*").alias("contexts"), F.avg("mrr").alias("mrr"), *[F.avg(f"hit_{k}").alias(f"hit_{k}") for k in ks])


def margins(df: DataFrame, group: str, score: str, positive: str, negative: str) -> DataFrame:
    """Means of positives and negatives and their difference; null where a side is empty."""
    p, n = F.avg(F.when(F.col(positive), F.col(score))), F.avg(F.when(F.col(negative), F.col(score)))
    return df.groupBy(group).agg(p.alias("positive_mean"), n.alias("negative_mean"), (p - n).alias("margin"))


def select_models(df: DataFrame, *group: str) -> DataFrame:
    """Rank (model_id, mrr, margin) by mrr, else margin, in each group if given; models with neither stay with a null rank."""
    scored = df.withColumn("selection_score", F.coalesce("mrr", "margin"))
    order = Window.partitionBy(*group, F.col("selection_score").isNull()).orderBy(F.desc("selection_score"), "model_id")
    return scored.withColumn("rank_among_models", F.when(F.col("selection_score").isNotNull(), F.row_number().over(order)))


def subsets(df: DataFrame, group: str, id_col: str, most: int = 12) -> DataFrame:
    """(group, subset, id): all proper non-empty subsets of each group's ids; a group of over `most` is an error."""
    lists = df.groupBy(group).agg(F.sort_array(F.collect_set(id_col)).alias("ids"), F.count("*").alias("n"))
    lists = lists.withColumn("ids", F.when(F.size("ids") <= most, F.col("ids")).otherwise(F.raise_error(F.lit(f"more than {most} ids in a group"))))
    masks = lists.where(F.size("ids") > 1).withColumn("subset", F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("ids")) - 2).cast("int"))))
    return masks.select(group, "subset", F.posexplode("ids").alias("bit", id_col)).where(F.expr("(subset & shiftleft(1, bit)) <> 0")).select(group, "subset", id_col)
