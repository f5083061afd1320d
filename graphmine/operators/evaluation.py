"""Held-out evaluation of tasks: every subset of a task's positives is a context, and the positives left out are to be found among the pool."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmine.operators.models import Encoder
from graphmine.operators.rank import select_models
from graphmine.sources.tables import save_table

#: Positives of a task at most: a task has 2^n - 2 contexts.
MOST = 12
#: Pool rows that meet a task's contexts in one group, and contexts that are scored at once.
BLOCK, CHUNK = 20_000, 256
#: Digits that scores are rounded to before they are compared.
DIGITS = 9
CANDIDATE, POSITIVE, NEGATIVE = 1, 2, 4

Models = dict[str, Encoder | None]


def gray_contexts(vectors: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(subsets, means) of chunks of all proper non-empty subsets of at most `most` rows, as bit masks.

    In Gray-code order each subset differs from the one before by one row, which is added to a running sum or taken from it.
    """
    n, total, subset, size = len(vectors), np.zeros(vectors.shape[1]), 0, 0
    masks, means = [], []
    for i in range(1, 1 << n):
        bit = (i & -i).bit_length() - 1
        subset ^= 1 << bit
        sign = 1 if subset >> bit & 1 else -1
        total, size = total + sign * vectors[bit], size + sign
        if 0 < size < n and size <= most:
            masks.append(subset)
            means.append(total / size)
        if len(masks) == CHUNK:
            yield np.array(masks), np.array(means)
            masks, means = [], []
    if masks:
        yield np.array(masks), np.array(means)


def _better(pool: np.ndarray, pool_code: np.ndarray, held: np.ndarray, held_code: np.ndarray) -> np.ndarray:
    """For each held-out row and context the pool rows with a higher score, or the same score and a smaller id."""
    out = np.empty(held.shape, np.int64)
    for j in range(len(held)):
        out[j] = ((pool > held[j]) | ((pool == held[j]) & (pool_code < held_code[j])[:, None])).sum(axis=0)
    return out


def _grouped(candidates: DataFrame, positives: DataFrame, negatives: DataFrame | None, vectors: DataFrame, dim: int) -> DataFrame:
    """(task, block, id, role, marks, vector): a task's pool in blocks of about BLOCK rows, with all its positives in each block.

    role 0 is a row of the pool, 1 a positive that contexts are made of. A task of over MOST positives is an error.
    """
    sound = vectors.where((F.size("vector") == dim) & F.col("id").isNotNull()).select("id", F.col("vector").cast("array<double>").alias("vector"))
    sound = sound.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).groupBy("id").agg(F.min("vector").alias("vector"))
    marked = candidates.select("task", "id", F.lit(CANDIDATE).alias("mark")).union(positives.select("task", "id", F.lit(POSITIVE).alias("mark")))
    if negatives is not None:
        marked = marked.union(negatives.select("task", "id", F.lit(NEGATIVE).alias("mark")))
    pool = marked.where("task is not null and id is not null").groupBy("task", "id").agg(F.bit_or("mark").alias("marks"))
    pool = save_table(pool.where(F.col("marks") != NEGATIVE).join(sound, "id"), "pool")
    is_positive = F.col("marks").bitwiseAND(POSITIVE) > 0
    counts = pool.groupBy("task").agg(F.count_if(is_positive).alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("n > 0")
    n = F.when(F.col("n") <= MOST, F.col("blocks")).otherwise(F.raise_error(F.lit(f"a task has more than {MOST} positives")))
    counts = counts.select("task", n.alias("blocks"))  # one row for each task
    placed = pool.join(counts, "task").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("role", F.lit(0))
    everywhere = pool.where(is_positive).join(counts, "task").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("role", F.lit(1))
    cols = ("task", "block", "id", "role", "marks", "vector")
    return placed.select(*cols).union(everywhere.select(*cols))


def context_counts(candidates: DataFrame, positives: DataFrame, negatives: DataFrame | None, vectors: DataFrame, models: Models, dim: int, max_k: int | None = None) -> DataFrame:
    """(model_id, task, subset, size, held, better, p_sum, p_n, n_sum, n_n): what the blocks of each task's pool say of its contexts.

    subset is a bit mask over the task's positives in the order of their ids. For each held-out positive `better`
    is the number of a block's rows that come before it, the context's own positives left out: neither a
    row for a subset and a candidate nor a sort arises. Rows with a null held hold the sums of the scores of given positives
    and negatives among the candidates under the context of all positives. A model that can't
    encode a task's contexts gives no row for it.
    """
    grouped = _grouped(candidates, positives, negatives, vectors, dim)
    id_type, task_type = grouped.schema["id"].dataType.simpleString(), grouped.schema["task"].dataType.simpleString()
    arrow_id, schema = None, f"model_id string, task {task_type}, subset long, size int, held {id_type}, better long, p_sum double, p_n long, n_sum double, n_n long"

    def run(table: pa.Table) -> pa.Table:
        nonlocal arrow_id
        role = table.column("role").to_numpy()
        own, rest = table.filter(pa.array(role == 1)), table.filter(pa.array(role == 0))
        own = own.sort_by("id")
        arrow_id, task = table.schema.field("id").type, table.column("task")[0].as_py()

        def matrix(t: pa.Table) -> np.ndarray:
            return t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), dim)

        p, v = matrix(own), matrix(rest)
        codes = np.unique(np.array(own.column("id").to_pylist() + rest.column("id").to_pylist()), return_inverse=True)[1]
        p_code, v_code = codes[: len(p)], codes[len(p) :]
        marks = rest.column("marks").to_numpy()
        place = np.full(codes.max() + 1, -1)
        place[p_code] = np.arange(len(p))
        mine = place[v_code]  # the positive that a pool row is
        others, members = np.flatnonzero(mine < 0), np.flatnonzero(mine >= 0)
        out: list[tuple] = []
        held_ids = own.column("id").to_pylist()
        for name, encoder in models.items():
            try:
                whole = p.mean(axis=0, keepdims=True)
                scores = (v @ (encoder(whole) if encoder else whole).T)[:, 0]
                if not np.isfinite(scores).all():
                    continue
                good, bad = (marks & CANDIDATE > 0) & (marks & POSITIVE > 0), (marks & CANDIDATE > 0) & (marks & NEGATIVE > 0)
                rows = [(name, task, (1 << len(p)) - 1, len(p), None, None, float(scores[good].sum()), int(good.sum()), float(scores[bad].sum()), int(bad.sum()))]
                for subsets, means in gray_contexts(p, max_k or len(p)):
                    q = (encoder(means) if encoder else means).T
                    pool, held = np.round(v @ q, DIGITS), np.round(p @ q, DIGITS)
                    better = _better(pool[others], v_code[others], held, p_code)
                    for r in members:  # a positive counts where it isn't part of the context
                        apart = subsets >> mine[r] & 1 == 0
                        better += apart & ((pool[r] > held) | ((pool[r] == held) & (v_code[r] < p_code)[:, None]))
                    sizes = np.array([int(s).bit_count() for s in subsets])
                    for j in range(len(p)):
                        for c in np.flatnonzero(subsets >> j & 1 == 0):
                            rows.append((name, task, int(subsets[c]), int(sizes[c]), held_ids[j], int(better[j, c]), None, None, None, None))
                out += rows
            except (ValueError, FloatingPointError):
                continue
        names = ("model_id", "task", "subset", "size", "held", "better", "p_sum", "p_n", "n_sum", "n_n")
        kinds = (pa.string(), table.schema.field("task").type, pa.int64(), pa.int32(), arrow_id, pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64())
        return pa.table({c: pa.array([row[i] for row in out], k) for i, (c, k) in enumerate(zip(names, kinds, strict=True))})

    return grouped.groupBy("task", "block").applyInArrow(run, schema)


def heldout_ranks(counts: DataFrame) -> DataFrame:
    """(model_id, task, subset, size, held, rank) of all contexts and held-out positives, from `context_counts`."""
    return counts.where("held is not null").groupBy("model_id", "task", "subset", "size", "held").agg((F.sum("better") + 1).alias("rank"))


def context_means(ranks: DataFrame, ks: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    """(model_id, task, contexts, mrr, hit_k..): means over a task's contexts of the means over their held-out positives."""
    each = ranks.groupBy("model_id", "task", "subset").agg(F.avg(1.0 / F.col("rank")).alias("mrr"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"hit_{k}") for k in ks])
    return each.groupBy("model_id", "task").agg(F.count("*").alias("contexts"), F.avg("mrr").alias("mrr"), *[F.avg(f"hit_{k}").alias(f"hit_{k}") for k in ks])


def evaluate_tasks(candidates: DataFrame, positives: DataFrame, negatives: DataFrame | None, vectors: DataFrame, models: Models, dim: int, ks: tuple[int, ...] = (5, 10, 20, 50), max_k: int | None = None) -> DataFrame:
    """(model_id, task, status, contexts, mrr, hit_k.., positive_mean, negative_mean, margin, selection_score, rank_among_models).

    candidates, positives and negatives: (task, id); vectors: (id, vector); a model is an encoder of
    contexts, or None for the context itself, and a score its dot product with a vector. The pool is candidates
    and positives, each id once, those with a vector of dim finite numbers. The margin is that of the given positives and negatives among the
    candidates, null where a side is empty. Status: success; partial without any held-out case (fewer than two positives
    with a vector); failed where a model gives no finite score. Models are ranked within each task, equal ones by id.
    """
    counts = save_table(context_counts(candidates, positives, negatives, vectors, models, dim, max_k), "contexts")
    means = context_means(heldout_ranks(counts), ks)
    sums = counts.where("held is null").groupBy("model_id", "task").agg(*[F.sum(c).alias(c) for c in ("p_sum", "p_n", "n_sum", "n_n")])

    def mean(total: str, n: str) -> Column:
        return F.when(F.col(n) > 0, F.col(total) / F.col(n))

    spread = sums.select("model_id", "task", mean("p_sum", "p_n").alias("positive_mean"), mean("n_sum", "n_n").alias("negative_mean"))
    names = candidates.sparkSession.createDataFrame([(m,) for m in models], "model_id string")
    tasks = candidates.select("task").union(positives.select("task")).where("task is not null").distinct()
    rows = tasks.crossJoin(F.broadcast(names)).join(spread.withColumn("_scored", F.lit(True)), ["model_id", "task"], "left").join(means, ["model_id", "task"], "left")
    status = F.when(F.col("_scored").isNull(), "failed").when(F.col("mrr").isNull(), "partial").otherwise("success")
    rows = rows.withColumn("status", status).withColumn("contexts", F.coalesce("contexts", F.lit(0))).withColumn("margin", F.col("positive_mean") - F.col("negative_mean")).drop("_scored")
    return select_models(rows, "task").select("model_id", "task", "status", "contexts", "mrr", *[f"hit_{k}" for k in ks], "positive_mean", "negative_mean", "margin", "selection_score", "rank_among_models")
