"""How document filters interact: what each removes in every order, and its exact Shapley share.

A document's failures are one bit mask, so a part of the corpus is at most 2^n counts, one for
each mask that occurs. From them the removals of all 2^n coalitions of filters are tabulated. The
Shapley values solve a least-squares problem over the coalitions: kernel weights, an additive
model, and the constraint that the shares sum up to what all filters remove together
(efficiency). Its normal equations are solved in rationals, so that the values are exact. What a
filter removes at a step of an order is the difference of two coalitions.
"""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import save

#: The filters of `filter_audit`, by letter; COPIES is the one that looks at other documents.
LETTERS, COPIES = "ABCDE", "E"

_WORD = r"[^\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides by itself.

    A: under 50 words; B: fewer than 65 % of the words are distinct; C: over 5 % of the code points are A to Z;
    D: one of #$%&*| occurs. An empty text fails A alone.
    """
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """(part, mask, docs, good, toxic): documents of each part by the set of filters that they fail.

    Bit i of mask stands for LETTERS[i]. Equal texts are told by their SHA-256, and a document is a
    copy if a smaller id anywhere has its text: the smallest id of each text is aggregated with
    partial sums, and documents meet it by text and id, so that no group of copies meets in one
    task. A null text counts as empty, a null part as the empty one; a document with a null id is
    no copy and makes none, and has no label. Equal rows count as often as they stand there, and
    the first of equal ids and texts is all of them. A document is good (toxic) if any of its
    labels says quality = 1 (toxic = 1). Further columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(F.col("text")).values())), F.lit(0))
    # some 50 bytes a document; read three times
    slim = save(read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.cast("int").alias("mask")), "failures")
    known = slim.where("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    met = known.join(first, ["digest", "doc_id"], "left").join(flags, "doc_id", "left")
    copy = F.when(F.col("first").isNull(), 1 << LETTERS.index(COPIES)).otherwise(0)
    rows = met.select("part", (F.col("mask") + copy).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    nameless = slim.where("doc_id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return rows.union(nameless).groupBy("part", "mask").agg(F.count("*").alias("docs"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def coalition_removals(masks: Iterable[int], counts: Iterable[int], n: int) -> np.ndarray:
    """What each of the 2^n coalitions of filters removes: the documents that fail one of its filters at least."""
    masks, counts = np.asarray(list(masks), np.int64), np.asarray(list(counts), np.int64)
    return np.where(np.arange(1 << n)[:, None] & masks != 0, counts, 0).sum(axis=1)


def solve(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The solution of a regular system of linear equations in rationals."""
    rows = [[*row, b] for row, b in zip(matrix, right, strict=True)]
    for i in range(len(rows)):
        pivot = next(k for k in range(i, len(rows)) if rows[k][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k, row in enumerate(rows):
            if k != i and row[i]:
                rows[k] = [x - row[i] * y for x, y in zip(row, rows[i], strict=True)]
    return [row[-1] for row in rows]


def shapley(removed: np.ndarray, n: int) -> list[Fraction]:
    """The Shapley values of a table of coalition removals, by kernel-weighted least squares under the efficiency constraint."""
    total = Fraction(int(removed[-1]) - int(removed[0]))
    normal = [[Fraction(0)] * n for _ in range(n)]
    right = [Fraction(0)] * n
    for s in range(1, (1 << n) - 1):
        inside = [i for i in range(n) if s >> i & 1]
        size = len(inside)
        weight = Fraction(n - 1, comb(n, size) * size * (n - size))
        for i in inside:
            right[i] += weight * (int(removed[s]) - int(removed[0]))
            for j in inside:
                normal[i][j] += weight
    # the constraint with its multiplier as a further row and column; one filter alone has no proper coalition
    if n == 1:
        return [total]
    system = [[*row, Fraction(1)] for row in normal] + [[Fraction(1)] * n + [Fraction(0)]]
    return solve(system, [*right, total])[:n]


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_part(part: str, rows: pd.DataFrame, letters: str = LETTERS) -> pd.DataFrame:
    """The steps of all orders of the filters for one part's counts (mask, docs, good, toxic)."""
    n = len(letters)
    removed, good, toxic = (coalition_removals(rows["mask"], rows[c], n) for c in ("docs", "good", "toxic"))
    everything, full = int(rows["docs"].sum()), (1 << n) - 1
    shares = [x * factorial(n) for x in shapley(removed, n)]
    out = []
    for order in permutations(range(n)):
        before, name = 0, "".join(letters[i] for i in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            here = int(removed[after] - removed[before])
            out.append((part, name, step, everything - int(removed[after]), here, int(removed[1 << i]) - here, int(removed[full] - removed[full ^ 1 << i]), int(good[after] - good[before]), int(toxic[after] - toxic[before]), int(shares[i])))
            before = after
    return pd.DataFrame(out, columns=[c.split()[0] for c in AUDIT.split(", ")])


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The steps of all orders for each part of (part, mask, docs, good, toxic); a part has 2^n rows at most."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return audit_part(key[0], rows, letters)

    return counts.groupBy("part").applyInPandas(one, AUDIT)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step; an empty table gives none. `failure_counts` states how documents are counted.

    kept: left after the step; removed: by it; redundant: failing its filter but removed before; unique_fails: failing
    its filter alone; good_lost and toxic_lost: removed by it and labelled so; shapley: what its filter removes,
    summed over all orders, which is the Shapley value times the number of orders.
    """
    return audit(failure_counts(docs, labels))
