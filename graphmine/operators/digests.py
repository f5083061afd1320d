"""Comparison of two tables by a tree of digests over ranges of their keys' hashes, so that only ranges that differ are joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmine.operators.registry import reconcile, row_hash
from graphmine.sources.tables import save_table

#: Levels below the root; each parts a range in 16.
LEVELS = 4


def _node(keys: list[str], levels: int):
    """The range of a row at the lowest level: the first hex digits of the MD5 of its keys; a null key part is told from an empty one."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{k}`").cast("string")), F.lit("")) for k in keys]
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, levels)


def digest_tree(df: DataFrame, keys: list[str], cols: list[str], levels: int = LEVELS) -> DataFrame:
    """(level, node, n_rows, digest) of all ranges that hold rows, the root (level 0, node '') included.

    A digest is the sum of its rows' hashes over keys and columns: the order of rows doesn't matter, equal rows count as often as
    they stand there, and a range's digest is the sum of those below it. The rows are aggregated once, with partial sums, to 16^levels ranges at most; the levels above
    are sums of these.
    """
    leaves = save_table(df.groupBy(_node(keys, levels).alias("node")).agg(F.count("*").alias("n_rows"), F.sum(row_hash([*keys, *cols]).cast("decimal(38,0)")).alias("digest")), "leaves")
    up = [leaves.groupBy(F.substring("node", 1, level).alias("node")).agg(F.sum("n_rows").alias("n_rows"), F.sum("digest").cast("decimal(38,0)").alias("digest")).select(F.lit(level).alias("level"), "node", "n_rows", "digest") for level in range(levels)]
    return reduce(DataFrame.union, [*up, leaves.select(F.lit(levels).alias("level"), "node", "n_rows", "digest")])


def differing_ranges(left: DataFrame, right: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(level, node) of the ranges that differ between two digest trees, from the root down: below a range that agrees nothing is compared.

    A tree may have been stored when a table was bound, and be compared long after.
    """
    found, open_ = [], None
    for level in range(levels + 1):
        a, b = (t.where(F.col("level") == level).select("node", "n_rows", "digest") for t in (left, right))
        if open_ is not None:
            up = open_.withColumnRenamed("node", "up")
            a, b = (t.join(F.broadcast(up), F.substring("node", 1, level - 1) == F.col("up"), "left_semi") for t in (a, b))  # at most 16^(level - 1) short rows
        both = a.alias("a").join(b.alias("b"), "node", "full_outer")
        same = F.col("a.n_rows").eqNullSafe(F.col("b.n_rows")) & F.col("a.digest").eqNullSafe(F.col("b.digest"))
        open_ = save_table(both.where(~same).select("node"), "differ")
        found.append(open_.select(F.lit(level).alias("level"), "node"))
        if open_.isEmpty():
            break
    return reduce(DataFrame.union, found)


def reconcile_ranges(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str], levels: int = LEVELS) -> DataFrame:
    """As `reconcile`, with its rows: only rows of ranges whose digests differ are shuffled and joined."""
    lowest = differing_ranges(digest_tree(left, keys, cols, levels), digest_tree(right, keys, cols, levels), levels).where(F.col("level") == levels).select("node")
    few = F.broadcast(lowest)  # at most 16^levels nodes of `levels` letters
    a, b = (t.withColumn("_node", _node(keys, levels)).join(few.withColumnRenamed("node", "_node"), "_node", "left_semi").drop("_node") for t in (left, right))
    return reconcile(a, b, keys, cols)


def group_digests(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """(group, n_rows, digest) of groups of any size: sums of row hashes with partial aggregation; `checksums` has an ordered SHA-256 for groups of dictionary size."""
    return df.groupBy(group).agg(F.count("*").alias("n_rows"), F.sum(row_hash(cols).cast("decimal(38,0)")).alias("digest"))
