"""Exact quantiles of groups of any size, by selection instead of a sort or a map of a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphmine.sources.tables import save_table

#: Ranges that a bracket is parted in at each round, and distinct values that one task sorts at most.
RANGES, SLICE = 64, 20_000


def quantiles(df: DataFrame, group: str, value: str, shares: list[float], slice_size: int = SLICE) -> DataFrame:
    """(group, share, quantile): with linear interpolation between the two values around (n - 1) * share, as `percentile` has it.

    Equal values are counted first, with partial sums. Each group and share then has a bracket of values that holds
    the two looked for: it is parted at approximate quantiles of its distinct values, the parts are counted exactly, and the
    one or two parts that hold the wanted places are the next bracket. A bracket of at most slice_size distinct values is sorted. Null and NaN values are left out; a
    null group is a group; a group without values has no row.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)").groupBy("g", "v").agg(F.count("*").alias("w"))
    rows = save_table(rows, "values")
    whole = rows.groupBy("g").agg(F.sum("w").alias("n"), F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    place = (F.col("n") - 1) * F.col("share")
    first = whole.select("*", wanted).select("g", "share", "inside", "lo", "hi", F.lit(0).cast("long").alias("below"), place.alias("place"), F.floor(place).alias("k0"), F.ceil(place).alias("k1"))
    open_, done, least = save_table(first, "brackets"), None, max(slice_size, 2)  # two values may stay apart for ever
    at = [(i + 1) / RANGES for i in range(RANGES - 1)]
    while True:
        ready = open_.where(F.col("inside") <= least)
        done = ready if done is None else done.union(ready)
        open_ = save_table(open_.where(F.col("inside") > least), "open")
        if open_.isEmpty():
            break
        inside = _inside(rows, open_.select("g", "share", "lo", "hi"))
        edges = inside.groupBy("g", "share").agg(F.percentile_approx("v", at, F.lit(1000)).alias("edges"))
        part = F.size(F.filter("edges", lambda e: e < F.col("v")))
        edges = edges.select(F.col("g").alias("g2"), F.col("share").alias("share2"), "edges")
        parted = inside.join(edges, F.col("g").eqNullSafe(F.col("g2")) & (F.col("share") == F.col("share2"))).withColumn("part", part)
        counts = parted.groupBy("g", "share", "part").agg(F.sum("w").alias("w"), F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        before = Window.partitionBy("g", "share").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
        counts = counts.withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0))).withColumnsRenamed({"g": "g2", "share": "share2"})
        met = open_.select("g", "share", "below", "place", "k0", "k1").join(counts, F.col("g").eqNullSafe(F.col("g2")) & (F.col("share") == F.col("share2")))
        start, stop = F.col("below") + F.col("before"), F.col("below") + F.col("before") + F.col("w")
        kept = met.where((F.col("k1") >= start) & (F.col("k0") < stop)).withColumn("start", start)
        open_ = save_table(kept.groupBy("g", "share", "place", "k0", "k1").agg(F.sum("c").alias("inside"), F.min("a").alias("lo"), F.max("b").alias("hi"), F.min("start").alias("below")).select(*first.columns), "brackets")
    last = _inside(rows, done)
    until = Window.partitionBy("g", "share").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # slice_size rows
    ranked = last.withColumn("end", F.col("below") + F.sum("w").over(until)).withColumn("start", F.col("end") - F.col("w"))
    holds = lambda k: F.max(F.when((F.col("start") <= F.col(k)) & (F.col(k) < F.col("end")), F.col("v")))
    ends = ranked.groupBy("g", "share").agg(holds("k0").alias("v0"), holds("k1").alias("v1"), F.max(F.col("place") - F.col("k0")).alias("rest"))
    return ends.select(F.col("g").alias(group), "share", (F.col("v0") * (1 - F.col("rest")) + F.col("v1") * F.col("rest")).alias("quantile"))


def _inside(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """The values of each bracket."""
    b = brackets.withColumnRenamed("g", "g3")
    return rows.join(b, F.col("g").eqNullSafe(F.col("g3")) & F.col("v").between(F.col("lo"), F.col("hi"))).drop("g3", "lo", "hi", "inside")
