"""Dedupe, filters, status and quality codes, splitting of container notations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphmine.functions import content_id


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by an order; Spark keeps one row a task before it shuffles."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def between_sizes(df: DataFrame, size: Column, lo: int, hi: int) -> DataFrame:
    return df.where(size.between(lo, hi))


def repair_status(old: Column, new: Column) -> Column:
    """0 invalid, 2 unchanged, 1 changed."""
    return F.when(new.isNull(), 0).when(new.eqNullSafe(old), 2).otherwise(1)


def normalised(col: Column) -> Column:
    """Lower case, white space as single spaces, trimmed; null if nothing is left."""
    t = F.trim(F.regexp_replace(F.lower(col), r"[ \t\n\r]+", " "))
    return F.when(t == "", None).otherwise(t)


def literal_symbols(col: Column) -> Column:
    """Symbols of a literal [{'Zn':'0'},{'As':'3.0'}], in order, without repeats."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit(r"'([A-Za-z]+)'\s*:"), F.lit(1)))


def bracket_symbols(col: Column, hubs: list[str]) -> Column:
    """The first hub symbol of each bracket [..]."""
    inside = F.regexp_extract_all(col, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    known = F.array(*[F.lit(h) for h in hubs])
    firsts = F.transform(inside, lambda b: F.try_element_at(F.filter(F.regexp_extract_all(b, F.lit(r"[A-Z][a-z]?"), F.lit(0)), lambda s: F.array_contains(known, s)), F.lit(1)))
    return F.filter(firsts, lambda s: s.isNotNull())


def quality_code(col: Column, hubs: list[str], most_dots: int = 11) -> Column:
    """3 too many components; else 2 only hubs; else 1 no symbol at all; else 0."""
    syms = F.array_distinct(F.regexp_extract_all(col, F.lit(r"[A-Z][a-z]?"), F.lit(0)))
    dots = F.length(col) - F.length(F.regexp_replace(col, r"\.", ""))
    only = F.size(F.array_except(syms, F.array(*[F.lit(h) for h in hubs]))) == 0
    return F.when(dots > most_dots, 3).when((F.size(syms) > 0) & only, 2).when(F.size(syms) == 0, 1).otherwise(0)


def components_of(df: DataFrame, col: str, hubs: list[str]) -> DataFrame:
    """One row for each component of a notation split at dots: position, component, whether it holds a hub symbol."""
    has = F.lit(False)
    for h in hubs:
        has = has | F.col("component").contains(h)
    return df.select("*", F.posexplode(F.split(col, r"\.")).alias("position", "component")).where("component <> ''").withColumn("has_hub", has)


def upload_violations(df: DataFrame, id_col: str, key_col: str) -> DataFrame:
    """(violation, id): half-empty rows, ids of several keys, keys of several ids."""
    empty = F.col(id_col).isNull() | F.col(key_col).isNull()
    half = df.where(empty).select(F.lit("half_empty").alias("violation"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"))
    full = df.where(~empty)
    ids = full.groupBy(id_col).agg(F.count_distinct(key_col).alias("n")).where("n > 1").select(F.lit("id_reused").alias("violation"), F.col(id_col).cast("string").alias("id"))
    keys = full.groupBy(key_col).agg(F.count_distinct(id_col).alias("n")).where("n > 1").select(F.lit("key_repeated").alias("violation"), F.col(key_col).cast("string").alias("id"))
    return half.union(ids).union(keys)


def keep_first_report(df: DataFrame, keys: list[str], order: list) -> tuple[DataFrame, DataFrame]:
    """(first rows of each key, one row: rows before, kept and removed)."""
    total = df.agg(F.count("*").alias("rows"), F.count_distinct(F.struct(*keys)).alias("kept"))
    return keep_first(df, keys, order), total.withColumn("removed", F.col("rows") - F.col("kept"))


def repair_and_rekey(df: DataFrame, id_col: str, text: str, repair=normalised) -> DataFrame:
    """(id, source_id, text, status): repaired texts under ids made from them, invalid ones left out, each text once.

    status is 2 for a text that the repair left as it was, else 1. Of equal texts the row with the smallest source id stays.
    """
    rows = df.select(F.col(id_col).alias("source_id"), F.col(text).alias("old"), repair(F.col(text)).alias("text"))
    rows = rows.withColumn("status", repair_status(F.col("old"), F.col("text"))).where("status <> 0")
    first = rows.groupBy("text").agg(F.min_by(F.struct("source_id", "status"), "source_id").alias("f"))
    return first.select(content_id(F.col("text")).alias("id"), "f.source_id", "text", "f.status")


def hub_literal(pairs: Column) -> Column:
    """The literal [{'Zn':'2'},..] of an array of (symbol, charge), sorted, each once."""
    one = F.transform(F.array_sort(F.array_distinct(pairs)), lambda x: F.concat(F.lit("{'"), x["symbol"], F.lit("':'"), x["charge"].cast("string"), F.lit("'}")))
    return F.concat(F.lit("["), F.array_join(one, ","), F.lit("]"))


def has_hub(col: Column, hubs: list[str]) -> Column:
    """Whether any bracket of a notation holds a hub symbol."""
    return F.size(bracket_symbols(col, hubs)) > 0


def sized(df: DataFrame, size: Column, least: int, text: Column, never: list[str]) -> DataFrame:
    """Rows of at least that size whose text is none of the given ones."""
    return df.where((size >= least) & ~text.isin(*never))


def split_containers(df: DataFrame, id_col: str, col: str, hubs: list[str]) -> DataFrame:
    """(id, hubs, quality, position, component, has_hub): a row for each component of each notation that holds a hub."""
    rows = df.where(has_hub(F.col(col), hubs)).select(F.col(id_col).alias("id"), F.col(col).alias("_s"), bracket_symbols(F.col(col), hubs).alias("hubs"), quality_code(F.col(col), hubs).alias("quality"))
    return components_of(rows, "_s", hubs).drop("_s")


def neighbour_rows(split: DataFrame) -> DataFrame:
    """(position, centre, neighbour): the components without a hub beside the hubs of their container as one joined centre; each once."""
    rows = split.where(~F.col("has_hub")).select("position", F.array_join(F.array_sort(F.array_distinct("hubs")), ",").alias("centre"), F.col("component").alias("neighbour"))
    return rows.distinct()


def named_values(tables: list[DataFrame], part: str) -> DataFrame:
    """The distinct filled values of every column whose name holds `part`, of all tables."""
    out = None
    for df in tables:
        for c in df.columns:
            if part.lower() in c.lower():
                value = F.trim(F.col(f"`{c}`").cast("string"))
                one = df.select(value.alias("value")).where("value <> ''")
                out = one if out is None else out.union(one)
    if out is None:
        raise ValueError(f"no column's name holds {part}")
    return out.distinct()
