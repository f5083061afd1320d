"""Registry tables: upserts, stubs, versions, bindings, checks, reconciliation of two tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the latest of both tables by the given order; replaying `new` changes nothing."""
    rows = old.unionByName(new)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def stub_parents(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Keys that children name and parents lack."""
    return children.select(key).where(F.col(key).isNotNull()).distinct().join(parents.select(key), key, "left_anti")


def append_version(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' rows; a key that exists already is an error."""
    clash = new.join(old.select(*keys), keys, "left_semi").agg(F.count("*").alias("_n"))
    checked = new.crossJoin(clash).where(F.when(F.col("_n") > 0, F.raise_error(F.lit("a version exists already"))).otherwise(F.lit(True))).drop("_n")  # one row on the right
    return old.unionByName(checked)


def checksums(df: DataFrame, group: str, key: str, cols: list[str]) -> DataFrame:
    """(group, n_rows, checksum): SHA-256 of a group's rows in key order, whatever order they are stored in. For groups of dictionary size."""
    line = F.concat_ws(",", *[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in cols])
    return df.groupBy(group).agg(F.count("*").alias("n_rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key), line.alias("l")))), lambda x: x["l"]), "\n"), 256).alias("checksum"))


def row_hash(cols: list[str]) -> Column:
    """A 64-bit hash of a row that tells null from other values, and which column is null."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in cols], *[F.col(f"`{c}`").isNull() for c in cols])


def table_digest(df: DataFrame) -> DataFrame:
    """n_rows and an order-free digest of a table of any size: the sum of its rows' hashes, so that equal rows count as often as they occur."""
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(row_hash(df.columns).cast("decimal(38,0)")), F.lit(0)).alias("digest"))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(keys, status, column): rows missing on a side, and for rows on both sides each column that differs, null equal to null."""
    a = left.select(*keys, *[F.col(c).alias(f"l_{i}") for i, c in enumerate(cols)], F.lit(True).alias("_l"))
    b = right.select(*keys, *[F.col(c).alias(f"r_{i}") for i, c in enumerate(cols)], F.lit(True).alias("_r"))
    both = a.join(b, keys, "full_outer")
    differ = F.array(*[F.when(~F.col(f"l_{i}").eqNullSafe(F.col(f"r_{i}")), F.lit(c)) for i, c in enumerate(cols)])
    status = F.when(F.col("_r").isNull(), "missing_right").when(F.col("_l").isNull(), "missing_left").otherwise("mismatch")
    named = F.when(F.col("_l") & F.col("_r"), F.filter(differ, lambda x: x.isNotNull())).otherwise(F.array(F.lit("")))
    return both.select(*keys, status.alias("status"), F.explode(named).alias("column"))


def best_row(df: DataFrame, group: str, scores: list[str], id_col: str) -> DataFrame:
    """The first row of each group by scores descending, nulls last, then id."""
    order = Window.partitionBy(group).orderBy(*[F.desc_nulls_last(s) for s in scores], id_col)
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def next_version(df: DataFrame, group: str, version: str) -> DataFrame:
    """v%03d after the highest version of each group; other names are ignored."""
    number = F.regexp_extract(version, r"^v(\d+)$", 1).try_cast("int")
    return df.groupBy(group).agg(F.concat(F.lit("v"), F.lpad((F.coalesce(F.max(number), F.lit(0)) + 1).cast("string"), 3, "0")).alias("next_version"))


def flatten_json(df: DataFrame, id_col: str, col: str, allowed: list[str]) -> DataFrame:
    """(id, key, value, applied) of a column of flat JSON objects."""
    pairs = F.from_json(col, "map<string,string>")
    return df.select(id_col, F.explode(pairs).alias("key", "value")).withColumn("applied", F.col("key").isin(*allowed))


def flatten_nested(df: DataFrame, id_col: str, col: str, allowed: list[str]) -> DataFrame:
    """(id, key, value, applied) of a struct column: nested fields under dotted keys, null ones left out."""
    def walk(kind, path: str, at) -> list:
        out = []
        for f in kind.fields:
            name, value = (f"{path}.{f.name}" if path else f.name), at[f.name]
            out += walk(f.dataType, name, value) if hasattr(f.dataType, "fields") else [(name, value)]
        return out

    leaves = walk(df.schema[col].dataType, "", F.col(col))
    cells = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in leaves])
    return df.select(id_col, F.explode(cells).alias("c")).select(id_col, "c.key", "c.value").where("value is not null").withColumn("applied", F.col("key").isin(*allowed))


def verify_bindings(bound: DataFrame, now: DataFrame, group: str) -> DataFrame:
    """(group, state) of the bound groups: same, rows differ, content differs or gone, by row count and checksum then and now."""
    later = now.select(group, F.col("n_rows").alias("_n"), F.col("checksum").alias("_c"))
    state = F.when(F.col("_n").isNull(), "gone").when(F.col("n_rows") != F.col("_n"), "rows differ").when(F.col("checksum") != F.col("_c"), "content differs").otherwise("same")
    return bound.join(later, group, "left").select(group, state.alias("state"))


def with_parent(versions: DataFrame, group: str, version: str) -> DataFrame:
    """Versions with the one before them as `parent`, null for the first."""
    return versions.withColumn("parent", F.lag(version).over(Window.partitionBy(group).orderBy(version)))


def recent(df: DataFrame, n: int, *newest_first: str) -> DataFrame:
    """The n rows that come first by the columns descending; each task sends n at most."""
    return df.orderBy(*[F.desc(c) for c in newest_first]).limit(n)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(layer, n): the rows of each table."""
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n") for name, df in tables.items()])


def orphans(links: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(child, n): for each named link (children, key, parents, key) the children whose key no parent has; null keys aren't counted."""
    parts = []
    for name, (children, key, parents, parent_key) in links.items():
        known = parents.select(F.col(parent_key).alias(key)).distinct()
        lost = children.where(F.col(key).isNotNull()).join(known, key, "left_anti")
        parts.append(lost.agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "n"))
    return reduce(DataFrame.union, parts)


def status_of(rows: DataFrame, known: DataFrame, key: str, status: str, missing: str) -> DataFrame:
    """All rows with the status of their known row, `missing` where there is none."""
    return rows.join(known.select(key, F.col(status).alias("_s")), key, "left").withColumn("status", F.coalesce("_s", F.lit(missing))).drop("_s")


def freshness(pairs: DataFrame, made: str, changed: str) -> DataFrame:
    """Add `state`: stale if what a row was made from has changed since, else current."""
    return pairs.withColumn("state", F.when(F.col(changed) > F.col(made), "stale").otherwise("current"))
