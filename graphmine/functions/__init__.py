"""Column functions: ids, keyed random numbers, weights, tolerant parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern_id(text: Column) -> Column:
    """G and six digits: the first 12 hex digits of the MD5, modulo a million; null for null."""
    return F.concat(F.lit("G"), F.lpad((F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % 1000000).cast("string"), 6, "0"))


def content_id(text: Column) -> Column:
    """D and fifteen digits: 48 bits of the SHA-256."""
    return F.concat(F.lit("D"), F.lpad(F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10), 15, "0"))


def id_number(col: Column) -> Column:
    """The digits of a content id; null without any."""
    return F.regexp_extract(col, r"D(\d+)", 1).try_cast("long")


def hub_id(number: Column) -> Column:
    """D{number}E."""
    return F.concat(F.lit("D"), number.cast("string"), F.lit("E"))


def keyed_hash(seed: int, *keys: Column) -> Column:
    """A hex string that orders rows in the same random way at any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def keyed_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the seed and the keys: 52 bits of their MD5."""
    return F.conv(F.substring(keyed_hash(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def keyed_slot(seed: int, *keys: Column) -> Column:
    """A number of 48 bits from the seed and the keys."""
    return F.conv(F.substring(keyed_hash(seed, *keys), 1, 12), 16, 10).cast("long")


def strip_layer(col: Column) -> Column:
    """An id without its layer prefix (L0_ to L5_, M_), in either case."""
    return F.regexp_replace(col, r"(?i)^(L[0-5]|M)_", "")


def add_layer(col: Column, layer: str) -> Column:
    return F.concat(F.lit(f"{layer}_"), strip_layer(col))


def blank_to_null(col: Column) -> Column:
    """Null for blank text and the literals nan and None."""
    t = F.trim(col.cast("string"))
    return F.when(F.lower(t).isin("", "nan", "none"), None).otherwise(t)


def size_number(col: Column) -> Column:
    """A size given as text, truncated to an integer; null if it isn't a number."""
    return F.trim(col.cast("string")).try_cast("double").cast("int")


def truth(col: Column) -> Column:
    """Tolerant boolean: 1, true, t, yes, y against 0, false, f, no, n, in either case, and numbers 1 and 0; else null."""
    t = F.lower(F.trim(col.cast("string")))
    number = t.try_cast("double")
    return F.when(t.isin("1", "true", "t", "yes", "y") | (number == 1.0), True).when(t.isin("0", "false", "f", "no", "n") | (number == 0.0), False)


def list_key(col: Column) -> Column:
    """A list given as text ([..] or comma-separated) in one form whatever its order."""
    bare = F.regexp_replace(col, r"[\[\]'\"\s]", "")
    return F.array_join(F.array_sort(F.filter(F.split(bare, ","), lambda x: x != "")), ",")


def scaled_distance(d: Column, lo: Column, hi: Column) -> Column:
    """d between two quantiles as a share, held in 0 to 1; 0 where they are equal."""
    return F.when(hi == lo, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d - lo) / (hi - lo))))


def decay_weight(d: Column, alpha: float, mix: float) -> Column:
    """mix * exp(-alpha * d) + 1 - mix."""
    return F.lit(mix) * F.exp(-F.lit(alpha) * d) + F.lit(1.0 - mix)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Dot product of two vectors, each over its norm plus eps."""
    return dot(a, b) / ((F.sqrt(dot(a, a)) + F.lit(eps)) * (F.sqrt(dot(b, b)) + F.lit(eps)))


def artifact_type(path: Column) -> Column:
    """csv, json, log or model by a path's suffix; other for the rest."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin("csv", "tsv"), "csv").when(suffix == "json", "json").when(suffix.isin("log", "txt"), "log").when(suffix.isin("pt", "ckpt", "npz"), "model").otherwise("other")


def run_of_path(path: Column) -> tuple[Column, Column]:
    """(project, run) of a path .../projects/P/.../runs/R/...; empty text where absent."""
    where = r"projects/([^/]+)/(?:.*/)?runs/([^/]+)"
    return F.regexp_extract(path, where, 1), F.regexp_extract(path, where, 2)


def name_is_valid(col: Column) -> Column:
    return F.coalesce(col.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"), F.lit(False))


def symbols(col: Column) -> Column:
    """Sorted distinct element symbols of a bracketed notation, hydrogen left out."""
    found = F.regexp_extract_all(col, F.lit(r"[A-Z][a-z]?"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "H")))


def composite_id(*cols: Column) -> Column:
    """The parts of an id joined by _; null parts are left out."""
    return F.concat_ws("_", *[c.cast("string") for c in cols])
