"""Near copies among embeddings by collision counting on one-dimensional projections.

Unit vectors with a cosine of t or more lie within d = sqrt(2 - 2 t), so their values
under a random Gaussian direction differ by N(0, d^2). Each vector gets its values under
many directions.

* Groups of `per_table` directions, each cut into intervals at a random offset, deal the vectors to
  cells, so that only vectors that share a cell of at least one table meet.
* In a cell the vectors are sorted by one value, and a query meets the ones whose value lies within
  its reach. For each pair in there the directions are counted in which the values differ by at
  most the window's half width. Pairs that reach the calibrated count are verified
  in double precision on the original vectors.

The number of tables, the count and the reach follow from the asked recall at the threshold, each with a third of the misses (closer
pairs are found more surely still). A pair that meets in several tables counts in the
first one. Equal vectors form one class, of which one copy goes on.
"""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbuf as tb
from .components import components
from .shared import IdFilter, save

#: Width of a direction's intervals, and half width of the windows, on unit vectors.
CELL_WIDTH, HALF_WINDOW = 2.0, 1.0
COUNTED = 16
#: Vectors a cell has about; directions of a table follow from it.
CELL_ROWS = 600
#: A cell of more vectors is dealt to blocks of about BLOCK vectors, of which each two meet in a place.
LARGE_CELL, BLOCK = 6000, 3000
#: Placements of a task, about, and those that are made at once.
TASK_ROWS, MADE = 40_000, 50_000


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, float64 values in a row, their offsets) of the vectors without null or non-finite components and with a norm above 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kept, values = [], []
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    offs = np.concatenate([[0], np.cumsum(size)])
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(bad | ~np.isfinite(x))])
    with np.errstate(over="ignore", invalid="ignore"):
        square = np.concatenate([[0], np.cumsum(np.where(np.isfinite(x), np.abs(x), 0) > 0)])
    ok = (size > 0) & (bad[offs[1:]] == bad[offs[:-1]]) & (square[offs[1:]] > square[offs[:-1]])
    for i in np.flatnonzero(ok):
        kept.append(i)
        values.append(x[offs[i] : offs[i + 1]])
    n = np.array([len(v) for v in values], np.int64)
    return np.array(kept, np.int64), np.concatenate(values) if values else np.zeros(0), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def clean_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, class, vec): usable vectors as packed float64, and a hash of their values."""

    def scan(batches):
        for batch in batches:
            rows, x, offs = usable(batch.column(1))
            x = x + 0.0  # -0.0 becomes 0.0
            data = x.view(np.uint8)
            key = np.array([int(tb.span_hashes(data[8 * a : 8 * b], np.array([0]), np.array([8 * (b - a)]))[0]) for a, b in zip(offs[:-1], offs[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(key.view(np.int64)), tb.binaries(x, offs)], ["vec_id", "class", "vec"])

    return table.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).mapInArrow(scan, "vec_id long, class long, vec binary")


def by_length(column: pa.Array):
    """(length, rows, matrix) of the packed vectors of each length."""
    values, offs = tb.unbinaries(column, np.float64)
    size = np.diff(offs)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        yield d, rows, values[(offs[rows][:, None] + np.arange(d)).ravel()].reshape(-1, d)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to norm 1; a first division by the largest value keeps squares in range."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _normal(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def plan(n: int, threshold: float, recall: float) -> tuple[int, int, int, float]:
    """(directions per table, tables, least count, reach in the sorted value) for n vectors."""
    miss = (1 - recall) / 3  # of the tables, of the count and of the reach
    d = math.sqrt(max(2 - 2 * threshold, 1e-6))
    per_table = max(2, round(math.log2(max(n, 4) / CELL_ROWS)) if n > CELL_ROWS else 2)
    r = CELL_WIDTH / d
    same = 2 * _normal(r) - 1 - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
    tables = max(4, math.ceil(math.log(miss) / math.log(1 - same**per_table)))
    p = 2 * _normal(HALF_WINDOW / d) - 1
    tail, least = 0.0, COUNTED
    for c in range(COUNTED, -1, -1):
        tail += math.comb(COUNTED, c) * p**c * (1 - p) ** (COUNTED - c)
        least = c
        if tail >= 1 - miss:
            break
    return per_table, tables, least, d * NormalDist().inv_cdf(1 - miss / 2)


@functools.lru_cache(4)
def _directions(d: int, cut: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions for vectors of one length, `cut` of them with the offsets of their intervals; the same in every task."""
    rng = np.random.default_rng([seed, d])
    return rng.normal(size=(d, cut + COUNTED)), rng.uniform(0, CELL_WIDTH, cut)


def _links_of_cell(x: np.ndarray, value: np.ndarray, keys: np.ndarray, table: int, side: np.ndarray, least: int, threshold: float, reach: float):
    """Pairs (i, j) of the rows of one cell, i before j in the order of a value, that are linked and meet in no earlier table. side: two blocks that only meet each other (0, 1), or one (2)."""
    order = np.argsort(value[:, 0], kind="stable")
    v = value[order]
    stop = np.searchsorted(v[:, 0], v[:, 0] + reach, "right")
    found = []
    for lo in range(0, len(order), 256):
        hi = min(lo + 256, len(order))
        a, b = lo, int(stop[hi - 1])
        if b - a < 2:
            continue
        count = np.zeros((hi - lo, b - a), np.int8)
        for j in range(v.shape[1]):
            count += np.abs(v[lo:hi, j, None] - v[None, a:b, j]) <= HALF_WINDOW
        i, j = np.nonzero(count >= least)
        i, j = order[i + lo], order[j + a]
        keep = np.arange(len(i))
        # each pair once, the first in the order
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        keep = (rank[i] < rank[j]) & ((side[i] == 2) | (side[i] != side[j]))
        i, j = i[keep], j[keep]
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            near = np.einsum("nd,nd->n", x[p], x[q]) >= threshold
            p, q = p[near], q[near]
            new = ~(keys[p, :table] == keys[q, :table]).any(axis=1) if table else np.ones(len(p), bool)
            found.append((p[new], q[new]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def placements(keys: np.ndarray, cls: np.ndarray, parts: np.ndarray):
    """Yield (row, table, place, side) of the rows' cells, at most MADE at once.

    keys and parts: rows x tables, a cell and the number of its blocks; cls picks a row's block. A row
    of a cell with several blocks meets each block in one place, so any two rows of the cell meet in one.
    """
    flat, tables = parts.ravel(), parts.shape[1]
    ends = np.cumsum(flat)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, MADE):
        at = np.arange(lo, min(lo + MADE, int(ends[-1])))
        cell = np.searchsorted(ends, at, "right")
        p = flat[cell].astype(np.uint64)
        other = (at - (ends[cell] - flat[cell])).astype(np.uint64)
        own = tb.mix(cls.view(np.uint64)[cell // tables]) % p
        a, b = np.minimum(own, other), np.maximum(own, other)
        yield cell // tables, cell % tables, tb.mix(keys.ravel()[cell] + a * p + b), np.where(a == b, 2, (own == b).astype(np.int64))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of n rows."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def embedding_dedup(table: DataFrame, threshold: float = 0.9, recall: float = 0.998, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    A vector that is null, zero or holds a null or non-finite component has no link and
    is its own component. Equal vectors link with each other. Rows with equal ids are
    separate rows; a row with a null id links too, and names no component unless all
    ids there are null. Vectors of different lengths never link. Further columns are
    ignored; an empty table gives an empty result.
    """
    spark = table.sparkSession
    vectors = save(clean_vectors(table, id_col, vec_col), "vectors")
    least_first = Window.partitionBy("class").orderBy("vec_id")
    heads = vectors.withColumn("r", F.row_number().over(least_first)).where("r = 1").select("class", "vec")
    classes = vectors.groupBy("class").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    heads = save(heads.join(classes.select("class", "size"), "class"), "heads")
    n = heads.count()
    if not n:
        return table.select(F.col(id_col).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"), F.col(id_col).isNotNull().alias("kept"))
    per_table, tables, least, reach = plan(n, threshold, recall)

    def keyed(vecs):
        """For each length: (length, rows, unit vectors, counted values, cell of each table)."""
        for d, rows, x in by_length(vecs):
            base, shift = _directions(d, per_table * tables, seed)
            u = unit(x)
            proj = u @ base
            cell = np.floor((proj[:, :-COUNTED] + shift) / CELL_WIDTH).astype(np.int64).reshape(len(u), tables, per_table)
            keys = np.full((len(u), tables), d, np.uint64)
            for k in range(per_table):
                keys = tb.mix(keys * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, k].astype(np.uint64) + np.arange(tables, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))
            yield d, rows, u, proj[:, -COUNTED:], keys

    def cells(batches):
        for batch in batches:
            for *_, keys in keyed(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64))], ["cell"])

    sizes = heads.select("vec").mapInArrow(cells, "cell long").groupBy("cell").count().where(f"count > {LARGE_CELL}")
    sizes = save(sizes.select("cell", "count", F.ceil(F.col("count") / BLOCK).cast("long").alias("parts")), "cells")
    total = sizes.agg(F.count("*").alias("cells"), F.coalesce(F.sum(F.col("count") * (F.col("parts") - 1)), F.lit(0)).alias("more")).first()
    buckets = max(24, (n * tables + total["more"]) // TASK_ROWS)
    large = IdFilter.of(sizes, "cell", total["cells"])

    def wide(batches):
        """(class, tab, cell) of the rows' cells that may be large."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                for _, rows, _, _, keys in keyed(part.column(1)):
                    row, tab = np.nonzero(large(keys.ravel().view(np.int64)).reshape(keys.shape))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[row])), pa.array(tab), pa.array(keys[row, tab].view(np.int64))], ["class", "tab", "cell"])

    dealt = heads.withColumn("blocks", F.lit(None).cast("array<long>"))
    if total["cells"]:
        blocks = heads.select("class", "vec").mapInArrow(wide, "class long, tab long, cell long").join(sizes.select("cell", "parts"), "cell")
        # table and number of blocks in one number
        dealt = heads.join(blocks.groupBy("class").agg(F.collect_list(F.col("parts") * tables + F.col("tab")).alias("blocks")), "class", "left")

    def deal(batches):
        """One row for each vector and bucket, with its places there."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                parts = np.ones((part.num_rows, tables), np.int64)
                listed = part.column(3)
                packed = listed.flatten().to_numpy(zero_copy_only=False)
                count = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                parts[np.repeat(np.arange(part.num_rows), count), packed % tables] = packed // tables
                for d, rows, u, value, keys in keyed(part.column(1)):
                    cls = part.column(0).take(pa.array(rows)).to_numpy()
                    for row, tab, place, side in placements(keys, cls, parts[rows]):
                        bucket = (place % np.uint64(buckets)).astype(np.int64)
                        order = np.lexsort((bucket, row))
                        row, bucket, place, code = row[order], bucket[order], place[order], (4 * tab + side)[order]
                        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])]))
                        offs = np.append(first, len(row))
                        # a vector may be repeated for many buckets
                        for at in range(0, len(first), 5000):
                            r, o = row[first[at : at + 5000]], offs[at : at + 5001]
                            take = pa.array(rows[r])
                            bins = [tb.binaries(x[r], np.arange(len(r) + 1) * x.shape[1]) for x in (u, value, keys)]
                            places = [tb.binaries(x[o[0] : o[-1]], o - o[0]) for x in (place, code)]
                            where = [pa.array(bucket[first[at : at + 5000]].astype(np.int32)), pa.array(np.full(len(r), d, np.int32))]
                            yield pa.RecordBatch.from_arrays([*where, part.column(0).take(take), part.column(2).take(take), *bins, *places], ["bucket", "d", "class", "size", "x", "v", "k", "place", "code"])

    def link(got: pa.Table) -> pa.Table:
        cls, size = (got.column(c).to_numpy() for c in ("class", "size"))
        shape = lambda c, t: tb.unbinaries(got.column(c), t)[0].reshape(len(cls), -1)
        x, value, keys = shape("x", np.float64), shape("v", np.float64), shape("k", np.uint64)
        place, offs = tb.unbinaries(got.column("place"), np.uint64)
        code, row = tb.unbinaries(got.column("code"), np.int64)[0], np.repeat(np.arange(len(cls)), np.diff(offs))
        order = np.argsort(place, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], place[order][1:] != place[order][:-1], [True]]))
        links, root, seen = np.zeros(len(place), np.int64), np.arange(len(place)), np.zeros(len(place), bool)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a < 2:
                continue
            own = order[a:b]
            r = row[own]
            i, j = _links_of_cell(x[r], value[r], keys[r], int(code[own[0]] // 4), code[own] % 4, least, threshold, reach)
            if len(i):
                links[own] += np.bincount(i, size[r][j], len(own)).astype(np.int64) + np.bincount(j, size[r][i], len(own)).astype(np.int64)
                root[own] = own[_roots(len(own), i, j)]
                seen[own[i]] = seen[own[j]] = True
        return pa.table({"class": cls[row[seen]], "links": links[seen], "other": cls[row[root[seen]]]})

    rows_of = "bucket int, d int, class long, size long, x binary, v binary, k binary, place binary, code binary"
    found = save(dealt.select("class", "vec", "size", "blocks").mapInArrow(deal, rows_of).groupBy("bucket", "d").applyInArrow(link, "class long, links long, other long"), "found")
    near = components(found, "class", "other")
    counted = found.groupBy("class").agg(F.sum("links").alias("links"))
    named = classes.join(near.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = named.join(lowest, "component").join(counted, "class", "left").select("class", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    linked = vectors.select("vec_id", "class").join(by_class, "class").select("vec_id", "n_links", "component_id")
    # rows without a usable vector
    unusable = F.col(vec_col).isNull() | (F.size(vec_col) == 0) | F.exists(vec_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists(vec_col, lambda v: v != 0)
    alone = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias(vec_col)).where(unusable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
