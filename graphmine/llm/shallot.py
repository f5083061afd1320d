"""Exact clustering around centroids in integers, by Shallot search.

Each vector remembers its nearest and second-nearest centroid, an upper bound of its distance to the
first and a lower bound of that to all others. After the centroids have moved, most vectors are
settled by the bounds. For the others both remembered centroids are measured, and the scan goes
through the neighbours of the closer one in order of their distance from it; it ends where they
are farther from that centroid than the ball reaches, and the ball shrinks with each
centroid found that is closer than the second-nearest. Bounds are floating-point numbers with a margin
for their rounding; whatever they can't rule out is compared in integers, so that the result is that of
comparing all.

Every round is one pass over a table of vectors and bounds, dealt as the input is: no vector is shuffled. What the
driver sees is the centroids' sums, of fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_saved, save, saved, tidy

#: Components of a vector, centroids, rounds, the factor of the integers and the seed of the first centroids.
DIM, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Larger integers are an error: squared distances would leave 64 bits.
LARGEST = 1 << 27
#: Share by which bounds are widened, above all rounding errors of a square root and of ROUNDS sums.
SLACK = 1e-9
#: Vectors that are compared at once.
BLOCK = 8192

STATE = "vec_id long, v binary, near int, second int, upper double, lower double, was int"


def integers(df: DataFrame, vec_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors with exactly dim components, none null or non-finite: floor(scale * x) as 32-bit little-endian integers.

    Others are left out. An integer of LARGEST or more in size is an error. Rows stay as they are
    dealt; null and repeated ids are rows of their own.
    """
    slim = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x")).where(F.size("x") == dim)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            sound = np.isfinite(flat).all(axis=1)  # a null component is a NaN here
            v = np.floor(scale * flat[sound])
            if v.size and np.abs(v).max() >= LARGEST:
                raise ValueError(f"a component is {LARGEST} or more in size after scaling")
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(sound)), pack(v.astype("<i4"))], ["vec_id", "v"])

    return slim.mapInArrow(scan, "vec_id long, v binary")


def pack(v: np.ndarray) -> pa.Array:
    """The rows of a matrix as binaries."""
    width = v.shape[1] * v.itemsize
    at = np.arange(len(v) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(v).tobytes())])


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a matrix of 64-bit integers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in integers."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """The centroids of a round, their neighbours in order of distance, and how far each has moved since the round before."""

    def __init__(self, c: np.ndarray, before: np.ndarray | None = None):
        self.c, k = c, len(c)
        apart = np.sqrt(np.stack([squares(c, row) for row in c]).astype(np.float64)) * (1 - SLACK)
        np.fill_diagonal(apart, -1.0)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        #: Half the way to the next centroid: what is closer than that is closer to no other.
        self.half = self.apart[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(squares(c, before).astype(np.float64)) * (1 + SLACK)
        #: The furthest move among all others than each.
        top = np.sort(moved)[::-1]
        self.moved, self.others = moved, np.where(np.arange(k) == np.argmax(moved), top[min(1, k - 1)], top[0])


def search(x: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, cs: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(near, second, upper, lower) for moved centroids; the nearest one is exact, of equally near ones the one with the smallest number.

    A vector without memory has second < 0.
    """
    near, second = near.copy(), second.copy()
    fresh = second < 0
    upper = np.where(fresh, np.inf, upper * (1 + SLACK) + cs.moved[near])
    lower = np.where(fresh, 0.0, np.maximum(lower * (1 - SLACK) - cs.others[near], 0.0))
    if len(cs.c) == 1:
        return near, second, upper, lower
    safe = np.maximum(lower, cs.half[near])
    open_ = np.flatnonzero(~(upper < safe))
    # the bound as it is now settles some more
    first = squares(x[open_], cs.c[near[open_]])
    upper[open_] = np.sqrt(first.astype(np.float64)) * (1 + SLACK)
    left = ~(upper[open_] < safe[open_])
    rows, d1 = open_[left], first[left]
    if not len(rows):
        return near, second, upper, lower
    xs, a = x[rows], near[rows]
    b = np.where(second[rows] < 0, cs.order[a, 0], second[rows])
    d2 = squares(xs, cs.c[b])
    swap = (d2 < d1) | ((d2 == d1) & (b < a))
    a, b, d1, d2 = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, remembered, reach = a.copy(), b.copy(), np.sqrt(d1.astype(np.float64)) * (1 + SLACK)
    active = np.arange(len(rows))
    for rank in range(cs.order.shape[1]):
        ball = reach[active] + np.sqrt(d2[active].astype(np.float64)) * (1 + SLACK)
        active = active[cs.apart[start[active], rank] <= ball]
        if not len(active):
            break
        j = cs.order[start[active], rank]
        other = j != remembered[active]  # that one is measured already
        at, j = active[other], j[other]
        d = squares(xs[at], cs.c[j])
        first_now = (d < d1[at]) | ((d == d1[at]) & (j < a[at]))
        next_now = ~first_now & ((d < d2[at]) | ((d == d2[at]) & (j < b[at])))
        f, s = at[first_now], at[next_now]
        b[f], d2[f] = a[f], d1[f]
        a[f], d1[f] = j[first_now], d[first_now]
        b[s], d2[s] = j[next_now], d[next_now]
    near[rows], second[rows] = a, b
    upper[rows], lower[rows] = np.sqrt(d1.astype(np.float64)) * (1 + SLACK), np.sqrt(d2.astype(np.float64)) * (1 - SLACK)
    return near, second, upper, lower


def first_centroids(rows: DataFrame, k: int, dim: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest lower-case hex SHA-256 of seed:id, in its order; equal ids by their components, null ids last."""
    hashed = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    got = hashed.orderBy(F.asc_nulls_last("h"), "v").limit(k).select("v").collect()  # k rows
    return np.array([np.frombuffer(r["v"], "<i4") for r in got], np.int64).reshape(-1, dim)


def _assign(state: DataFrame, cs: Centroids, dim: int) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(cs)  # k centroids

    def scan(batches):
        now = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                near, second = (part.column(i).to_numpy().astype(np.int64) for i in (2, 3))
                upper, lower = (part.column(i).to_numpy() for i in (4, 5))
                a, b, u, low = search(unpack(part.column(1), dim), near, second, upper, lower, now)
                was = np.where(second < 0, -1, near)  # a vector without memory has moved from nowhere
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(a, pa.int32()), pa.array(np.maximum(b, 0), pa.int32()), pa.array(u), pa.array(low), pa.array(was, pa.int32())], ["vec_id", "v", "near", "second", "upper", "lower", "was"])

    return state.mapInArrow(tidy(scan), STATE)


def _changes(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """By how much the centroids' sums and counts change with the vectors that have moved: a row for each task and centroid at most is gathered."""

    def scan(batches):
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            near, was = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 2))
            x = np.hstack([unpack(batch.column(0), dim), np.ones((batch.num_rows, 1), np.int64)])
            for j in np.unique(near):
                total[j] += x[near == j].sum(axis=0)
            for j in np.unique(was[was >= 0]):
                total[j] -= x[was == j].sum(axis=0)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row.tobytes() for row in total[some]], pa.binary())], ["cluster", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.frombuffer(b"".join(table.column("sums").to_pylist()), "<i8").reshape(-1, dim + 1).sum(axis=0)
        return pa.table({"cluster": table.column("cluster").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    moved = state.where("near <> was").select("v", "near", "was").mapInArrow(scan, "cluster int, sums binary")
    rows = moved.groupBy("cluster").applyInArrow(add, "cluster int, sums binary").collect()  # k rows
    out = np.zeros((k, dim + 1), np.int64)
    for r in rows:
        out[r["cluster"]] = np.frombuffer(r["sums"], "<i8")
    return out[:, :dim], out[:, dim]


def cluster(df: DataFrame, vec_col: str = "embedding", dim: int = DIM, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, v, cluster, distance), centroids): the vectors in integers, each with its nearest final centroid and the squared distance.

    The centroids start as `first_centroids`, or as all vectors where there are fewer than k. Each round assigns every
    vector to the nearest one (equally near: the smaller number) and puts every centroid with vectors at the
    floor of their mean; at the end vectors are assigned once more. An empty table gives no rows.
    """
    spark = df.sparkSession
    before = saved()
    rows = save(integers(df, vec_col, dim, scale), "integers")
    c = first_centroids(rows, k, dim, seed)
    if not len(c):
        return rows.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), c
    state = rows.select("vec_id", "v", F.lit(0).alias("near"), F.lit(-1).alias("second"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(-1).alias("was"))
    sums, counts, cs = np.zeros((len(c), dim), np.int64), np.zeros(len(c), np.int64), Centroids(c)
    for _ in range(rounds):
        state = save(_assign(state, cs, dim), "bounds")
        drop_saved(spark, before, state)
        more, n = _changes(state, len(c), dim)
        sums, counts = sums + more, counts + n
        c = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], c)
        cs = Centroids(c, cs.c)
    last = spark.sparkContext.broadcast(c)

    def measure(batches):
        for batch in batches:
            near = batch.column(2)
            d = squares(unpack(batch.column(1), dim), last.value[near.to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), near, pa.array(d, pa.int64())], ["vec_id", "v", "cluster", "distance"])

    return _assign(state, cs, dim).mapInArrow(measure, "vec_id long, v binary, cluster int, distance long"), c


def centroid_clusters(df: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that `integers` keeps; others have no row.

    Equal vectors get equal rows but for their ids; null and repeated ids are rows of their own; further
    columns are ignored. Sums beyond 64 bits are an error.
    """
    before = saved()
    found, c = cluster(df)
    rows = save(found.select("vec_id", "cluster", "distance"), "clusters")
    drop_saved(df.sparkSession, before, rows)
    digests = [(i, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(c.tolist())]
    named = df.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # one row for each centroid
    each = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    both = each.crossJoin(each.agg(F.sum("s").alias("t"))).select("cluster", F.col("s").cast("long").alias("cluster_inertia"), F.col("t").cast("long").alias("inertia")).join(named, "cluster")
    return rows.join(F.broadcast(both), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
