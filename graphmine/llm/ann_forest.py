"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

Each inner node of a tree splits by a random direction, the difference of two drawn
vectors, at the median. The trees are fitted on a bounded sample. Below a leaf of the sample
come further splits, as many as the table's size asks for, so that a leaf holds a bounded
number of vectors at any size: each is a random direction, cut at the median of the
leaf's sampled vectors. Every vector is put into its leaf of each tree.

A query walks all trees through one shared priority queue: a branch's priority is the
smallest margin on the way to it, negative on the far side of a split. The first `visits`
leaves that leave the queue are searched, and the candidates there are ranked exactly.

`visits` is calibrated: the true neighbours of sampled queries among all vectors are found by
brute force, and the smallest number of leaves is taken that meets `recall` of them.

Vectors of one length form an index of their own, fitted and calibrated on vectors of that length. A length of at most WHOLE vectors,
and any beyond the MOST_FORESTS commonest, has no forest: its queries are compared with all of its vectors, in blocks.
So are queries that find fewer than k in the leaves they visit.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbuf as tb
from .embedding_dedup import by_length, clean_vectors, unit
from .shared import save

#: Vectors the trees are fitted on at most, trees, and vectors a leaf has about.
SAMPLE, TREES, LEAF = 20_000, 6, 40
#: Sampled queries of each length's calibration, and leaves that it lets one of them visit at most.
QUERIES, MOST_VISITS = 100, 50_000
#: Vectors of a length that is searched whole, and of a block where that is dealt; lengths that have forests at most; sampled vectors of each at least.
WHOLE, MOST_FORESTS, LEAST = 4096, 16, 2000


@dataclass
class Forest:
    """Nodes of all trees in one array: direction, cut, children (below 0: leaf -1 - child). Below each leaf: `deep` splits of all its vectors."""

    roots: np.ndarray
    direction: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    deep_direction: np.ndarray
    deep_cut: np.ndarray
    visits: int = 0

    @property
    def deep(self) -> int:
        return self.deep_direction.shape[1]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree: the tree's leaf, and a bit for each split below it."""
        out = np.zeros((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            live = np.flatnonzero(at >= 0)
            while len(live):
                node = at[live]
                right = (np.einsum("nd,nd->n", x[live], self.direction[node]) >= self.cut[node]).astype(np.int64)
                at[live] = self.child[node, right]
                live = live[at[live] >= 0]
            leaf = -1 - at
            code = leaf << self.deep
            for j in range(self.deep):
                code |= (np.einsum("nd,nd->n", x, self.deep_direction[leaf, j]) >= self.deep_cut[leaf, j]).astype(np.int64) << j
            out[:, t] = code
        return out

    def queue(self, x: np.ndarray, margin: np.ndarray):
        """Yield the leaves for one vector in the order of the shared queue; margin: its margin at each node."""
        heap = [(-math.inf, i, int(root), 0, None) for i, root in enumerate(self.roots)]
        heapq.heapify(heap)
        turn = len(heap)
        while heap:
            p, _, at, flips, near = heapq.heappop(heap)
            if at >= 0:
                for side, sign in ((0, -1.0), (1, 1.0)):
                    turn += 1
                    heapq.heappush(heap, (max(p, -sign * margin[at]), turn, int(self.child[at, side]), 0, None))
                continue
            leaf = -1 - at
            if near is None:
                m = self.deep_direction[leaf] @ x - self.deep_cut[leaf]
                order = np.argsort(np.abs(m), kind="stable")
                near = (int(((m >= 0).astype(np.int64) << np.arange(self.deep)).sum()), np.abs(m)[order].tolist(), [1 << int(j) for j in order])
            home, size, bit = near
            if not flips:
                yield leaf << self.deep | home
            else:  # all ways to flip splits up to this one, and this one
                for some in range(1 << (flips - 1)):
                    code = home ^ bit[flips - 1]
                    for j in range(flips - 1):
                        if some >> j & 1:
                            code ^= bit[j]
                    yield leaf << self.deep | code
            if flips < self.deep:
                turn += 1
                heapq.heappush(heap, (max(p, size[flips]), turn, at, flips + 1, near))

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.direction.T - self.cut if len(self.cut) else np.zeros((len(x), 0))


def fit(x: np.ndarray, leaf: int, deep: int = 0, trees: int = TREES, seed: int = 3) -> Forest:
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    direction, cut, child, roots, below, below_cut = [], [], [], [], [], []
    for _ in range(trees):
        todo = [(np.arange(len(x)), None, 0)]
        first = None
        while todo:
            rows, parent, side = todo.pop(0)
            name = None
            if len(rows) > leaf:
                for _try in range(3):
                    a, b = x[rng.choice(rows, 2, replace=False)]
                    v = a - b
                    if np.abs(v).max() > 0:
                        v = v / np.sqrt((v * v).sum())
                        value = x[rows] @ v
                        c = np.median(value)
                        right = value >= c
                        if right.any() and not right.all():
                            name = len(cut)
                            direction.append(v)
                            cut.append(c)
                            child.append([0, 0])
                            todo += [(rows[~right], name, 0), (rows[right], name, 1)]
                            break
            if name is None:
                name = -1 - len(below)
                v = rng.normal(size=(deep, d)) / math.sqrt(d)
                below.append(v)
                below_cut.append(np.median(x[rows] @ v.T, axis=0) if deep else np.zeros(0))
            if parent is None:
                first = name
            else:
                child[parent][side] = name
        roots.append(first)
    return Forest(np.array(roots), np.array(direction).reshape(-1, d), np.array(cut), np.array(child, np.int64).reshape(-1, 2), np.array(below).reshape(len(below), deep, d), np.array(below_cut).reshape(len(below), deep))


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The cosines of the rows of x with q, in double precision. Powers of two keep squares in range and change no digit."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    q = np.ldexp(q, -np.frexp(np.abs(q).max())[1])
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def calibrate(forest: Forest, asked: np.ndarray, true: list[np.ndarray], recall: float) -> int:
    """The smallest number of leaves that meets the asked part of the true neighbours (unit rows of `true`) of the asked vectors."""
    at = []
    for q, margin, near in zip(asked, forest.margins(asked), true, strict=True):
        left = [set(r) for r in forest.leaves(near).tolist()]
        for i, leaf in enumerate(forest.queue(q, margin)):
            found = [s for s in left if leaf in s]
            at += [i + 1] * len(found)
            left = [s for s in left if leaf not in s]
            if not left or i + 1 >= MOST_VISITS:
                break
        at += [MOST_VISITS] * len(left)
    return int(np.sort(at)[max(0, math.ceil(recall * len(at)) - 1)]) if at else 1


def _nearest_of_all(entries: DataFrame, asked: dict[int, np.ndarray], k: int) -> dict[int, list[np.ndarray]]:
    """By brute force, the k nearest other vectors of each of the sampled ones (by length: unit rows)."""
    spark = entries.sparkSession
    shared = spark.sparkContext.broadcast(asked)  # at most QUERIES vectors

    def scan(batches):
        best: dict[tuple[int, int], list] = {}
        for batch in batches:
            for d, _, x in by_length(batch.column(0)):
                if d not in shared.value:
                    continue
                u = unit(x)
                score = shared.value[d] @ u.T
                score[score > 1 - 1e-12] = -2  # the vector itself
                take = min(k, len(u))
                for i, top in enumerate(np.argpartition(-score, take - 1, axis=1)[:, :take].tolist()):
                    held = best.setdefault((d, i), [])
                    held += [(float(score[i, j]), u[j].tobytes()) for j in top if score[i, j] > -2]
                    held.sort(reverse=True)
                    del held[k:]
        rows = [(d, i, s, v) for (d, i), held in best.items() for s, v in held]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.binary()), strict=True)], ["d", "i", "score", "vec"])

    found = entries.select("vec").mapInArrow(scan, "d long, i long, score double, vec binary")
    order = Window.partitionBy("d", "i").orderBy(F.desc("score"), "vec")
    top = found.withColumn("r", F.row_number().over(order)).where(f"r <= {k}").select("d", "i", "vec").collect()  # QUERIES x k rows at most
    out = {d: [[] for _ in q] for d, q in asked.items()}
    for r in top:
        out[r["d"]][r["i"]].append(np.frombuffer(r["vec"], np.float64))
    return {d: [np.array(v).reshape(-1, d) for v in rows] for d, rows in out.items()}


def build(entries: DataFrame, lengths: dict[int, int], k: int, recall: float, seed: int = 9) -> dict[int, Forest]:
    """A calibrated forest for each length in `lengths` (length: vectors); its sample follows its share, LEAST at least."""
    total, rng = sum(lengths.values()), np.random.default_rng(seed)
    forests, asked = {}, {}
    for d, n in lengths.items():
        size = min(n, max(LEAST, SAMPLE * n // total))
        rows = entries.where(F.length("vec") == 8 * d).orderBy(F.xxhash64("class"), "class").limit(size).select("vec").collect()  # at most SAMPLE rows
        x = unit(np.frombuffer(b"".join(bytes(r["vec"]) for r in rows), np.float64).reshape(-1, d))
        forests[d] = fit(x, LEAF if n > SAMPLE else min(LEAF, max(4, len(x) // 16)), max(0, math.ceil(math.log2(n / len(x)))))
        asked[d] = x[rng.choice(len(x), min(len(x), QUERIES), replace=False)]
    if forests:
        true = _nearest_of_all(entries, asked, k)
        for d, forest in forests.items():
            forest.visits = calibrate(forest, asked[d], true[d], recall)
    return forests


def nearest(table: DataFrame, query_every: int = 50, k: int = 5, recall: float = 0.96, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by query_every.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    with a null id. Equal vectors are one entry of the index, with the k + 1 smallest ids; all
    of these can be results. Rows with equal ids are one query and one candidate, at the
    best score that any of their vectors reaches. Ties go to the smaller id before
    anything is cut. Vectors of different lengths never meet. Further columns are ignored;
    an empty table gives an empty result.
    """
    spark = table.sparkSession
    vectors = save(clean_vectors(table.where(F.col(id_col).isNotNull()), id_col, vec_col).dropDuplicates(["vec_id", "class"]), "vectors")
    # Spark keeps the first k + 1 rows of a class before it shuffles, so a very common vector loads no task
    order = Window.partitionBy("class").orderBy("vec_id")
    some = vectors.withColumn("r", F.row_number().over(order)).where(f"r <= {k + 1}")
    entries = save(some.groupBy("class").agg(F.min_by("vec", "r").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # a number for each length of more than WHOLE vectors
    large = {r["d"]: r["n"] for r in entries.groupBy((F.length("vec") / 8).cast("int").alias("d")).agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).collect()}
    common = dict(sorted(large.items(), key=lambda x: (-x[1], x[0]))[:MOST_FORESTS])
    shared = spark.sparkContext.broadcast(build(entries, common, k, recall))  # bounded by SAMPLE, LEAST, MOST_FORESTS, TREES and the log of n
    parts = {d: -(-m // WHOLE) for d, m in large.items()}
    blocks = max(24, n * TREES // 20_000)

    def name(d: int, leaf: np.ndarray) -> np.ndarray:
        """A number for the leaf of an index."""
        return tb.mix(tb.mix(leaf.astype(np.uint64)) + np.uint64(d)).view(np.int64)

    def leaves_of(d: int, u: np.ndarray, cls: np.ndarray) -> np.ndarray:
        forest = shared.value.get(d)
        return forest.leaves(u) if forest else whole_of(d, cls)

    def whole_of(d: int, cls: np.ndarray) -> np.ndarray:
        """The part of a length's vectors that a class is in, where all are searched."""
        return (tb.mix(cls.view(np.uint64)) % np.uint64(parts.get(d, 1))).astype(np.int64)[:, None]

    block_of = lambda leaf: (leaf.view(np.uint64) % np.uint64(blocks)).astype(np.int32)

    def index(batches, exact=False):
        for batch in batches:
            cls = batch.column(0).to_numpy()
            for d, rows, x in by_length(batch.column(1)):
                leaf = name(d, whole_of(d, cls[rows]) if exact else leaves_of(d, unit(x), cls[rows]))
                row = np.repeat(np.arange(len(x)), leaf.shape[1])
                take = pa.array(rows[row])
                yield pa.RecordBatch.from_arrays([pa.array(block_of(leaf.ravel())), pa.array(leaf.ravel()), *(batch.column(i).take(take) for i in range(3))], ["block", "leaf", "class", "vec", "ids"])

    places = "block int, leaf long, class long, vec binary, ids array<long>"
    indexed = entries.select("class", "vec", "ids").mapInArrow(index, places)
    queries = vectors.where(F.col("vec_id") % query_every == 0).select("vec_id", "vec")

    def search(batches, exact=False):
        for batch in batches:
            out: list[list] = [[], [], []]
            for d, rows, x in by_length(batch.column(1)):
                forest, u = None if exact else shared.value.get(d), unit(x)
                for lo in range(0, len(u), 256):
                    margins = forest.margins(u[lo : lo + 256]) if forest else None
                    for i in range(lo, min(lo + 256, len(u))):
                        codes = [leaf for _, leaf in zip(range(forest.visits), forest.queue(u[i], margins[i - lo]), strict=False)] if forest else range(parts.get(d, 1))
                        leaves = name(d, np.array(codes, np.int64))
                        block = block_of(leaves)
                        by = np.argsort(block, kind="stable")
                        some, cut = np.unique(block[by], return_index=True)
                        for b, part in zip(some.tolist(), np.split(leaves[by], cut[1:]), strict=True):
                            out[0].append(b)
                            out[1].append(rows[i])
                            out[2].append(part.tobytes())
            take = pa.array(out[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), batch.column(0).take(take), batch.column(1).take(take), pa.array(out[2], pa.binary())], ["block", "query_id", "q", "leaves"])

    visits = "block int, query_id long, q binary, leaves binary"
    asked = queries.mapInArrow(search, visits)

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        leaf = right.column("leaf").to_numpy()
        by = np.argsort(leaf, kind="stable")
        cls = right.column("class").to_numpy()
        values, offs = tb.unbinaries(right.column("vec"), np.float64)
        ids = right.column("ids").to_pylist()
        blob = [np.frombuffer(b.as_buffer(), np.int64) for b in left.column("leaves")]
        vec = [np.frombuffer(b.as_buffer(), np.float64) for b in left.column("q")]
        found: tuple[list, list, list] = ([], [], [])
        for i, (wanted, q) in enumerate(zip(blob, vec, strict=True)):
            a, b = np.searchsorted(leaf[by], wanted), np.searchsorted(leaf[by], wanted, "right")
            rows = np.concatenate([by[s:e] for s, e in zip(a, b, strict=True)])
            rows = rows[np.diff(offs)[rows] == len(q)]  # other lengths by a chance agreement of names
            if not len(rows):
                continue
            _, first = np.unique(cls[rows], return_index=True)
            rows = rows[first]
            score = exact_scores(values[(offs[rows][:, None] + np.arange(len(q))).ravel()].reshape(-1, len(q)), q)
            # the best entries with all that tie with the last of them, until k ids beside the query's own are certain
            near, m = np.argsort(-score, kind="stable"), k + 1
            while True:
                mine = near[score[near] >= score[near[min(m, len(near)) - 1]]]
                met: dict[int, float] = {}
                for s, v in sorted((-score[j], v) for j in mine.tolist() for v in ids[rows[j]]):
                    met.setdefault(v, -s)
                if len(met) > k or len(mine) == len(near):
                    break
                m *= 2
            top = list(met.items())[: k + 1]
            found[0].extend([i] * len(top))
            found[1].extend(v for v, _ in top)
            found[2].extend(s for _, s in top)
        return pa.table({"query_id": left.column("query_id").take(pa.array(found[0], pa.int64())), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    scores = "query_id long, vec_id long, score double"
    found = save(asked.groupBy("block").cogroup(indexed.groupBy("block")).applyInArrow(rank, scores).where("vec_id <> query_id"), "found")
    # queries of the lengths with forests that found fewer than k are compared with all
    full = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    short = save(queries.where((F.length("vec") / 8).isin(*common)).join(full, "vec_id", "left_anti").select("vec_id", "vec"), "short") if common else None
    if short is not None and not short.isEmpty():
        again = short.mapInArrow(lambda batches: search(batches, True), visits)
        everything = entries.select("class", "vec", "ids").mapInArrow(lambda batches: index(batches, True), places)
        found = found.union(again.groupBy("block").cogroup(everything.groupBy("block")).applyInArrow(rank, scores).where("vec_id <> query_id"))
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
