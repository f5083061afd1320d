"""Exact n-gram Jaccard self-join by filtering under several global token orders.

A document is the set of its distinct k-word shingles. Any global order of the
shingles gives a filter: two sets with a Jaccard similarity of t share one of
the first n - ceil(t n) + 1 shingles of each (their prefixes). Here a pair must
share one under each of two orders. Both put frequent shingles last, by the level of
their count, and differ in the order within a level.

The jobs:

1. `_profile` reads the texts once: each row's set size and set hash (equal sets form one
   class, of which one copy goes on), the classes' sets as packed 40-bit hashes, and a
   count table of fixed size for the levels.
2. `_stars` merges what is plainly alike: classes with the same lowest shingle under one of
   a few random orders are compared with one of them, by their parity sketches and then, where
   these allow the similarity, by the whole sets. The links found make components; what follows
   looks only for links between these, so a group of near copies makes no pair for each two of its members.
3. `_prefixes` deals the prefix shingles of each order to buckets, as packed arrays, and
   `_live` keeps the lists of classes of different components that share one, each list once.
4. `_clusters` meets the classes of each list and order. Two are candidates if their sizes
   fit, and the distance of their parity sketches, a lower bound of the number of shingles that
   only one of them has: neither test loses a link. No row is made for a pair: each task gives
   a spanning forest of its candidates, and classes that hang together under both orders
   are a cluster.
5. `_compare_clusters` compares the whole sets within each cluster, in blocks if it is large.
   Only links that span its components leave a task.

Shingles are compared by 64-bit hashes, in verification by 40 bits of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .components import components
from .shared import SLICES, IdFilter, combine_slices, discard, release, save, slices_of, sweep, tidy
from .wordcode import gather

#: Entries of the table of shingle counts, of fixed size whatever the input.
TABLE_BITS = 21
#: Levels of the counts.
LEVELS = 15
#: Prefix shingles that a bucket holds about; a shingle of more classes is dealt to several.
BUCKET_ROWS = 1_500_000
#: Classes of one shingle that meet in one place.
BLOCK = 4096
#: Postings that meet in a task of the pair search, about.
MEET_ROWS = 50_000
#: Pairs that are held at once.
STEP = 400_000
#: Bytes of sets in a task of the verification, about, and pairs of one class there at most.
BUCKET_BYTES, FAN = 8 << 20, 256
#: Classes and bytes of sets of a cluster's block, about.
CLASSES, CLASS_BYTES = 2048, 4 << 20
ORDERS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)
STARS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)
_SKETCH = np.uint64(0x452821E638D01377)
#: Bits of the largest sketch: it tells unlike sets of up to some 50,000 shingles apart.
_WIDE = 1 << 15
_SEEN = 1 << 20


@dataclass
class Joined:
    """rows: doc_id, n_shingles, component_id for each input row. links: pairs of class ids (node_a, node_b) verified, enough to span every component.

    members: doc_id, node and component (class ids) of each row with words.
    """

    rows: DataFrame
    links: DataFrame
    members: DataFrame


def _sets(column, k: int):
    """(first row, last row, distinct shingle hashes, offsets) of chunks of texts."""
    for lo, hi, data, offs in tb.chunks(column):
        s, e, w = tb.words(data, offs)
        v, o = tb.distinct_in_rows(*tb.shingle_hashes(tb.span_hashes(data, s, e, lower=True), w, k))
        yield lo, hi, v, o


def _nodes(v: np.ndarray, o: np.ndarray) -> np.ndarray:
    """One hash for each set; it depends on the set alone."""
    sums = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(tb.mix(v + np.uint64(0x51ED270B)), out=sums[1:])
    return tb.mix(sums[o[1:]] - sums[o[:-1]] + np.diff(o).astype(np.uint64)).view(np.int64)


def _pack(v: np.ndarray) -> np.ndarray:
    """The upper 40 bits of each hash, as bytes."""
    return np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, 3:])


def _unpack(data: np.ndarray) -> np.ndarray:
    eight = np.zeros((len(data) // 5, 8), np.uint8)
    eight[:, 3:] = data.reshape(-1, 5)
    return eight.view(np.uint64).ravel()


def _sketches(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set, how many shingles fall on each of m places, modulo 2, as packed bits; m is a power of two that follows the set's size."""
    m = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 64, _WIDE)
    base = np.concatenate([[0], np.cumsum(m)])
    place = (tb.mix(v ^ _SKETCH) & np.repeat(m - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(base[:-1], n)
    return np.packbits(np.bincount(place, minlength=base[-1]).astype(np.uint8) & 1, bitorder="little"), base // 8


_PROFILE = "doc_id long, node long, n int, set binary, sketch binary, lows array<long>, slice int, counts binary"


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document; the first of each class in a task brings the set, its sketch and its lowest shingles. Rows with a slice hold counts."""

    def scan(batches):
        table = np.zeros(1 << TABLE_BITS, np.uint32)
        seen: set[int] = set()
        names = [c.split()[0] for c in _PROFILE.split(", ")]
        for batch in batches:
            for lo, hi, v, o in _sets(batch.column(1), k):
                node, n = _nodes(v, o), np.diff(o)
                fresh = np.zeros(hi - lo, bool)
                for i in np.flatnonzero(n):
                    if (key := int(node[i])) not in seen:
                        fresh[i] = True
                        if len(seen) < _SEEN:
                            seen.add(key)
                packed = _pack(v)
                v, n1 = _unpack(packed.ravel())[np.repeat(fresh, n)], n[fresh]
                np.add.at(table, (v >> np.uint64(64 - TABLE_BITS)).astype(np.int64), 1)
                cols: list = [batch.column(0).slice(lo, hi - lo), pa.array(node, mask=n == 0), pa.array(n.astype(np.int32))]
                bits, at = _sketches(v, n1)
                first = np.cumsum(n1) - n1
                lows = np.stack([np.minimum.reduceat(tb.mix(v ^ np.uint64(s)), first) for s in STARS], 1) if len(n1) else np.zeros((0, len(STARS)), np.uint64)
                where = pa.array(np.cumsum(fresh) - 1, mask=~fresh)
                for values in (tb.binaries(_pack(v).ravel(), np.concatenate([[0], 5 * np.cumsum(n1)])), tb.binaries(bits, at), pa.FixedSizeListArray.from_arrays(pa.array(lows.view(np.int64).ravel()), len(STARS)).cast(pa.list_(pa.int64()))):
                    cols.append(values.take(where))
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())], names)
        if table.any():
            blobs = slices_of(np.minimum(table, 65535).astype(np.uint16))
            empty = [pa.nulls(SLICES, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], names)

    return save(docs.mapInArrow(tidy(scan), _PROFILE), "profile")


def _levels(profile: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The level of each entry of the count table, and the number of parts that the shingles of very large entries are dealt to."""
    mean = total / (1 << TABLE_BITS)

    def level(counts: np.ndarray) -> np.ndarray:
        above = np.maximum(counts - mean, 0) / (2 * np.sqrt(mean) + 2)
        parts = np.minimum(-(-counts // BUCKET_ROWS), 1 << 16)
        return np.minimum(2 * np.log2(1 + above), LEVELS).astype(np.uint32) | np.where(parts > 1, parts, 0).astype(np.uint32) << np.uint32(4)

    got = combine_slices(profile.where("slice is not null"), "slice", "counts", "uint16", "sum", level)
    if not len(got):
        got = np.zeros(1 << TABLE_BITS, np.uint32)
    hot = np.flatnonzero(got >> 4)
    return (got & 15).astype(np.uint8), np.stack([hot, got[hot] >> 4], 1).astype(np.int64)


def _stars(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y, nx, ny): each class y with the least class x of those that share one of its lowest shingles."""
    heads = sets.select("node", "n", F.posexplode("lows").alias("i", "low"))
    least = heads.groupBy("i", "low").agg(F.min(F.struct("node", "n")).alias("x"), F.max("node").alias("last")).where("last <> x.node").drop("last")
    pairs = heads.join(least, ["i", "low"]).where(F.col("node") != F.col("x.node"))
    pairs = pairs.select("x.node", F.col("node").alias("y"), F.col("x.n").alias("nx"), F.col("n").alias("ny")).withColumnRenamed("node", "x")
    return pairs.where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")).distinct()


def _prefixes(sets: DataFrame, percent: int, levels, buckets: int) -> DataFrame:
    """Packed postings by order and bucket: classes, the components of those that aren't their own, and keys and classes of the prefix shingles."""

    def scan(batches):
        level, hot = levels.value
        parts = dict(hot.tolist())
        held: list = []

        def flush():
            node, comp = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            base = np.cumsum([0] + [len(h[0]) for h in held])
            for order in range(len(ORDERS)):
                key = np.concatenate([h[2][order][0] for h in held])
                row = np.concatenate([h[2][order][1] + b for h, b in zip(held, base, strict=False)])
                key, row = _split(key, row, node, parts)
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                some, cut = np.unique(bucket[by], return_index=True)
                out = []
                for i, mine in zip(some.tolist(), np.split(by, cut[1:]), strict=True):
                    own, local = np.unique(row[mine], return_inverse=True)
                    kind = np.uint16 if len(own) < 1 << 16 else np.uint32
                    moved = np.flatnonzero(comp[own] != node[own])
                    out.append((order, i, node[own].tobytes(), moved.astype(kind).tobytes(), comp[own[moved]].tobytes(), (key[mine] >> np.uint64(32)).astype(np.uint32).tobytes(), local.astype(kind).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int32()] + [pa.binary()] * 5, strict=True)], ["ord", "bucket", "nodes", "moved", "comps", "keys", "rows"])
            held.clear()

        pending = 0
        for batch in batches:
            node, comp, blob = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            size = np.array([len(b.as_buffer()) for b in blob]) // 5
            for lo, hi in _steps(size, 1 << 18):
                data, at = tb.unbinaries(blob.slice(lo, hi - lo), np.uint8)
                v, n = _unpack(data), np.diff(at) // 5
                row = np.repeat(np.arange(hi - lo), n)
                first = np.cumsum(n) - n
                length = n - -(-n * percent // 100) + 1
                orders = []
                for salt in ORDERS:
                    rank = tb.mix(v ^ np.uint64(salt)) >> np.uint64(4) | level[v >> np.uint64(64 - TABLE_BITS)].astype(np.uint64) << np.uint64(60)
                    by = np.argsort(rank)
                    by = by[np.argsort(row[by].astype(np.uint16) if hi - lo < 1 << 16 else row[by], kind="stable")]
                    head = np.arange(len(by)) - first[row] < length[row]
                    orders.append((v[by[head]], row[head]))
                held.append((node[lo:hi], comp[lo:hi], orders))
                pending += len(orders[0][0])
                if pending >= 500_000:
                    yield from flush()
                    pending = 0
        if held:
            yield from flush()

    return sets.select("node", "comp", "set").mapInArrow(tidy(scan), "ord int, bucket int, nodes binary, moved binary, comps binary, keys binary, rows binary")


def _steps(size: np.ndarray, most: int):
    """Consecutive ranges of rows with about `most` in sum; a larger row is alone."""
    at = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def _split(key: np.ndarray, row: np.ndarray, node: np.ndarray, parts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys to deal by. A shingle of very many classes is dealt in parts by class, and each two parts meet under a key of their own."""
    keys, rows = [], []
    rest = np.ones(len(key), bool)
    if parts:
        entry = (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        for e, p in parts.items():
            mine = np.flatnonzero(entry == e)
            if len(mine):
                rest[mine] = False
                part = (tb.mix(node[row[mine]].view(np.uint64)) % np.uint64(p)).astype(np.int64)
                for other in range(p):
                    both = np.minimum(part, other) * p + np.maximum(part, other) + 1
                    keys.append(tb.mix(key[mine] ^ tb.mix(both.astype(np.uint64))))
                    rows.append(row[mine])
    return np.concatenate([tb.mix(key[rest]), *keys]), np.concatenate([row[rest], *rows])


def _live(table: pa.Table) -> pa.Table:
    """The lists of classes of a bucket's shingles that classes of different components share.

    The classes of a shingle of over BLOCK are cut into blocks by component; each two
    blocks make a list, but for those that hold one and the same component.
    """
    get = {c: [np.frombuffer(b.as_py(), t) for b in table.column(c)] for c, t in (("nodes", np.int64), ("comps", np.int64), ("keys", np.uint32))}
    rows = [np.frombuffer(b.as_py(), f"u{len(b.as_py()) // len(k)}").astype(np.int64) for b, k in zip(table.column("rows"), get["keys"], strict=True)]
    base = np.cumsum([0] + [len(x) for x in get["nodes"]])
    node, at, back = np.unique(np.concatenate(get["nodes"]), return_index=True, return_inverse=True)
    comp = np.concatenate(get["nodes"])
    for b, moved, to in zip(base, table.column("moved"), get["comps"], strict=False):
        if len(to):
            comp[b + np.frombuffer(moved.as_py(), f"u{len(moved.as_py()) // len(to)}").astype(np.int64)] = to
    _, comp = np.unique(comp[at], return_inverse=True)
    # classes in the order of their components, so that a shingle's classes are sorted alike
    turn = np.argsort(comp, kind="stable")
    node, comp, place = node[turn], comp[turn], np.argsort(turn)
    both = np.concatenate(get["keys"]).astype(np.uint64) << np.uint64(32) | place[back[np.concatenate([r + b for r, b in zip(rows, base, strict=False)])]].astype(np.uint64)
    both = np.unique(both)
    key, doc = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    several = comp[doc[first]] != comp[doc[first + count - 1]]
    keep = np.repeat(several & (count <= BLOCK), count)
    docs, counts = [doc[keep]], [count[several & (count <= BLOCK)]]
    for f, c in zip(first[several & (count > BLOCK)].tolist(), count[several & (count > BLOCK)].tolist(), strict=True):
        blocks = np.array_split(doc[f : f + c], -(-c // BLOCK))
        ends = [(comp[b[0]], comp[b[-1]]) for b in blocks]
        for i, a in enumerate(blocks):
            for j in range(i, len(blocks)):
                if ends[i][0] != ends[j][1]:
                    docs.append(np.concatenate([a, blocks[j]]) if i < j else a)
                    counts.append(np.array([len(docs[-1])]))
    doc, count = np.concatenate(docs), np.concatenate(counts)
    # many shingles have the same classes: one list for all of them
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(node[doc].view(np.uint64)))])
    at = np.concatenate([[0], np.cumsum(count)])
    name, one = np.unique(tb.mix(sums[at[1:]] - sums[at[:-1]] + count.astype(np.uint64)), return_index=True)
    members, offs = gather(node[doc], at[one], count[one])
    return pa.table({"ord": pa.array(np.full(len(name), table.column("ord")[0].as_py(), np.int32)), "list": pa.array(name.view(np.int64)), "nodes": pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(members))})


def _near(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """Edges (x, y) that span what hangs together: classes of different components that share a list, whose sizes and sketches allow the similarity.

    left: a place's lists (list, node); right: its classes (class, comp, n, sketch). Classes that `right` lacks have no partner.
    """
    nothing = pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64())})
    if not left.num_rows or not right.num_rows:
        return nothing
    node, at = np.unique(right.column("class").to_numpy(), return_index=True)
    comp, n = right.column("comp").to_numpy()[at], right.column("n").to_numpy()[at].astype(np.int64)
    data, offs = tb.unbinaries(right.column("sketch").combine_chunks().take(pa.array(at)), np.uint8)
    key, member = left.column("list").to_numpy(), left.column("node").to_numpy()
    doc = np.minimum(np.searchsorted(node, member), len(node) - 1)
    key, doc = key[node[doc] == member], doc[node[doc] == member]
    if not len(doc):
        return nothing
    m = np.diff(offs) * 8
    # the sketches at least as wide as each width, folded to it: (row of each class, sketches)
    sketch: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    before = None
    for size in (_WIDE >> i for i in range(_WIDE.bit_length() - 6)):
        some = np.flatnonzero(m >= size)
        line = np.full(len(node), -1)
        line[some] = np.arange(len(some))
        words = np.zeros((len(some), size // 64), np.uint64)
        if before is not None:
            words[line[before[0]]] = before[1][:, : size // 64] ^ before[1][:, size // 64 :]
        own = np.flatnonzero(m == size)
        words[line[own]] = data[(offs[:-1][own][:, None] + np.arange(size // 8)).ravel()].view(np.uint64).reshape(-1, size // 64)
        before = (some, words)
        sketch[size] = (line, words)
    by = np.lexsort((n[doc], key))
    key, doc = key[by], doc[by]
    size = n[doc]
    # the last posting of each one's key whose set isn't too large
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    wide = int(size.max()) + 1
    last = np.searchsorted(group * wide + size, group * wide + np.minimum(100 * size // percent, wide - 1), "right")
    many = last - np.arange(len(key)) - 1
    root = np.arange(len(node))
    for lo, hi in _steps(many, STEP):
        i = np.repeat(np.arange(lo, hi), many[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi])
        x, y = doc[i], doc[j]
        apart = (comp[x] != comp[y]) & (root[x] != root[y])
        x, y = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        one = np.unique(x * len(node) + y)
        x, y = one // len(node), one % len(node)
        level = np.minimum(m[x], m[y])
        ok = np.zeros(len(x), bool)
        for lev in np.unique(level):
            mine = np.flatnonzero(level == lev)
            line, words = sketch[int(lev)]
            for at in range(0, len(mine), max(1, (64 << 20) // int(lev))):
                p, q = x[mine[at : at + max(1, (64 << 20) // int(lev))]], y[mine[at : at + max(1, (64 << 20) // int(lev))]]
                apart = np.bitwise_count(words[line[p]] ^ words[line[q]]).sum(1, dtype=np.int64)
                ok[mine[at : at + len(p)]] = (100 + percent) * apart <= (100 - percent) * (n[p] + n[q])
        root = _merged(root, x[ok], y[ok])
    moved = np.flatnonzero(root != np.arange(len(node)))
    return pa.table({"x": pa.array(node[root[moved]]), "y": pa.array(node[moved])})


def _merged(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest vertex reachable, given that of before and more edges."""
    while True:
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, root[p], low)
        np.minimum.at(new, root[q], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _clusters(sets: DataFrame, links: DataFrame, percent: int, profile: DataFrame, total: int) -> DataFrame:
    """(node, n, comp, cluster): classes that hang together by candidates under both orders, in clusters of several components."""
    spark = sets.sparkSession
    comps = save(components(links, "x", "y").select(F.col("id").alias("node"), F.col("component").alias("comp")), "comps")
    buckets = max(12, -(-total * (100 - percent) // 100 // BUCKET_ROWS))
    named = sets.select("node", "set").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    packed = _prefixes(named, percent, spark.sparkContext.broadcast(_levels(profile, total)), buckets)
    lists = save(packed.groupBy("ord", "bucket").applyInArrow(lambda t: _released(_live(t)), "ord int, list long, nodes array<long>"), "lists")
    sweep(spark)
    live = save(lists.dropDuplicates(["ord", "list"]).select("ord", "list", F.explode("nodes").alias("node")), "live")
    discard(lists)
    # a class with no such shingle under one of the orders has no partner
    both = live.groupBy("node").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).where("a < b").select("node")
    info = sets.select("node", "n", "sketch").dropDuplicates(["node"]).join(both, "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    info = save(info, "info")
    first = components(_met(live.where("ord = 0").join(both, "node"), info, percent), "x", "y").select(F.col("id").alias("node"), F.col("component").alias("c0"))
    first = save(first, "first")
    # under the second order only classes that hang together under the first one meet
    second = components(_met(live.where("ord = 1").join(first.select("node"), "node"), info, percent), "x", "y").select(F.col("id").alias("node"), F.col("component").alias("c1"))
    cell = first.join(second, "node").select("node", F.xxhash64("c0", "c1").alias("cluster"))
    out = save(cell.join(info.select("node", "n", "comp"), "node"), "cells")
    discard(live, comps, info, first)
    several = out.groupBy("cluster").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("cluster")
    return out.join(several, "cluster")


def _met(lists: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Edges (x, y) that span the candidates of lists (list, node) of one order. Each class goes once to a place, however many of its lists do."""
    lists = save(lists.select("list", "node"), "meet")
    places = max(12, lists.count() // MEET_ROWS)
    met = lists.withColumn("place", F.pmod(F.xxhash64("list"), F.lit(places)))
    there = met.select(F.col("place").alias("there"), F.col("node").alias("class")).distinct().join(info.withColumnRenamed("node", "class"), "class")
    found = save(met.groupBy("place").cogroup(there.groupBy("there")).applyInArrow(lambda a, b: _released(_near(a, b, percent)), "x long, y long"), "found")
    discard(lists)
    return found


def _compare_clusters(sets: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) that span the components within each cluster.

    The classes of a cluster's largest component are compared with all others, these also with each
    other. Both are dealt to blocks; each two blocks that have to be compared meet in a place.
    """
    clusters = save(clusters, "clusters")
    if clusters.isEmpty():
        return clusters.select(F.col("node").alias("x"), F.col("node").alias("y"))
    sizes = clusters.groupBy("cluster", "comp").agg(F.count("*").alias("rows"), F.sum(5 * F.col("n").cast("long")).alias("bytes"))
    largest = F.max(F.struct("rows", "comp", "bytes"))
    parts = lambda rows, size: F.greatest(F.ceil(rows / CLASSES), F.ceil(size / CLASS_BYTES), F.lit(1)).cast("int")
    whole = sizes.groupBy("cluster").agg(largest.alias("big"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    whole = whole.select("cluster", F.col("big.comp").alias("big"), parts(F.col("big.rows"), F.col("big.bytes")).alias("k"), parts(F.col("rows") - F.col("big.rows"), F.col("bytes") - F.col("big.bytes")).alias("m"))
    own = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    rows = clusters.join(whole, "cluster").withColumn("main", F.col("comp") == F.col("big")).withColumn("own", F.when(F.col("main"), own("k")).otherwise(own("m")))
    # a meeting is two blocks: of the others (0 to m - 1), or one of them and one of the largest component (m on)
    others = F.sequence(F.lit(0), F.col("m") - 1)
    with_own = F.transform(others, lambda o: F.when(F.col("main"), F.struct(o.alias("a"), (F.col("m") + F.col("own")).alias("b"))).otherwise(F.struct(F.least(o, F.col("own")).alias("a"), F.greatest(o, F.col("own")).alias("b"))))
    with_main = F.when(~F.col("main"), F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.col("own").alias("a"), (F.col("m") + o).alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    dealt = rows.select("node", "comp", "n", "main", "cluster", F.explode(F.concat(with_own, with_main)).alias("meet"))
    places = max(24, -(-5 * (clusters.agg(F.sum(F.col("n").cast("long"))).first()[0]) // BUCKET_BYTES))
    meeting = F.xxhash64("cluster", "meet.a", "meet.b")
    home = save(dealt.select("node", "comp", "main", meeting.alias("meeting"), F.pmod(meeting, F.lit(places)).cast("int").alias("home")), "home")
    mine = _wanted(sets, "set", home).join(home, "node")

    def compare(table: pa.Table) -> pa.Table:
        meeting = table.column("meeting").to_numpy()
        by = np.argsort(meeting, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], meeting[by][1:] != meeting[by][:-1], [True]])) if len(by) else np.zeros(1, np.int64)
        node, comp, main = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "comp", "main"))
        blob = table.column("set").combine_chunks()
        out_x, out_y = [node[:0]], [node[:0]]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = by[a:b]
            own = own[np.unique(node[own], return_index=True)[1]]
            data, at = tb.unbinaries(blob.take(pa.array(own)), np.uint8)
            root = _linked(_unpack(data), np.diff(at) // 5, comp[own], main[own], percent)
            moved = root != np.arange(len(own))
            out_x.append(node[own[root[moved]]])
            out_y.append(node[own[moved]])
        return _released(pa.table({"x": np.concatenate(out_x), "y": np.concatenate(out_y)}))

    links = save(mine.groupBy("home").applyInArrow(compare, "x long, y long"), "links")
    discard(clusters, home)
    return links


def _linked(values: np.ndarray, n: np.ndarray, comp: np.ndarray, main: np.ndarray, percent: int) -> np.ndarray:
    """The smallest set reachable from each by links between different components; sets that are `main` aren't compared with each other."""
    rows = len(n)
    root = np.arange(rows)
    some = np.flatnonzero(~main)
    if not len(some) or rows < 2:
        return root
    line = np.full(rows, -1)
    line[some] = np.arange(len(some))
    row = np.repeat(np.arange(rows), n)
    _, back, count = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[back] > 1
    row, col = row[keep], number[back[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = int(number[-1]) + 1
    overlap = np.zeros((len(some), rows), np.float32)
    step = max(1, (16 << 20) // (4 * rows))
    for lo in range(0, width, step):
        s, e = np.searchsorted(col, [lo, lo + step])
        part = np.zeros((rows, min(step, width - lo)), np.float32)
        part[row[s:e], col[s:e] - lo] = 1
        overlap += part[some] @ part.T
    for lo in range(0, len(some), 256):
        own = some[lo : lo + 256]
        c = overlap[lo : lo + 256]
        i, j = np.nonzero(((100 + percent) * c >= percent * (n[own][:, None] + n)) & (comp[own][:, None] != comp))
        root = _merged(root, own[i], j)
    return root


def _released(table: pa.Table) -> pa.Table:
    release()
    return table


def _wanted(sets: DataFrame, column: str, ends: DataFrame) -> DataFrame:
    """(node, column) of the classes in `ends`, and a few others: the join that follows drops them."""
    wanted = IdFilter.of(ends, "node", ends.count())

    def choose(batches):
        for batch in batches:
            keep = wanted(batch.column(0).to_numpy())
            if keep.any():
                yield batch.filter(pa.array(keep))

    return sets.select("node", column).mapInArrow(tidy(choose), f"node long, {column} binary")


_PAIRS = "x long, y long, nx int, ny int"


def _verify(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose whole sets are as similar as asked. Sets are sent only for pairs whose sketches, a fraction of their size, allow it."""

    def allowed(a: np.ndarray, b: np.ndarray, sizes: int) -> bool:
        return (100 + percent) * _apart(a, b) <= (100 - percent) * sizes

    def similar(a: np.ndarray, b: np.ndarray, sizes: int) -> bool:
        return _similar(_unpack(a), _unpack(b), percent)

    # a sketch has at most two bits for each shingle, but eight bytes at least
    possible = _tested(sets, "sketch", lambda n: F.greatest(n / 4, F.lit(8)), pairs, allowed)
    return _tested(sets, "set", lambda n: 5 * n, possible, similar).select("x", "y")


def _tested(sets: DataFrame, column: str, size, pairs: DataFrame, test) -> DataFrame:
    """The pairs that pass a test of the column's bytes of both classes; size gives the bytes of a class of n shingles, about.

    The pairs of a class x are dealt to places, at most about FAN of them to one, and the bytes
    of a place's classes are sent there once each.
    """
    pairs = save(pairs, "pairs")
    total, = pairs.agg(F.sum((size(F.col("nx")) + size(F.col("ny"))).cast("long"))).first()
    if not total:
        return pairs
    places = max(24, -(-total // BUCKET_BYTES))
    degree = pairs.groupBy("x").agg(F.ceil(F.count("*") / FAN).alias("parts"))
    place = F.pmod(F.xxhash64("x", F.pmod(F.xxhash64("y"), F.col("parts"))), F.lit(places)).cast("int")
    dealt = save(pairs.join(degree, "x").select("x", "y", "nx", "ny", place.alias("place")), "dealt")
    # a table of known size: a small one is broadcast, so that the bytes are shuffled once
    ends = save(dealt.select(F.col("x").alias("node"), F.col("place").alias("home")).union(dealt.select(F.col("y").alias("node"), F.col("place").alias("home"))).distinct(), "ends")
    mine = _wanted(sets, column, ends).join(ends, "node")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        own = dict(zip(right.column("node").to_pylist(), right.column(column), strict=True))
        x, y = left.column("x").to_pylist(), left.column("y").to_pylist()
        sizes = (left.column("nx").to_numpy().astype(np.int64) + left.column("ny").to_numpy()).tolist()
        bytes_of = lambda node: np.frombuffer(own[node].as_buffer(), np.uint8)
        keep = [test(bytes_of(a), bytes_of(b), n) for a, b, n in zip(x, y, sizes, strict=True)]
        return _released(left.select(["x", "y", "nx", "ny"]).filter(pa.array(keep, pa.bool_())))

    found = save(dealt.groupBy("place").cogroup(mine.groupBy("home")).applyInArrow(compare, _PAIRS), "found")
    discard(pairs, dealt, ends)
    return found


def _apart(a: np.ndarray, b: np.ndarray) -> int:
    """Bits that differ in two sketches, the wider one folded to the other's width."""
    if len(a) > len(b):
        a, b = b, a
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    c = int((b[at] == a).sum())
    return 100 * c >= percent * (len(a) + len(b) - c)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> Joined:
    """Link all pairs of documents whose k-word shingle sets have a Jaccard similarity of percent / 100 or more.

    Words are runs of other characters than space and \\x09 to \\x0D, A-Z in lower
    case. A text of fewer than k words is one shingle; a null, empty or blank text
    has no shingle, links with nothing and is its own component. Rows with equal
    ids stay separate rows; a null id takes part, and its component's id is the
    smallest non-null id there. Further columns are ignored. An empty table gives
    an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = _profile(docs, k)
    rows = profile.where("slice is null").select("doc_id", "node", "n")
    sets = profile.where("set is not null").select("node", "n", "set", "sketch", "lows")
    total = sets.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    links = _verify(sets, _stars(sets, percent), percent)
    links = links.union(_compare_clusters(sets, _clusters(sets, links, percent, profile, total), percent))
    near = components(links, "x", "y")
    # smallest doc_id of each class, then of each component
    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    joined = classes.join(near.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "component").select("node", "component_id")
    out = rows.join(named, "node", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    members = rows.where("node is not null").select("doc_id", "node").join(near.withColumnRenamed("id", "node"), "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    return Joined(out, links.select(F.col("x").alias("node_a"), F.col("y").alias("node_b")), members)


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """The table with one row of each component of near copies: one with the smallest non-null id.

    Rows are told apart by id and shingle set, so that rows of one id with other texts are judged by
    themselves; of rows equal in both, one stays. Rows without words stay. Further columns stay; a
    table with a column of the name `_id`, `_node` or `_class`, in any case, is an error.
    """
    if clash := {"_id", "_node", "_class"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {min(clash)}")
    joined = ngram_join(docs, id_col, text_col, k, percent)
    members = joined.members.groupBy("doc_id", "node", "component").agg(F.count("*").alias("rows"))
    # null ids come last
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    heads = members.groupBy("component").agg(F.min(place).alias("head"))
    told = members.join(heads, "component")
    head = (F.col("node") == F.col("head.node")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id"))
    told = save(told.select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"), head.alias("head"), "rows").where("not head or rows > 1"), "told")
    cols = docs.columns
    body = cols.index(text_col)

    def name(batches):
        for batch in batches:
            for lo, hi, v, o in _sets(batch.column(body), k):
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(_nodes(v, o), mask=np.diff(o) == 0)], [*cols, "_class"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _class long"
    marked = docs.mapInArrow(tidy(name), schema)
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.col("_class") == F.col("_node"))
    out = marked.join(told.select("_id", "_node"), same, "left_anti").select(*cols)
    again = told.where("head")
    if again.isEmpty():
        return out
    return out.union(marked.join(again.select("_id", "_node"), same, "left_semi").dropDuplicates([id_col, "_class"]).select(*cols))
