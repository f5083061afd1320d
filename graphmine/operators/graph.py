"""Typed edges, two-hop composition, weights, candidates and weighted Jaccard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphmine.functions import keyed_hash, keyed_slot, keyed_uniform, md5
from graphmine.operators import blocks
from graphmine.operators.rank import rank_rows
from graphmine.sources.tables import save_table


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """(item, mid) and (mid, feature) to distinct (item, feature)."""
    return first.join(second, "mid").select("item", "feature").distinct()


def checked_edges(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges (src, dst) whose two ends exist, each once."""
    return edges.join(sources.select(F.col(sources.columns[0]).alias("src")), "src", "left_semi").join(targets.select(F.col(targets.columns[0]).alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def route_last(first: DataFrame, second: DataFrame) -> DataFrame:
    """(src, via) and (via, dst, ord) to (src, dst), where the last dst of a via wins."""
    last = second.groupBy("via").agg(F.max_by("dst", "ord").alias("dst"))
    return first.join(last, "via").select("src", "dst").distinct()


def feature_weights(edges: DataFrame) -> DataFrame:
    """(feature, freq, weight): items of a feature, and ln(all items / freq)."""
    total = edges.agg(F.count_distinct("item").alias("total"))
    freq = edges.groupBy("feature").agg(F.count("*").alias("freq"))
    return freq.crossJoin(total).select("feature", "freq", F.log(F.col("total") / F.col("freq")).alias("weight"))  # one row


def _marked(edges: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    """The edges of features of fewer than d items, and the others (item, feature, freq)."""
    freq = edges.groupBy("feature").agg(F.count("*").alias("freq"))
    marked = edges.join(freq, "feature")
    return marked.where(F.col("freq") < d).select("item", "feature"), marked.where(F.col("freq") >= d)


def candidates(edges: DataFrame, sizes: DataFrame, d: int, k: int, seed: int) -> DataFrame:
    """Distinct (target, item), item another than the target, that share a feature.

    A feature of fewer than d items gives all of them; another gives each target the d items of size k at
    most that come first in a keyed order of its own. The join tests that order against a limit that leaves
    d + 12 sqrt(d) + 20 of a feature's items on average (fewer than d with a probability below 1e-15),
    so only these are shuffled; still it meets all its small items with all its targets, which
    `candidates_drawn` doesn't. Whole-number ids meet in packed blocks, where only features with more than d small items are put in order.
    """
    if whole_ids(edges):
        found = pair_blocks(edges, d, sizes, k, seed)
        out = blocks.meet(found.packed, lambda: _Ordered(d, seed), "target long, item long")
        return out.withColumns({c: F.col(c).cast(found.id_type) for c in out.columns}) if found.id_type != "bigint" else out
    rare, common = _marked(edges, d)
    near = _other(rare.select(F.col("item").alias("target"), "feature").join(rare, "feature"))
    small = edges.join(sizes.where(F.col("size") <= k).select("item"), "item", "left_semi")
    count = small.groupBy("feature").agg(F.count("*").alias("n"))
    key = (F.col("target"), F.col("feature"), F.col("item"))
    draw = Window.partitionBy("target", "feature").orderBy(keyed_hash(seed, *key), "item")
    met = common.select(F.col("item").alias("target"), "feature").join(count, "feature").join(small, "feature").where("item <> target")
    met = met.where(keyed_uniform(seed, *key) * F.col("n") <= d + 12 * d**0.5 + 20)
    drawn = met.withColumn("r", F.row_number().over(draw)).where(F.col("r") <= d).select("target", "item")
    return near.union(drawn).distinct()


def _other(pairs: DataFrame) -> DataFrame:
    return pairs.where("item <> target").select("target", "item")


def whole_ids(edges: DataFrame) -> bool:
    """Whether items and features are whole numbers, as the blocks of `pair_blocks` hold them."""
    return all(edges.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in ("item", "feature"))


@dataclass
class PairBlocks:
    """Packed blocks of edges, whose pairs `blocks.meet` finds: those that share a feature of fewer than d items, and the drawn ones of others."""

    packed: tuple[DataFrame, int]
    d: int
    drawn: bool
    id_type: str


def pair_blocks(edges: DataFrame, d: int, sizes: DataFrame | None = None, k: int = 0, seed: int = 0, weights: DataFrame | None = None, traits: DataFrame | None = None) -> PairBlocks:
    """Blocks of (item, feature) of whole-number ids; pairs are drawn as in `candidates_drawn` where sizes are given.

    traits: (item, ..), one row an item at most, are at hand where a pair's items are.
    """
    kind = edges.schema["item"].dataType.simpleString()
    rows = save_table(edges.where("item is not null and feature is not null").select(F.col("item").cast("long").alias("item"), F.col("feature").cast("long").alias("feature")), "edges")
    own = save_table((feature_weights(rows) if weights is None else weights).select(F.col("feature").cast("long").alias("feature"), "freq", "weight"), "weights")
    if sizes is not None:
        sizes = sizes.select(F.col("item").cast("long").alias("item"), "size")
    if traits is not None:
        traits = traits.withColumn("item", F.col("item").cast("long"))
    return PairBlocks(blocks.pack(blocks.edge_rows(rows, own, d, sizes, k, seed), rows.select("item"), d, traits), d, sizes is not None, kind)


class _Found(blocks.Work):
    """(target, item) of the pairs, and (similarity, distance) if weighed."""

    def __init__(self, d: int, drawn: bool, weighed: bool):
        self.d, self.drawn, self.weighed = d, drawn, weighed

    def visit(self, a: blocks.Block, b: blocks.Block) -> Iterator[pa.RecordBatch]:
        for met in blocks.asked(a, b, self.d, self.drawn):
            columns = {"target": a.items[met.target], "item": b.items[met.item]}
            if self.weighed:
                columns["similarity"] = blocks.similarity(a, b, met)
                columns["distance"] = 1 - columns["similarity"]
            yield pa.RecordBatch.from_pydict(columns)


class _Ordered(blocks.Work):
    """(target, item) as in `candidates`: all small items of a common feature that has d others at most, of another those first in the target's order."""

    def __init__(self, d: int, seed: int):
        self.d, self.seed = d, seed

    def begin(self, a: blocks.Block) -> None:
        kind, n = a.kind[a.e_feature], a.n[a.e_feature]
        few = n - (a.e_place >= 0) <= self.d
        self.whole = (kind == blocks.COMMON) & few
        self.picked = np.flatnonzero((kind == blocks.HEAVY) | (kind == blocks.COMMON) & ~few)
        self.near: list[tuple[np.ndarray, np.ndarray]] = []
        self.keyed: list[tuple[np.ndarray, ...]] = []
        self.heads = [b"%d|%d|%d|" % (self.seed, t, f) for t, f in zip(a.items[a.e_target[self.picked]].tolist(), a.features[a.e_feature[self.picked]].tolist(), strict=True)]

    def visit(self, a: blocks.Block, b: blocks.Block) -> Iterator[pa.RecordBatch]:
        for met in blocks.products(a, b, self.d, False, self.whole):
            self.near.append((met.target[met.asked].astype(np.int32), b.items[met.item[met.asked]]))
        at, there = blocks.common_features(a, b)
        feature = a.e_feature[self.picked]
        small = b.place >= 0
        first = np.concatenate([[0], np.cumsum(small)])[b.first]
        items = b.item[small]
        own = np.flatnonzero(there[feature])
        size = first[at[feature[own]] + 1] - first[at[feature[own]]]
        if size.sum():
            texts = md5.tails([str(i).encode() for i in b.items.tolist()])
            for i, j in blocks.parts(size, blocks.PRODUCTS):
                run, place = blocks.spread(first[at[feature[own[i:j]]]], size[i:j])
                which, item = own[i:j][run], items[place]
                if a.block == b.block:
                    other = a.e_target[self.picked[which]] != item
                    which, item = which[other], item[other]
                one, two = md5.joined(self.heads, which, *texts, item)
                # as in candidates: d + 12 sqrt(d) + 20 of a feature's items on average are enough
                near = md5.uniform(one, two) * a.n[feature[which]] <= self.d + 12 * self.d**0.5 + 20
                order = (one.byteswap().astype(np.uint64) << np.uint64(32)) | two.byteswap()
                self.keyed.append((which[near], order[near], b.items[item[near]]))
        yield from ()

    def end(self, a: blocks.Block) -> Iterator[pa.RecordBatch]:
        if self.keyed:
            which, order, item = (np.concatenate([k[i] for k in self.keyed]) for i in range(3))
            by = np.lexsort((item, order, which))
            which, item = which[by], item[by]
            first = np.flatnonzero(np.diff(which, prepend=-1))
            rank = np.arange(len(which)) - np.repeat(first, np.diff(np.append(first, len(which))))
            self.near.append((a.e_target[self.picked[which[rank < self.d]]].astype(np.int32), item[rank < self.d]))
        if not self.near:
            return
        target, item = (np.concatenate([x[i] for x in self.near]) for i in range(2))
        by = np.lexsort((item, target))
        target, item = target[by], item[by]
        new = (np.diff(target, prepend=-1) != 0) | (np.diff(item, prepend=item[:1] - 1) != 0)
        target, item = a.items[target[new]], item[new]
        for i in range(0, len(target), 100_000):
            yield pa.RecordBatch.from_pydict({"target": target[i : i + 100_000], "item": item[i : i + 100_000]})


def pairs_of(found: PairBlocks, weighed: bool = True) -> DataFrame:
    """(target, item, similarity, distance) of all pairs, each once; (target, item) alone if not weighed."""
    d, drawn = found.d, found.drawn
    out = blocks.meet(found.packed, lambda: _Found(d, drawn, weighed), "target long, item long" + ", similarity double, distance double" * weighed)
    return out.withColumns({c: F.col(c).cast(found.id_type) for c in ("target", "item")}) if found.id_type != "bigint" else out


def candidates_drawn(edges: DataFrame, sizes: DataFrame, d: int, k: int, seed: int) -> DataFrame:
    """Distinct (target, item), item another than the target, that share a feature, at most d from each common one.

    A feature of fewer than d items gives all of them. The items of size k at most of another stand in a keyed
    order, d of them to a block, and each target takes d in a row from a place of its own on, round the end; one fewer where the target is among them.
    Whole-number ids meet in packed blocks. Of others a target fetches the two or three runs of d places that its own lie in, so the join has
    as many rows for a target and feature, whatever the feature's frequency.
    """
    if whole_ids(edges):
        return pairs_of(pair_blocks(edges, sizes=sizes, d=d, k=k, seed=seed), weighed=False)
    rare, common = _marked(edges, d)
    near = _other(rare.select(F.col("item").alias("target"), "feature").join(rare, "feature"))
    small = common.join(sizes.where(F.col("size") <= k).select("item"), "item", "left_semi").select("feature", "item")
    placed = rank_rows(small.withColumn("_u", -keyed_uniform(seed, F.col("feature"), F.col("item"))), "feature", "_u", "item").select("feature", "item", (F.col("rank") - 1).alias("place"))
    block = F.floor(F.col("place") / d)
    blocks = save_table(placed.groupBy("feature", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("items")), "blocks")  # d items each
    count = blocks.groupBy("feature").agg(F.sum(F.size("items")).alias("n"))
    takes = common.select(F.col("item").alias("target"), "feature").join(count, "feature").withColumn("start", F.pmod(keyed_slot(seed, F.col("target"), F.col("feature")), F.col("n")))
    # the places from start to the end of d or of all, and those from 0 on where that goes round
    last, over = F.least(F.col("start") + d, F.col("n")) - 1, F.least(F.col("start") + d - F.col("n"), F.col("start")) - 1
    front = F.when(over >= 0, F.sequence(F.lit(0).cast("long"), F.floor(over / d))).otherwise(F.array().cast("array<bigint>"))
    wanted = F.array_distinct(F.concat(F.sequence(F.floor(F.col("start") / d), F.floor(last / d)), front))
    met = takes.withColumn("block", F.explode(wanted)).join(blocks, ["feature", "block"])
    mine = F.filter("items", lambda x: (F.pmod(x["place"] - F.col("start"), F.col("n")) < d) & (x["item"] != F.col("target")))
    return near.union(met.select("target", F.explode(F.transform(mine, lambda x: x["item"])).alias("item"))).distinct()


def _feature_lists(weighted: DataFrame) -> DataFrame:
    """Each item's features and their weights as two arrays."""
    both = weighted.groupBy("item").agg(F.collect_list(F.struct("feature", "weight")).alias("l"))
    return both.select("item", F.col("l.feature").alias("f"), F.col("l.weight").alias("w"))


def _shared_weight(pairs: DataFrame, weighted: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs with `shared`: the joint weight of the features that both ends have.

    The features travel as two arrays to each pair; no row is made for a pair's feature.
    """
    lists = _feature_lists(weighted)
    rows = pairs.join(lists.select(F.col("item").alias(a), F.col("f").alias("_fa"), F.col("w").alias("_wa")), a, "left")
    rows = rows.join(lists.select(F.col("item").alias(b), F.col("f").alias("_fb")), b, "left")
    both = F.array_intersect("_fa", "_fb")
    shared = F.aggregate(both, F.lit(0.0), lambda total, f: total + F.element_at("_wa", F.array_position("_fa", f).cast("int")))
    return rows.withColumn("shared", F.coalesce(shared, F.lit(0.0))).drop("_fa", "_wa", "_fb")


def _similarity(shared: DataFrame, totals: DataFrame, a: str, b: str) -> DataFrame:
    out = shared.join(totals.select(F.col("item").alias(a), F.col("w").alias("wa")), a).join(totals.select(F.col("item").alias(b), F.col("w").alias("wb")), b)
    joint = F.col("wa") + F.col("wb") - F.col("shared")
    return out.withColumn("similarity", F.when(joint > 0, F.col("shared") / joint).otherwise(F.lit(0.0))).withColumn("distance", 1 - F.col("similarity")).drop("shared", "wa", "wb")


def weighted_jaccard(pairs: DataFrame, edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(target, item, similarity, distance): shared weight over joint weight; nothing to weigh gives similarity 0."""
    weighted = save_table(edges.join(weights.select("feature", "weight"), "feature"), "weighted")
    totals = weighted.groupBy("item").agg(F.sum("weight").alias("w"))
    return _similarity(_shared_weight(pairs, weighted, "target", "item"), totals, "target", "item").select("target", "item", "similarity", "distance")


def shared_feature_pairs(edges: DataFrame, weights: DataFrame, d: int) -> DataFrame:
    """All pairs that share a feature of fewer than d items, with their weighted Jaccard distance.

    Whole-number ids meet in packed blocks. For others, the join that finds a pair also sums its rare features' weights; the weight of the common
    ones comes from each item's list of these, and each pair is weighed once and returned in both directions.
    """
    if whole_ids(edges):
        return pairs_of(pair_blocks(edges, d, weights=weights))
    weighted = save_table(edges.join(weights, "feature").select("item", "feature", "freq", "weight"), "weighted")
    totals = weighted.groupBy("item").agg(F.sum("weight").alias("w"))
    rare, common = weighted.where(F.col("freq") < d), weighted.where(F.col("freq") >= d)
    met = rare.select(F.col("item").alias("a"), "feature", "weight").join(rare.select(F.col("item").alias("b"), "feature"), "feature").where("a < b")
    found = met.groupBy("a", "b").agg(F.sum("weight").alias("rare"))
    out = _shared_weight(found, common, "a", "b").withColumn("shared", F.col("shared") + F.col("rare")).drop("rare")
    ways = F.explode(F.array(F.struct(F.col("a").alias("target"), F.col("b").alias("item")), F.struct(F.col("b").alias("target"), F.col("a").alias("item")))).alias("way")
    return _similarity(out, totals, "a", "b").select(ways, "similarity", "distance").select("way.target", "way.item", "similarity", "distance")


def layer_rows(layers: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row for each id with a JSON cell of each layer: the first row of the id there, nulls left out."""
    rows = None
    for name, (df, key) in layers.items():
        part = df.select(F.col(key).cast("long").alias("id"), F.lit(name).alias("layer"), F.to_json(F.struct(*df.columns)).alias("cell"))
        rows = part if rows is None else rows.union(part)
    return rows.groupBy("id").pivot("layer", list(layers)).agg(F.min("cell"))


#: Sets that one node of the search tree holds before it is parted.
NODE = 10_000


def minimal_sets(sets: DataFrame, node_size: int = NODE) -> DataFrame:
    """Rows (id, elems, size) that contain no other row's set of a smaller size.

    A set that is contained holds its own rarest elements, so the sets are the leaves of a tree of their elements, the rarest
    first: a node of more than node_size sets is parted by their next element, and so on, and a row goes down only where it holds
    the element. At a node it meets that node's sets, by a 64-bit signature of the elements first; whole sets are
    fetched only for pairs that pass. So an element that is in every set makes no large node, unless sets consist of such alone. A null or empty set takes no part, and stays.
    """
    rows = sets.select("id", "elems", "size")
    flat = rows.select("id", F.explode(F.array_distinct("elems")).alias("e"))
    freq = flat.groupBy("e").agg(F.count("*").alias("freq"))
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(e), 64) as int))")
    named = flat.join(freq, "e").select("id", F.struct("freq", "e").alias("at"), bit.alias("bit"))
    lists = named.groupBy("id").agg(F.array_sort(F.collect_list("at")).alias("path"), F.bit_or("bit").alias("sig"))
    lists = save_table(lists.join(rows.select("id", "size"), "id"), "paths")
    outer = lists.select("id", "size", "sig", F.transform("path", lambda p: p["e"]).alias("elems"))
    # a node is the path of elements that leads to it; its sets have these as their rarest
    inner = lists.select(F.col("id").alias("inner_id"), F.col("size").alias("inner_size"), F.col("sig").alias("inner_sig"), F.transform("path", lambda p: p["e"]).alias("way"))
    there = outer.select("id", "size", "sig", "elems", F.posexplode("elems").alias("i", "e")).select("id", "size", "sig", "elems", "i", F.array("e").alias("node"))
    beaten, depth = None, 1
    while True:
        placed = save_table(inner.withColumn("node", F.slice("way", 1, depth)), "nodes")
        large = save_table(placed.groupBy("node").agg(F.count("*").alias("n"), F.count_if(F.size("way") > depth).alias("more")).where((F.col("n") > node_size) & (F.col("more") > 0)).select("node"), "large")
        split = not large.isEmpty()
        # sets that end at their node, or whose node is small, are met here
        here = placed.where(F.size("way") == depth).union(placed.where(F.size("way") > depth).join(large, "node", "left_anti").select(*placed.columns)) if split else placed
        # of the sets that are the node's path itself only the smallest matters
        ends = here.where(F.size("way") == depth).groupBy("node").agg(F.min(F.struct("inner_size", "inner_id", "inner_sig")).alias("m")).select("node", "m.inner_id", "m.inner_size", "m.inner_sig")
        met = there.select("id", "size", "sig", "node").join(here.where(F.size("way") > depth).select("node", "inner_id", "inner_size", "inner_sig").union(ends.select("node", "inner_id", "inner_size", "inner_sig")), "node")
        pairs = met.where("inner_size < size and (inner_sig & ~sig) = 0").select("id", "inner_id")
        beaten = pairs if beaten is None else beaten.union(pairs)
        if not split:
            break
        inner = placed.where(F.size("way") > depth).join(large, "node", "left_semi").select(*inner.columns)
        down = there.join(large, "node", "left_semi")
        nexts = F.filter(F.transform("elems", lambda x, k: F.struct(k.alias("k"), x.alias("e"))), lambda s: s["k"] > F.col("i"))
        there = save_table(down.select("id", "size", "sig", "elems", "node", F.explode(nexts).alias("s")).select("id", "size", "sig", "elems", F.col("s.k").alias("i"), F.concat("node", F.array("s.e")).alias("node")), "down")
        depth += 1
    whole = rows.select("id", "elems")
    tested = beaten.join(whole, "id").join(whole.select(F.col("id").alias("inner_id"), F.col("elems").alias("inner_elems")), "inner_id")
    lost = tested.where(F.size(F.array_except("inner_elems", "elems")) == 0).select("id").distinct()
    return rows.join(lost, "id", "left_anti")
