"""Pairs found in packed blocks: no pair is shuffled, and they equal plain loops over small blocks, heavy features, nulls and repeated ids."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmine.operators import blocks, graph, sampling

D, K, SEED = 4, 5, 11


def made(spark, seed=3):
    rng = np.random.default_rng(seed)
    edges = sorted({(int(i) * 3, int(f)) for i, f in zip(rng.integers(0, 60, 420), rng.integers(0, 70, 420) ** 2 // 70, strict=True)} | {(i * 3, 500) for i in range(60)})
    df = spark.createDataFrame([*edges, (None, 1), (3, None)], "item long, feature long")
    sizes = [(i * 3, 1 + i % 8) for i in range(60)]
    return edges, df, dict(sizes), spark.createDataFrame([*sizes, sizes[0]], "item long, size int")


def key(*parts):
    return hashlib.md5("|".join(map(str, (SEED, *parts))).encode()).hexdigest()


def plain(edges, sizes):
    """(similarity of all pairs that share a feature, pairs of rare features, drawn pairs)"""
    items, own = {}, {}
    for i, f in edges:
        items.setdefault(f, []).append(i)
        own.setdefault(i, set()).add(f)
    weight = {f: math.log(len(own) / len(v)) for f, v in items.items()}
    total = {i: sum(weight[f] for f in fs) for i, fs in own.items()}
    sim = {}
    for f, v in items.items():
        for a in v:
            for b in v:
                if a != b:
                    sim[a, b] = sim.get((a, b), 0.0) + weight[f]
    sim = {(a, b): s / (total[a] + total[b] - s) if total[a] + total[b] > s else 0.0 for (a, b), s in sim.items()}
    rare = {(a, b) for v in items.values() if len(v) < D for a in v for b in v if a != b}
    drawn = set(rare)
    for f, v in items.items():
        if len(v) >= D and (small := sorted((i for i in v if sizes[i] <= K), key=lambda i: (key(f, i), i))):
            for a in v:
                start = int(key(a, f)[:12], 16) % len(small)
                drawn |= {(a, small[(start + j) % len(small)]) for j in range(min(D, len(small)))} - {(a, a)}
    return sim, rare, drawn


@pytest.mark.parametrize(("size", "hot", "wide"), [(25, 6, 10), (25, 4096, 100_000), (10_000, 6, 100_000)])
def test_pairs_of_blocks(spark, monkeypatch, size, hot, wide):
    edges, df, sizes, size_df = made(spark)
    for name, value in (("EDGES", size), ("HOT", hot), ("WIDE", wide), ("PRODUCTS", 50)):
        monkeypatch.setattr(blocks, name, value)
    sim, rare, drawn = plain(edges, sizes)
    got = {(r["target"], r["item"]): r["similarity"] for r in graph.pairs_of(graph.pair_blocks(df, D, size_df, K, SEED)).collect()}
    assert got == pytest.approx({p: sim[p] for p in drawn})
    pairs = graph.candidates_drawn(df, size_df, D, K, SEED).collect()
    assert sorted(tuple(r) for r in pairs) == sorted(drawn)
    weights = graph.feature_weights(df.dropna())
    found = graph.shared_feature_pairs(df, weights, D).collect()
    assert len(found) == len(rare) and {(r["target"], r["item"]): r["similarity"] for r in found} == pytest.approx({p: sim[p] for p in rare})


def test_no_pair_is_shuffled(spark):
    _, df, _, sizes = made(spark)
    for out in (graph.candidates_drawn(df, sizes, D, K, SEED), graph.shared_feature_pairs(df, graph.feature_weights(df), D), graph.pairs_of(graph.pair_blocks(df, D, sizes, K, SEED))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Aggregate" not in plan, plan


def test_narrow_ids_and_no_edges(spark):
    _, df, _, sizes = made(spark)
    few = df.select(F.col("item").cast("int").alias("item"), "feature")
    out = graph.candidates_drawn(few, sizes, D, K, SEED)
    assert out.dtypes == [("target", "int"), ("item", "int")] and out.count() == graph.candidates_drawn(df, sizes, D, K, SEED).count()
    assert graph.pairs_of(graph.pair_blocks(df.limit(0), D, sizes, K, SEED)).count() == 0


@pytest.mark.parametrize(("size", "hot"), [(25, 6), (10_000, 4096)])
def test_candidates_in_a_targets_own_order(spark, monkeypatch, size, hot):
    edges, df, sizes, size_df = made(spark, 5)
    monkeypatch.setattr(blocks, "EDGES", size)
    monkeypatch.setattr(blocks, "HOT", hot)
    items = {}
    for i, f in edges:
        items.setdefault(f, []).append(i)
    want = plain(edges, sizes)[1]
    for f, v in items.items():
        if len(v) >= D:
            for a in v:
                want |= {(a, b) for b in sorted((b for b in v if b != a and sizes[b] <= K), key=lambda b: (key(a, f, b), b))[:D]}
    got = graph.candidates(df, size_df, D, K, SEED)
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("size", [40, 500_000])
def test_unrelated_draws(spark, monkeypatch, size):
    edges, df, _, _ = made(spark, 6)
    monkeypatch.setattr(sampling, "DRAWING", size)
    ids = list(range(0, 180, 2))  # some without edges, and some edges' items aren't among them
    items = spark.createDataFrame([*((i,) for i in ids), (4,), (None,)], "item long")
    own = {}
    for i, f in edges:
        own.setdefault(i, set()).add(f)
    slots = {}
    for i in ids:
        slots.setdefault(int(key(i)[:12], 16) % len(ids), []).append(i)
    want = set()
    for a in ids:
        first = {}
        for j in range(1, 13):
            for b in slots.get(int(key(a, j)[:12], 16) % len(ids), []):
                first.setdefault(b, j)
        free = sorted((j, b) for b, j in first.items() if b != a and not own.get(a, set()) & own.get(b, set()))
        want |= {(a, b) for _, b in free[:5]}
    got = sampling.unrelated_drawn(items, df, SEED, 5, 12)
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
