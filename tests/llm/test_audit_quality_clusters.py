"""Filter audit, quality classifier and centroid clustering against brute force, on odd and small inputs."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from graphmine.llm import filter_audit, quality, shallot, textbuf

DOCS = "doc_id long, text string, source string, digest int, part string, first string"
LABELS = "doc_id long, quality int, toxic int, text string"


def odd_docs(spark):
    many = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, many, "a"), (2, many, "b"), (2, many, "b"), (3, None, "a"), (4, "", "a"), (5, "x " * 80, None), (6, many.upper(), ""), (7, many + " #", "b"),
        (None, many, "a"), (None, None, None), (0, "only one", "c"), (8, "A B\tcé", "a"), (9, "y " * 300_000 + "$", "b"), (2, "other text", "b"),
    ]
    return spark.createDataFrame([(i, t, s, 1, "p", "f") for i, t, s in rows], DOCS)


def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0, "t"), (1, 1, 0, "t"), (2, 0, 1, "t"), (2, 1, 0, "t"), (3, None, 1, "t"), (7, 1, 1, "t"), (None, 1, 1, "t"), (77, 1, 1, "t")], LABELS)


def audit_by_hand(docs, labels):
    docs = [(r["doc_id"], r["text"] or "", r["source"] or "") for r in docs.collect()]
    marks = [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect() if r["doc_id"] is not None]
    good, toxic = {i for i, q, _ in marks if q == 1}, {i for i, _, t in marks if t == 1}
    out = {}
    for part in {p for _, _, p in docs}:
        rows = []
        for i, text, p in docs:
            if p != part:
                continue
            w = re.findall(r"[^\x20\x09-\x0D]+", text)
            fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text), "E": i is not None and any(j is not None and j < i and t == text for j, t, _ in docs)}
            rows.append((i, {c for c, f in fails.items() if f}))
        shares, steps = Counter(), {}
        for order in permutations("ABCDE"):
            gone = set()
            for step, c in enumerate(order):
                here = [k for k, (_, f) in enumerate(rows) if c in f and k not in gone]
                redundant = sum(c in f and k in gone for k, (_, f) in enumerate(rows))
                gone |= set(here)
                shares[c] += len(here)
                steps["".join(order), step + 1] = (len(rows) - len(gone), len(here), redundant, sum(f == {c} for _, f in rows), sum(rows[k][0] in good for k in here), sum(rows[k][0] in toxic for k in here))
        for (order, step), x in steps.items():
            out[part, order, step] = (*x, shares[order[step - 1]])
    return out


def test_filter_audit(spark):
    docs, labels = odd_docs(spark), odd_labels(spark)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.filter_audit(docs, labels).collect()}
    want = audit_by_hand(docs, labels)
    assert len(want) == 4 * 600 and got == want
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    unmarked = filter_audit.filter_audit(docs, labels.limit(0)).toPandas()
    assert len(unmarked) == 4 * 600 and not unmarked[["good_lost", "toxic_lost"]].to_numpy().any()


@given(st.integers(1, 6).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.integers(0, 1000), min_size=1 << n, max_size=1 << n))))
@settings(max_examples=40, deadline=None)
def test_shapley_values_are_the_means_over_all_orders(case):
    n, counts = case
    removed = filter_audit.coalition_removals(range(1 << n), counts, n)
    total = [0] * n
    for order in permutations(range(n)):
        before = 0
        for i in order:
            total[i] += int(removed[before | 1 << i] - removed[before])
            before |= 1 << i
    assert [x * factorial(n) for x in filter_audit.shapley(removed, n)] == total


# quality ----------------------------------------------------------------


def made_texts(n, seed):
    """Plain sentences (1), and such of repeated words, of capitals and of marks (0)."""
    rng = np.random.default_rng(seed)
    pool = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9)))) for _ in range(400)]
    texts, y = [], []
    for i in range(n):
        w = [pool[k] for k in rng.integers(0, len(pool), int(rng.integers(8, 120)))]
        kind = i % 6
        if kind == 3:
            w = [x for x in w[:8] for _ in range(9)]
        elif kind == 4:
            w = [x.upper() + "!!" for x in w]
        elif kind == 5:
            w = [x + str(rng.choice(["%%%", "###"])) for x in w]
        texts.append(" ".join(w).capitalize() + "." if kind < 3 else " ".join(w))
        y.append(int(kind < 3))
    return texts, y


def test_quality_held_out(spark):
    texts, y = made_texts(900, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b", "x"), (5000, None, "x"), (5001, "", "x"), (5002, "word " * 200_000, "x"), (1, texts[1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, c) for i, c in enumerate(y)] + [(None, 1), (4, None), (99999, 1)], "doc_id long, quality int")
    got = quality.quality(docs, labels).toPandas()
    assert len(got) == 905 and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()
    assert (got["held_out"] == [not pd.isna(i) and zlib.crc32(str(int(i)).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    seen = got[got["held_out"] & (got["doc_id"] < 900)]
    assert len(seen) > 150 and np.mean(seen["predicted"] == [y[int(i)] for i in seen["doc_id"]]) >= 0.97
    same = got[got["doc_id"].isin([5000, 5001])]["score"]
    assert same.nunique() == 1 and got[got["doc_id"] == 1]["score"].nunique() == 1
    assert got[got["doc_id"] == 5002]["predicted"].item() == 0
    # the rows' order and their partitions don't matter, nor labels of held-out rows
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    again = quality.quality(docs.repartition(7), turned.repartition(3)).toPandas()
    key = ["doc_id", "score"]
    pd.testing.assert_frame_equal(got[key].sort_values(key).reset_index(drop=True), again[key].sort_values(key).reset_index(drop=True))


def test_quality_without_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    assert {r["predicted"] for r in quality.quality(docs, ones).collect()} == {1}
    assert quality.quality(docs.limit(0), ones).count() == 0
    with pytest.raises(ValueError):
        quality.score(docs, quality._constant(0.5), out_col="text")


def test_ngrams_and_ratios_by_hand():
    texts = ["Ab ab ab. 12", "", "ab", "ab. ab. ab. #"]
    rows = []
    for _, _, data, offs in textbuf.chunks(__import__("pyarrow").array(texts)):
        bucket, of = quality.ngrams(data, offs)
        rows += [bucket[a:b] for a, b in zip(of, of[1:], strict=False)]
    # distinct words, word pairs, shapes, their pairs and triples
    assert [len(r) for r in rows] == [4 + 3 + 4 + 3 + 2, 0, 2, 2 + 2 + 3 + 3 + 2]
    assert set(rows[2]) <= set(rows[0])
    y = np.array([1, 1, 0, 0])
    ratio = quality.log_count_ratios(rows, y)
    counts = [Counter(x for r, c in zip(rows, y, strict=True) if c == k for x in r) for k in (0, 1)]
    sums = [quality.BUCKETS + sum(c.values()) for c in counts]
    for x in set(np.concatenate(rows)):
        assert np.isclose(ratio[x], np.log((1 + counts[1][x]) / sums[1] / ((1 + counts[0][x]) / sums[0])))


def test_dual_descent_closes_the_gap():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(60, int(rng.integers(1, 9)), replace=False)) for _ in range(120)]
    values = [rng.normal(size=len(r)) for r in rows]
    y, cost = np.where(rng.random(120) < 0.4, 1, -1), rng.uniform(0.1, 2, 120)
    w, b = quality.hinge_descent(rows, values, y, cost, rounds=3000, gap=1e-9)

    def primal(w, b):
        f = np.array([w[r] @ v for r, v in zip(rows, values, strict=True)]) + b
        return (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - y * f)).sum()

    best = primal(w, b)
    for _ in range(300):
        step = rng.normal(size=len(w)) * 0.01 * (np.arange(len(w)) < 60)
        assert primal(w + step, b + rng.normal() * 0.01) >= best - 1e-6


# clusters ---------------------------------------------------------------


def clusters_by_hand(rows, dim, k, rounds):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "", np.array(v, "<i4").tobytes(), v) for i, v in kept)[:k]
    c = [v for *_, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return sorted(((-1 if i is None else i), nearest(v)[1], nearest(v)[0]) for i, v in kept), c


@pytest.mark.parametrize("n, k, dim, step", [(0, 5, 3, 0.1), (1, 5, 3, 0.1), (4, 5, 3, 0.1), (300, 7, 2, 0.02), (250, 12, 3, 0.5), (200, 1, 4, 0.1), (400, 20, 5, 0.001)])
def test_clusters(spark, n, k, dim, step):
    """Coarse grids give ties between centroids and equal vectors."""
    rng = np.random.default_rng(n + k)
    rows = [(int(rng.integers(0, n)) if i % 9 else i, (rng.integers(-20, 20, dim) * step).tolist()) for i in range(n)]
    if n > 100:
        odd = [None, [0.1] * (dim + 1), [], [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [None] + [0.0] * (dim - 1)]
        rows += [(1000 + i, v) for i, v in enumerate(odd)] + [(None, [0.3] * dim), (None, [0.3] * dim)]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, cluster string")
    found, c = shallot.cluster(df.repartition(3), dim=dim, k=k)
    got = sorted(((-1 if r["vec_id"] is None else r["vec_id"]), r["cluster"], r["distance"]) for r in found.collect())
    want, centroids = clusters_by_hand(rows, dim, k, shallot.ROUNDS)
    assert got == want and c.tolist() == centroids


@given(st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    dim, k, n = int(rng.integers(1, 5)), int(rng.integers(1, 15)), 200
    wide = int(rng.choice([2, 10, 1 << 26]))
    x = rng.integers(-wide, wide + 1, (n, dim))
    c = rng.integers(-wide, wide + 1, (k, dim))
    near, second, upper, lower, cs = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n), np.zeros(n), shallot.Centroids(c)
    for _ in range(4):
        near, second, upper, lower = shallot.search(x, near, second, upper, lower, cs)
        d = ((x[:, None] - cs.c) ** 2).sum(axis=2)
        assert (near == d.argmin(axis=1)).all()
        second = np.maximum(second, 0)
        moved = cs.c + rng.integers(-max(1, wide // 5), max(1, wide // 5) + 1, (k, dim)) * (rng.random((k, 1)) < 0.5)
        cs = shallot.Centroids(moved, cs.c)


def test_cluster_report(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(120)] + [(500, [0.0] * 63)], "vec_id long, embedding array<float>")
    got = shallot.centroid_clusters(df).toPandas()
    _, c = shallot.cluster(df)
    assert len(got) == 120 and (got["inertia"] == got["distance"].sum()).all()
    assert (got["cluster_inertia"] == got.groupby("cluster")["distance"].transform("sum")).all()
    assert all(h == hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest() for j, h in zip(got["cluster"], got["centroid_sha256"], strict=True))
    assert shallot.centroid_clusters(df.limit(0)).count() == 0
    with pytest.raises(PySparkException):
        shallot.centroid_clusters(spark.createDataFrame([(1, [1e12] * 64)], "vec_id long, embedding array<double>")).collect()
