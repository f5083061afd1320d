"""Operators whose plans bound what meets in a task, against brute force on ties, nulls, repeated rows and hot groups."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphmine.operators import digests, evaluation, graph, models, patterns, quantiles, rank, registry, sampling
from graphmine.sources import tables, workspace


def test_ranks_keep_null_groups_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(g, s, i) for i in range(600) for g in [[None, "a", "b"][int(rng.integers(0, 3))]] for s in [[None, 1.0, 1.0, 1.0, 2.5, float(i)][int(rng.integers(0, 6))]]]
    df = spark.createDataFrame([*rows, rows[0]], "g string, s double, id int").repartition(7)
    got = sorted((str(r["g"]), r["rank"], r["id"]) for r in rank.rank_rows(df, "g", "s", "id").collect())
    want = []
    for g in (None, "a", "b"):
        own = sorted(((r[1] is None, -(r[1] or 0), r[2]) for r in [*rows, rows[0]] if r[0] == g))
        want += [(str(g), k + 1, i) for k, (_, _, i) in enumerate(own)]
    assert got == sorted(want)
    assert rank.rank_rows(df.limit(0), "g", "s", "id").count() == 0
    numbers = [(r["number"], r["id"]) for r in rank.numbered(df.dropDuplicates(["id"]), "id").collect()]
    assert sorted(numbers) == [(i, i) for i in range(600)]


def test_strata_of_nulls(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("x", 3), ("x", 4)], "s string, id int")
    assert sampling.stratified(df, "s", "id", 1.0, 1, 3).count() == 4


def test_tables_go_at_the_end_of_their_block(spark):
    before = tables.mark()
    with tables.temporary_tables(spark):
        kept = tables.save_table(spark.range(5), "one")
        assert kept.count() == 5 and tables.mark() == before + 1
    assert tables.mark() == before
    stays, goes = tables.save_table(spark.range(3), "two"), tables.save_table(spark.range(3), "three")
    assert tables.drop_tables(spark, before, stays) == 1 and stays.count() == 3
    with pytest.raises(PySparkException):
        spark.read.parquet(goes.inputFiles()[0].rsplit("/", 1)[0]).count()
    tables.drop_tables(spark, before)


def test_digests_count_repeated_rows(spark):
    twice = spark.createDataFrame([(1,), (1,), (2,), (2,)], "v int")
    other = spark.createDataFrame([(3,), (3,), (4,), (4,)], "v int")
    a, b = (registry.table_digest(x).first()["digest"] for x in (twice, other))
    assert a != b and a != registry.table_digest(twice.distinct()).first()["digest"] and a == registry.table_digest(twice.orderBy(F.desc("v"))).first()["digest"]
    nulls = spark.createDataFrame([(None, 1)], "a int, b int"), spark.createDataFrame([(1, None)], "a int, b int")
    assert registry.table_digest(nulls[0]).first()["digest"] != registry.table_digest(nulls[1]).first()["digest"]
    assert registry.table_digest(twice.limit(0)).first()["n_rows"] == 0


def test_ranges_that_differ(spark):
    rows = [(i, f"v{i % 7}", None if i % 5 else i) for i in range(3000)]
    left = spark.createDataFrame(rows, "k int, a string, b int")
    right = spark.createDataFrame([*rows[:700], (700, "new", 1), *rows[701:2000], *rows[2001:], (5000, "x", 1)], "k int, a string, b int").repartition(5)
    got = {tuple(r) for r in digests.reconcile_ranges(left, right, ["k"], ["a", "b"]).collect()}
    assert got == {(700, "mismatch", "a"), (700, "mismatch", "b"), (2000, "missing_right", ""), (5000, "missing_left", "")}
    tree = digests.digest_tree(left, ["k"], ["a", "b"])
    assert tree.where("level = 0").first()["n_rows"] == 3000 and tree.groupBy("level").agg(F.sum("n_rows").alias("n")).select("n").distinct().count() == 1
    assert digests.differing_ranges(tree, digests.digest_tree(left.repartition(9), ["k"], ["a", "b"])).count() == 0
    # a repeated row is a difference, and two of them don't cancel
    assert digests.differing_ranges(tree, digests.digest_tree(left.union(left.where("k = 4")).union(left.where("k = 4")), ["k"], ["a", "b"])).count() == digests.LEVELS + 1
    assert digests.reconcile_ranges(left, left, ["k"], ["a", "b"]).count() == 0
    assert digests.group_digests(left, "a", ["k", "b"]).count() == 7


@pytest.mark.parametrize("slice_size", [1, 5, 100_000])
def test_quantiles(spark, slice_size):
    rng = np.random.default_rng(4)
    groups = {"ties": [1.0] * 300 + [2.0] * 20 + [0.5] * 3, "wide": (10.0 ** rng.uniform(-200, 200, 500)).tolist(), "one": [7.0], None: rng.normal(size=200).round(1).tolist(), "two": [1.0, 4.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("ties", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.1, 0.5, 0.93, 1.0]
    got = {(r["g"], r["share"]): r["quantile"] for r in quantiles.quantiles(df, "g", "v", shares, slice_size).collect()}
    assert set(got) == {(g, s) for g in groups for s in shares}
    for g, vs in groups.items():
        for s in shares:
            assert got[g, s] == pytest.approx(float(np.quantile(vs, s)), rel=1e-9)
    assert quantiles.quantiles(df.limit(0), "g", "v", shares).count() == 0


@pytest.mark.parametrize("node_size", [1, 5, 10_000])
def test_minimal_sets_with_a_hot_element(spark, node_size):
    """One element is in every set, and some sets hold common elements alone."""
    rng = np.random.default_rng(7)
    sets = [sorted({0, *rng.integers(0, 12, int(rng.integers(0, 6))).tolist()}) for _ in range(150)]
    sets += [sets[3], [0], [0, 1]] if node_size > 1 else [sets[3]]
    df = spark.createDataFrame([(i, s, len(s)) for i, s in enumerate(sets)] + [(900, [], 0), (901, None, 5)], "id int, elems array<int>, size int")
    got = {r["id"] for r in graph.minimal_sets(df, node_size).collect()}
    want = {i for i, s in enumerate(sets) if not any(len(o) < len(s) and set(o) <= set(s) for o in sets)}
    assert got == want | {900, 901}


@pytest.mark.parametrize("n_hubs", [3, 64, 150])
def test_hub_bits(spark, n_hubs):
    rng = np.random.default_rng(n_hubs)
    hub_items = sorted({(f"h{int(h):03d}", int(i)) for h, i in zip(rng.integers(0, n_hubs, 900), rng.integers(0, 40, 900), strict=True)})
    pairs = [(int(a), int(b), float(b)) for a, b in zip(rng.integers(0, 40, 200), rng.integers(30, 50, 200), strict=True)]
    table = spark.createDataFrame([*hub_items, hub_items[0], (None, 1), ("h", None)], "hub string, item int")
    owners = spark.createDataFrame([*hub_items[::2], ("alone", 1)], "hub string, item int")
    df = spark.createDataFrame(pairs, "target int, item int, distance double")
    known = set(hub_items)
    want = sorted((t, h, i, d, "KL" if (h, i) in known else "NL") for t, i, d in pairs for h, o in {*hub_items[::2], ("alone", 1)} if o == t)
    assert sorted(tuple(r) for r in sampling.known_split(df, table, owners).collect()) == want
    counts = {(r["target"], r["hub"]): (r["known"], r["other"]) for r in sampling.label_counts(df, table, owners).collect()}
    told = {}
    for t, h, _, _, label in want:
        told.setdefault((t, h), [0, 0])[label == "NL"] += 1
    assert counts == {k: tuple(v) for k, v in told.items()}


def test_drawn_candidates_go_round_the_end(spark):
    """Blocks of places against places one by one."""
    rng = np.random.default_rng(2)
    edges = spark.createDataFrame([(i, f) for i in range(90) for f in {"all", f"f{int(rng.integers(0, 3))}"}], "item int, feature string")
    sizes = spark.createDataFrame([(i, 1 if i % 4 else 9) for i in range(90)], "item int, size int")
    got = graph.candidates_drawn(edges, sizes, 7, 5, 11)
    each = got.groupBy("target").count().collect()
    assert len(each) == 90 and all(6 <= r["count"] <= 14 for r in each)
    assert got.where("item % 4 = 0 or item = target").count() == 0 and got.count() == got.distinct().count()


def naive_ranks(vectors, candidates, positives, encoder):
    out = {}
    for task, own in positives.items():
        own = sorted({i for i in own if i in vectors})
        pool = {i for i in [*candidates.get(task, []), *own] if i in vectors}
        for mask in range(1, (1 << len(own)) - 1):
            inside = [p for j, p in enumerate(own) if mask >> j & 1]
            q = np.mean([vectors[p] for p in inside], axis=0)
            q = encoder(q[None])[0] if encoder else q
            order = sorted(pool - set(inside), key=lambda i: (-round(float(np.dot(vectors[i], q)), 9), i))
            for h in own:
                if h not in inside:
                    out[task, mask, h] = order.index(h) + 1
    return out


@pytest.mark.parametrize("block", [20_000, 7])
def test_subset_ranks(spark, monkeypatch, block):
    monkeypatch.setattr(evaluation, "BLOCK", block)
    rng = np.random.default_rng(3)
    vectors = {i: rng.integers(-3, 4, 4).astype(float) for i in range(40)}
    vectors[11] = vectors[12]
    candidates = {"a": [*range(30), 99, 5], "b": list(range(10, 40)), "c": [1, 2], "d": [1]}
    positives = {"a": [3, 11, 12, 35, 98, 3], "b": [20], "c": [1, 2, 3], "e": [98]}
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()] + [(99, [1.0]), (98, None), (97, [float("nan")] * 4)], "id int, vector array<double>")
    c, p = (spark.createDataFrame([(t, i) for t, ids in d.items() for i in ids], "task string, id int") for d in (candidates, positives))
    n = spark.createDataFrame([("a", 4), ("a", 6), ("b", 99)], "task string, id int")
    broken = models.Encoder.of_size(4, 3)
    broken.weights[0] = broken.weights[0] * float("nan")
    encoders = {"mean": None, "net": models.Encoder.of_size(4, 5, "gelu"), "broken": broken}
    ranks = evaluation.heldout_ranks(evaluation.context_counts(c, p, n, vec, encoders, 4)).collect()
    for name in ("mean", "net"):
        got = {(r["task"], r["subset"], r["held"]): r["rank"] for r in ranks if r["model_id"] == name}
        assert got == naive_ranks(vectors, candidates, positives, encoders[name])
    assert not [r for r in ranks if r["model_id"] == "broken"]
    out = {(r["model_id"], r["task"]): r for r in evaluation.evaluate_tasks(c, p, n, vec, encoders, 4, (5,)).collect()}
    assert {k: r["status"] for k, r in out.items() if k[0] == "mean"} == {("mean", "a"): "success", ("mean", "b"): "partial", ("mean", "c"): "success", ("mean", "d"): "failed", ("mean", "e"): "failed"}
    assert out["mean", "a"]["contexts"] == 14 and out["broken", "a"]["status"] == "failed" and out["broken", "a"]["rank_among_models"] is None
    q = np.mean([vectors[i] for i in (3, 11, 12, 35)], axis=0)
    score = lambda i: float(np.dot(vectors[i], q))
    assert out["mean", "a"]["positive_mean"] == pytest.approx(np.mean([score(i) for i in (3, 11, 12)])) and out["mean", "a"]["negative_mean"] == pytest.approx(np.mean([score(4), score(6)]))
    assert out["mean", "b"]["margin"] is None and out["mean", "c"]["negative_mean"] is None
    few = evaluation.heldout_ranks(evaluation.context_counts(c, p, None, vec, {"mean": None}, 4, max_k=1)).where("task = 'a'")
    assert {r["subset"] for r in few.collect()} == {1, 2, 4, 8}
    many = spark.createDataFrame([("z", i) for i in range(13)], "task string, id int")
    with pytest.raises(Exception, match="more than 12"):
        evaluation.context_counts(c, many, None, vec, {"mean": None}, 4).collect()


@pytest.mark.parametrize("part_tokens", [2_000_000, 40])
def test_patterns_of_all_lengths(spark, monkeypatch, part_tokens):
    """One part of the dictionary, and many: coverage, exclusive tags and mining against plain loops."""
    monkeypatch.setattr(patterns, "PART_TOKENS", part_tokens)
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"t{k}é" for k in rng.integers(0, 4, int(rng.integers(0, 40))))) for i in range(25)] + [(50, None), (51, "Ω ω —")]
    toks = patterns.tokens(spark.createDataFrame(texts, "id int, text string"), "id", "text")
    lists = {r["id"]: r["tokens"] for r in toks.collect()}
    found = patterns.mine_up_to(toks, 3, 6)
    counts = {}
    for i, w in lists.items():
        for n in (1, 2, 3):
            for s in range(len(w) - n + 1):
                counts.setdefault(" ".join(w[s : s + n]), set()).add(i)
    frequent = {p: ids for p, ids in counts.items() if len(ids) >= 6}
    got = {r["pattern"]: (r["length"], r["docs"], r["sources"]) for r in found.collect()}
    assert got == {p: (p.count(" ") + 1, len(ids), ",".join(map(str, sorted(ids)))) for p, ids in frequent.items()}
    dictionary = found.where("docs % 2 = 0").select("pattern", "pattern_id")
    ids = {r["pattern"]: r["pattern_id"] for r in dictionary.collect()}
    hits = {i: [(ids[p], s, n) for s in range(len(w)) for n in (1, 2, 3) if s + n <= len(w) and (p := " ".join(w[s : s + n])) in ids] for i, w in lists.items()}
    assert sorted((r["id"], r["pattern_id"], r["start"], r["length"]) for r in patterns.hits(toks, dictionary).collect()) == sorted((i, *h) for i, hs in hits.items() for h in hs)
    size = {r["id"]: (r["n_tokens"], r["n_hits"], r["size"]) for r in patterns.coverage_size(toks, dictionary).collect()}
    taken = set()
    for i, w in lists.items():
        covered = {p for _, s, n in hits[i] for p in range(s, s + n)}
        assert size[i] == (len(w), len(hits[i]), len(hits[i]) + len(w) - len(covered))
        used = set()
        for name, s, n in sorted(hits[i]):
            if used.isdisjoint(range(s, s + n)):
                used.update(range(s, s + n))
                taken.add((i, s, n, name))
    assert {tuple(r) for r in patterns.tag_exclusive(toks, dictionary).collect()} == taken
    assert patterns.coverage_size(toks, dictionary.limit(0)).agg(F.sum("n_hits")).first()[0] == 0
    assert patterns.tag_exclusive(toks.limit(0), dictionary).count() == 0


def test_counts_of_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines ""quoted"""\n\n2,x\n')
    (tmp_path / "b.csv").write_text("id,text\n")
    (tmp_path / "c.csv").write_text("")
    got = {r["name"]: r["rows"] for r in workspace.row_counts(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": 2, "b.csv": 0}
