"""Hand-made cases with known answers, and invariants."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmine import functions as fn
from graphmine import sources
from graphmine.operators import clean, graph, models, patterns, rank, registry, sampling, vectors
from graphmine.streaming import upsert_stream


@pytest.fixture
def edges(spark):
    return spark.createDataFrame([("a", "u"), ("a", "v"), ("b", "u"), ("b", "v"), ("c", "v"), ("d", "x")], "item string, feature string")


def test_weighted_jaccard(edges):
    w = graph.feature_weights(edges)
    weights = {r["feature"]: round(r["weight"], 6) for r in w.collect()}
    assert weights == {"u": round(0.693147180, 6), "v": round(0.2876820724, 6), "x": round(1.3862943611, 6)}
    d = {(r["target"], r["item"]): r["similarity"] for r in graph.shared_feature_pairs(edges, w, 10).collect()}
    assert d[("a", "b")] == pytest.approx(1.0)
    assert 0 < d[("a", "c")] < 1
    assert ("a", "d") not in d


def test_candidates_bound(spark, edges):
    sizes = spark.createDataFrame([("a", 1), ("b", 50), ("c", None)], "item string, size int")
    got = {tuple(r) for r in graph.candidates(edges, sizes, 3, 10, 1).collect()}
    # v has three items and so is common: of its items only a is small enough
    assert got == {("a", "b"), ("b", "a"), ("c", "a")}


def test_distances_keep_common_features(spark):
    """The flagship's pairs are those of candidates_sampled, with each common feature sampled and not left out."""
    from graphmine.plans import catalogue

    t = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    want = {tuple(r) for r in catalogue.QUERIES["candidates_sampled"](spark, "/root/testdata/sf0.001").collect()}
    own = {r["item"] for r in catalogue.hub_pairs(t).select("item").distinct().collect()}
    got = {tuple(r) for r in catalogue.flagship(t).select("target", "item").distinct().collect()}
    assert got == {p for p in want if p[0] in own}
    assert len(got) > catalogue._distances(t).count()


def test_minimal_sets(spark):
    rows = [("1", ["p"], 1), ("2", ["p", "q"], 2), ("3", ["q", "r"], 2), ("4", ["p", "q", "r"], 3), ("5", ["q", "r"], 2)]
    got = {r["id"] for r in graph.minimal_sets(spark.createDataFrame(rows, "id string, elems array<string>, size int")).collect()}
    assert got == {"1", "3", "5"}


def test_samples(spark):
    rows = spark.range(1000).select((F.col("id") % 5).alias("g"), "id", F.lit(1.0).alias("w"))
    one = sampling.weighted_sample(rows, ["g"], "id", F.col("w"), 16, 7)
    assert {r["n"] for r in one.groupBy("g").agg(F.count("*").alias("n")).collect()} == {16}
    again = sampling.weighted_sample(rows.repartition(13), ["g"], "id", F.col("w"), 16, 7)
    assert one.exceptAll(again).isEmpty()
    split = sampling.split_targets(rows, "id", 3)
    assert split.count() == 1000 and split.select("id").distinct().count() == 1000


def test_unrelated_share_no_feature(spark, edges):
    got = {tuple(r) for r in sampling.unrelated_sample(edges.select("item"), edges, 5, k=2).collect()}
    assert got and all({"d"} & set(p) for p in got)


def test_unrelated_are_k_where_k_exist(spark):
    """Targets related to most items still get k others, or all that exist."""
    rows = [(i, f) for i in range(200) for f in (["big"] if i < 190 else [f"own{i}"])] + [(i, "wide") for i in (0, 195, 196, 197)]
    edges = spark.createDataFrame(rows, "item long, feature string")
    features = {}
    for i, f in rows:
        features.setdefault(i, set()).add(f)
    got = {}
    for r in sampling.unrelated_sample(edges.select("item"), edges, 5, k=8, words=1, growth=2).collect():
        got.setdefault(r["target"], set()).add(r["item"])
    for i in features:
        free = {j for j in features if j != i and not features[i] & features[j]}
        assert got[i] <= free and len(got[i]) == min(8, len(free)), i


def test_rank_metrics(spark):
    rows = spark.createDataFrame([("c", i, 1.0 / i) for i in range(1, 5)], "context string, id int, score double")
    held = spark.createDataFrame([("c", 2), ("c", 9)], "context string, id int")
    m = rank.heldout_metrics(rank.rank_rows(rows, "context", "score", "id"), "context", held, (1, 2)).first()
    assert m["mrr"] == pytest.approx((1 / 2 + 1 / 5) / 2) and m["hit_1"] == 0 and m["hit_2"] == 0.5


def test_patterns(spark):
    toks = patterns.tokens(spark.createDataFrame([(1, "a b c a b c d"), (2, "a b c"), (3, None)], "id int, text string"), "id", "text")
    d = patterns.mine(toks, 3, 2)
    assert [r["pattern"] for r in d.collect()] == ["a b c"]
    size = {r["id"]: (r["n_hits"], r["size"]) for r in patterns.coverage_size(toks, d).collect()}
    assert size == {1: (2, 3), 2: (1, 1), 3: (0, 0)}
    assert patterns.tag_exclusive(toks, d).count() == 3
    f = {(r["id"], r["start"]): (r["frag_start"], r["frag_end"]) for r in patterns.tag_fragments(toks, d, patterns.mine(toks, 2, 1)).collect()}
    assert f[(1, 3)] == (1, 6)


def test_registry(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, t int")
    b = spark.createDataFrame([(2, "z", 2), (3, "w", 2)], "k int, v string, t int")
    once = registry.upsert_latest(a, b, ["k"], [F.desc("t")])
    assert {tuple(r) for r in once.collect()} == {(1, "x", 1), (2, "z", 2), (3, "w", 2)}
    assert registry.upsert_latest(once, b, ["k"], [F.desc("t")]).exceptAll(once).isEmpty()
    with pytest.raises(Exception, match="exists already"):
        registry.append_version(a, b, ["k"]).collect()
    rec = {(r["k"], r["status"], r["column"]) for r in registry.reconcile(a, b, ["k"], ["v"]).collect()}
    assert rec == {(1, "missing_right", ""), (2, "mismatch", "v"), (3, "missing_left", "")}
    assert registry.table_digest(a).first()["digest"] == registry.table_digest(a.orderBy(F.desc("k"))).first()["digest"]


def test_parsers(spark):
    row = spark.createDataFrame([("TRUE", "[b, 'a']", "l2_x", "12.7", "[{'Zn':'0'},{'As':'3.0'},{'Zn':'2'}]")], "a string, b string, c string, d string, e string")
    got = row.select(fn.truth(F.col("a")), fn.list_key(F.col("b")), fn.strip_layer(F.col("c")), fn.size_number(F.col("d")), clean.literal_symbols(F.col("e")), fn.pattern_id(F.lit("c1ccccc1")), fn.artifact_type(F.lit("x/y.CSV"))).first()
    assert tuple(got) == (True, "a,b", "x", 12, ["Zn", "As"], "G874135", "csv")


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿cid, isosmiles\n1,C\n,CC\n3,nan\n4,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,other\n1,2\n")
    rows = sources.source_rows(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert [(r["cid"], r["isosmiles"], r["row_index"]) for r in rows.orderBy("row_index").collect()] == [("1", "C", 0), ("unknown_1", "CC", 1)]
    (tmp_path / "m.json").write_text(json.dumps({"Zn": ["L3_1", "2"], "Fe": ["2"]}))
    assert {tuple(r) for r in sources.hub_items(spark, str(tmp_path / "m.json")).collect()} == {("Zn", "1"), ("Zn", "2"), ("Fe", "2")}
    (tmp_path / "s.json").write_text(json.dumps({"step_id": "s1", "status": "ok"}))
    (tmp_path / "bad.json").write_text("{")
    assert [r["step_id"] for r in sources.manifests(spark, str(tmp_path / "*.json")).collect()] == ["s1"]
    assert sources.preview(lambda: spark.read.csv(str(tmp_path / "none.csv")))[1]
    v = sources.hub_vectors(spark.createDataFrame([("Zn", "1.5", "x")], "element string, a string, b string"), "element").first()
    assert v["vector"] == [1.5, 0.0]
    sources.write_sorted(spark.range(100), str(tmp_path / "o"), "id")
    assert spark.read.parquet(str(tmp_path / "o")).count() == 100
    assert sources.inventory(spark, str(tmp_path / "*.csv")).count() == 2


def test_vectors(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, None), (3, "abcd")], "id int, text string")
    assert vectors.fingerprints(df, "text").count() == 1
    got = vectors.embed_items(df, "id", "text", lambda xs: [[float(len(x)), 1.0] for x in xs], 2).collect()
    assert sorted(r["id"] for r in got) == [1, 3]
    failing = vectors.embed_report(df.union(df.selectExpr("id + 10", "concat(text, 'e')")), "id", "text", lambda xs: [[1.0] if "e" in x else 1 / 0 for x in xs], 1)
    assert {r["id"]: r["error"] for r in failing.collect()} == {1: "ZeroDivisionError: division by zero", 2: "no text", 3: "ZeroDivisionError: division by zero", 11: None, 12: "no text", 13: None}
    bits = df.limit(1).selectExpr("array(0, 9, 2047) as b", "cast(array() as array<int>) as none").select(vectors.packed_bits(F.col("b")).alias("p"), vectors.packed_bits(F.col("none"), 16).alias("q")).first()
    raw = base64.b64decode(bits["p"], validate=True)
    assert np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))).tolist() == [0, 9, 2047] and bits["q"] == "AAA="


def test_scores_of_all_contexts(spark):
    contexts = spark.range(1003).select(F.col("id").alias("context"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    rows = spark.createDataFrame([(7, [1.0, 2.0]), (8, [0.5, -1.0])], "id long, vector array<double>")
    got = models.score_candidates(contexts, rows, {"m": models.Encoder.of_size(2, 1)}, 2).select("context", "id").collect()
    assert len(got) == 2006 and {tuple(r) for r in got} == {(c, i) for c in range(1003) for i in (7, 8)}
    assert models.score_candidates(contexts.limit(0), rows, {"m": models.Encoder.of_size(2, 1)}, 2).isEmpty()


def test_stream(spark, tmp_path):
    for i, rows in enumerate(([(1, "a", 1)], [(1, "b", 2), (2, "c", 2)])):
        spark.createDataFrame(rows, "k int, v string, t int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k int, v string, t int").parquet(str(tmp_path / "in"))
        upsert_stream(stream, str(tmp_path / "out"), ["k"], "t", str(tmp_path / "cp")).awaitTermination(60)
        got = {tuple(r) for r in spark.read.parquet(str(tmp_path / f"out/v{i}")).collect()}
    assert got == {(1, "b", 2), (2, "c", 2)}
