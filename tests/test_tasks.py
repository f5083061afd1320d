"""Bundles, workspaces, statistics and other files; operators that SQL doesn't state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmine.operators import models, patterns, registry, tasks
from graphmine.sources import workspace


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_bundle(spark, tmp_path):
    folder = tmp_path / "zn_task"
    write(folder / "task.json", '{"metal": " Zn ", "candidate_file": "pool.csv", "notes": "n"}')
    write(folder / "pool.csv", '\ufeffcandidate_id,SMILES,did,name,source\nC7,CC,,"two\nlines",s1\n,,,lost,\n,OO,D9,,\nC9, ,D7, x ,s2\n')
    write(folder / "positives.csv", "positive_id,smiles,did\n,CC,D1\nP3,,D2\n")
    write(folder / "negatives.csv", "negative_id,smiles,did\nN1,C,\n")
    bundle = workspace.load_task_bundle(spark, str(folder))
    assert {k: v for k, v in bundle.spec.items() if k != "document"} == {"task_id": "zn_task", "hub": "Zn", "embedding": "ecfp", "notes": "n"}
    assert sorted(tuple(r) for r in bundle.candidates.collect()) == [("2", "OO", "D9", None, None), ("C7", "CC", None, "two\nlines", "s1"), ("C9", None, "D7", "x", "s2")]
    assert sorted(tuple(r)[:3] for r in bundle.positives.collect()) == [("0", "CC", "D1"), ("P3", None, "D2")]
    assert [tuple(r)[:3] for r in bundle.negatives.collect()] == [("N1", "C", None)]
    (folder / "negatives.csv").unlink()
    assert workspace.load_task_bundle(spark, str(folder)).negatives.count() == 0
    for name, text, error in (("positives.csv", "smiles,did\n,\n", ValueError), ("task.json", "{}", ValueError), ("task.json", '{"metal": "Zn", "embedding": "other"}', ValueError), ("task.json", '{"metal": "Zn"}', FileNotFoundError)):
        write(folder / name, text)
        with pytest.raises(error):
            workspace.load_task_bundle(spark, str(folder))


def test_ordinals_over_partitions(spark):
    rows = workspace.with_ordinal(spark.range(1000).repartition(7)).select("ordinal").collect()
    assert sorted(r[0] for r in rows) == list(range(1, 1001))


def test_registry_rebuild(spark, tmp_path):
    write(tmp_path / "projects/p1/runs/r1/a.json", '{"step_id": "s1", "status": "done"}')
    write(tmp_path / "projects/p1/runs/r1/b.json", '{"step_id": "s2", "status": "failed"}')
    write(tmp_path / "projects/p2/x/runs/r9/c.json", '{"step_id": "s1"}')
    write(tmp_path / "projects/p2/x/runs/r9/d.json", "{broken")
    first, again = (workspace.rebuild_registry(spark, str(tmp_path)) for _ in range(2))
    assert sorted(tuple(r) for r in first["runs"].collect()) == [("p1", "r1", 2, 1), ("p2", "r9", 1, 0)]
    assert sorted(r[0] for r in first["projects"].collect()) == ["p1", "p2"]
    assert [r["path"].endswith("d.json") for r in first["errors"].collect()] == [True]
    for name in first:
        assert sorted(map(str, first[name].collect())) == sorted(map(str, again[name].collect()))


def test_counts_parts_and_graph_files(spark, tmp_path):
    write(tmp_path / "in/a.csv", "x\n1\n2\n")
    write(tmp_path / "in/b.csv", "x\n")
    assert {r["name"]: r["rows"] for r in workspace.row_counts(spark, str(tmp_path / "in")).collect()} == {"a.csv": 2, "b.csv": 0}
    rows = spark.range(10)
    workspace.write_parts(rows, {"low": F.col("id") < 3, "odd": F.col("id") % 2 == 1}, str(tmp_path / "out"))
    assert [spark.read.parquet(str(tmp_path / "out" / n)).count() for n in ("low", "odd")] == [3, 5]
    seen, counted = workspace.counted(rows, "c", odd=F.count_if(F.col("id") % 2 == 1))
    assert seen.count() == 10 and counted.get == {"rows": 10, "odd": 5}
    nodes = workspace.node_rows(rows.withColumn("name", F.lit("n")), "id", "L3", name="string")
    edges = workspace.edge_rows(rows.withColumn("b", F.col("id") % 2), "id", "L3", "b", "M", "HAS")
    workspace.write_graph({"items": nodes}, {"has": edges}, str(tmp_path / "graph"))
    back = spark.read.csv(str(tmp_path / "graph/edges_has"), header=True)
    assert back.columns == [":START_ID(L3)", ":END_ID(M)", ":TYPE"] and back.count() == 10
    assert spark.read.csv(str(tmp_path / "graph/nodes_items"), header=True).columns == ["id:ID(L3)", "name:string"]


def test_precomputed(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert workspace.precomputed_or(spark, str(tmp_path / "t"), lambda: spark.range(9)).count() == 3
    assert workspace.precomputed_or(spark, str(tmp_path / "none"), lambda: spark.range(9)).count() == 9


def test_broken_vectors_are_null(spark):
    rows = spark.createDataFrame([(1, "bm90IGEgZmlsZQ=="), (2, None), (3, "###")], "id long, npy string")
    assert [r["vector"] for r in workspace.unpack_vectors(rows).collect()] == [None] * 3
    rows = spark.createDataFrame([(1, [1.0, 2.5]), (2, None)], "id long, vector array<float>")
    assert {r["id"]: r["vector"] for r in workspace.unpack_vectors(workspace.pack_vectors(rows).drop("vector")).collect()} == {1: [1.0, 2.5], 2: None}


def test_tag_exclusive_is_greedy(spark):
    """Against a plain loop over dictionary order and place."""
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"t{k}" for k in rng.integers(0, 4, 60))) for i in range(12)]
    toks = patterns.tokens(spark.createDataFrame(texts, "id long, text string"), "id", "text")
    dictionary = patterns.mine(toks, 3, 3)
    got = sorted(tuple(r) for r in patterns.tag_exclusive(toks, dictionary).select("id", "start", "pattern_id").collect())
    ids, want = {r["pattern"]: r["pattern_id"] for r in dictionary.collect()}, []
    for i, text in texts:
        w = text.split()
        found = sorted((ids[p], s) for s in range(len(w) - 2) if (p := " ".join(w[s : s + 3])) in ids)
        used = set()
        for name, s in found:
            if used.isdisjoint(range(s, s + 3)):
                used.update(range(s, s + 3))
                want.append((i, s, name))
    assert got == sorted(want)


def test_encoders_are_isolated(spark):
    contexts = spark.createDataFrame([(1, [1.0, 0.0, 2.0, 1.0])], "context long, vector array<double>")
    items = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=4).tolist()) for i in range(30)], "id long, vector array<double>")
    positives = spark.createDataFrame([(1, 3), (1, 99)], "context long, id long")
    broken = models.Encoder.of_size(4, 3)
    broken.weights[0] = broken.weights[0] * float("nan")
    got = {r["model_id"]: r for r in tasks.evaluate_encoders(contexts, items, positives, {"gelu": models.Encoder.of_size(4, 1, "gelu"), "relu": models.Encoder.of_size(4, 2), "broken": broken}, 4).collect()}
    assert got["broken"]["status"] == "failed" and got["broken"]["rank_among_models"] is None
    assert {got["gelu"]["rank_among_models"], got["relu"]["rank_among_models"]} == {1, 2}
    # the positive without a vector comes after all 30
    x = models.Encoder.of_size(4, 1, "gelu")(np.array([[1.0, 0.0, 2.0, 1.0]]))[0]
    scores = {r["id"]: float(np.dot(r["vector"], x)) for r in items.collect()}
    place = sorted(scores, key=lambda i: (-scores[i], i)).index(3) + 1
    assert got["gelu"]["mrr"] == pytest.approx((1 / place + 1 / 31) / 2)


def test_complete_records(spark):
    rows = spark.createDataFrame([(1, [1, 2], [3]), (2, [1], [])], "id long, nl array<int>, ul array<int>")
    whole, told = tasks.complete_records(rows, 4)
    assert [r["id"] for r in whole.collect()] == [1] and tuple(told.first()) == (1, 1)


def test_nested_fields(spark):
    rows = spark.sql("select 1 as id, named_struct('a', 1, 'b', named_struct('c', 'x', 'd', cast(null as string))) as s")
    assert sorted(tuple(r) for r in registry.flatten_nested(rows, "id", "s", ["b.c"]).collect()) == [(1, "a", "1", False), (1, "b.c", "x", True)]
