"""Tolerant text tables and .npz folders."""

import numpy as np
import pytest

from graphmine import sources
from graphmine.sources import npz, text_tables


def test_tolerant_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿CID , isosmiles,x\n1,C,é\n2,"two\nlines"\n\n3,a,b,c\n,nan,\n'.encode())
    (tmp_path / "b.tsv").write_bytes("id\tisosmiles\n7\tcaf\xe9, ol\xe9\n8\\\t9\tz\n".encode("cp1252"))
    (tmp_path / "c.csv").write_text("other,isosmiles\n1,2\n")
    (tmp_path / "d.csv").write_text("")
    for i in range(30):
        (tmp_path / f"many{i}.csv").write_text(f"cid,isosmiles\n{i},t{i}\n")
    df = text_tables.tolerant_tables(spark, str(tmp_path), {"cid": ["id"], "isosmiles": []})
    good = {(r["source_file"], r["row_index"]): (r["cid"], r["isosmiles"], r["encoding"]) for r in text_tables.good_rows(df).collect()}
    assert good[("a.csv", 0)] == ("1", "C", "utf-8-sig") and good[("a.csv", 1)] == ("2", "two\nlines", "utf-8-sig") and good[("a.csv", 3)] == (None, "nan", "utf-8-sig")
    assert good[("b.tsv", 0)] == ("7", "café, olé", "cp1252") and good[("b.tsv", 1)][:2] == ("8\t9", "z") and good[("many7.csv", 0)][:2] == ("7", "t7")
    bad = {(r["source_file"], r["row_index"], r["raw"]) for r in text_tables.bad_lines(df).collect()}
    assert ("a.csv", 2, "3,a,b,c") in bad and ("c.csv", None, None) in bad and len([b for b in bad if b[0][0] in "abc"]) == 2
    rows, lost = sources.delimited(spark, str(tmp_path / "b.tsv"), {"id": []}, ("ascii",))
    assert rows.count() == 0 and lost.first()["error"] == "no encoding reads the file"
    named = sources.source_rows(spark, [str(tmp_path / "a.csv"), str(tmp_path / "c.csv")], limit=5)
    assert [tuple(r) for r in named.collect()] == [("1", "C", "a.csv", 0), ("2", "two\nlines", "a.csv", 1)]


def test_lines_and_first_filled(spark, tmp_path):
    (tmp_path / "l.txt").write_text(" Zn \n\n Fe\n")
    assert sorted(r["value"] for r in sources.lines(spark, str(tmp_path / "l.txt")).collect()) == ["Fe", "Zn"]
    df = spark.createDataFrame([("", "b"), ("nan", None), ("a", "b")], "new string, old string")
    assert [r["id"] for r in sources.first_filled(df, "id", "new", "none", "old").collect()] == ["b", None, "a"]


def test_npz_round_trip(spark, tmp_path, monkeypatch):
    spark.dataSource.register(npz.NpzVectors)
    rng = np.random.default_rng(1)
    rows = [(f"D{i}", None if i % 5 == 0 else f"téxt {i}", rng.normal(size=6).astype(np.float32).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "id string, text string, vector array<float>").repartition(4)
    path = str(tmp_path / "vectors")
    df.write.format("npz").mode("append").save(path)
    back = spark.read.format("npz").load(path)
    want = sorted((i, t or "", v) for i, t, v in rows)
    assert sorted(tuple(r) for r in back.collect()) == want
    df.limit(10).write.format("npz").mode("append").save(path)
    assert spark.read.format("npz").load(path).count() == 510
    df.write.format("npz").mode("overwrite").save(path)
    assert spark.read.format("npz").load(path).count() == 500 and not [p for p in (tmp_path / "vectors").iterdir() if p.is_dir()]
    # one file of another maker, in slices, and a compressed one
    ids, texts, vectors = np.array([r[0] for r in rows]), np.array([r[1] or "" for r in rows]), np.array([r[2] for r in rows], np.float32)
    for save in (np.savez, np.savez_compressed):
        save(tmp_path / "one.npz", dids=ids, smiles=texts, embeddings=vectors)
        reader = npz.NpzReader(str(tmp_path / "one.npz"))
        monkeypatch.setattr(npz, "SLICE_ROWS", 7)
        got = [tuple(r.values()) for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
        assert len(reader.partitions()) == 72 and sorted(got) == want
    # what a task has written but not committed isn't there
    writer = npz.NpzWriter(path, False)
    first, again = (writer.write(iter([{"id": "x", "text": "y", "vector": [1.0] * 6}])) for _ in range(2))
    assert spark.read.format("npz").load(path).count() == 500
    writer.commit([again])
    assert spark.read.format("npz").load(path).count() == 501 and first.files != again.files
    with pytest.raises(ValueError):
        writer.write(iter([{"id": "x", "text": "y", "vector": None}]))
    writer.abort([])


def test_registry_of_a_workspace(spark, tmp_path):
    from graphmine.sources import registry_scan

    def write(path, text):
        path = tmp_path / path
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    run = "projects/p1/runs/r1/manifests"
    write("projects/p1/project.json", '{"name": "One", "notes": 5}')
    write(f"{run}/run.json", '{"status": "done", "created_at": "2026"}')
    write(f"{run}/ga_binding.json", '{"ga_set_id": "d9", "ga_version_id": "v001", "num_ga": 3}')
    write(f"{run}/step1.json", '{"step_id": "step1", "status": "done", "duration_seconds": 1.5, "exit_code": 0, "inputs": [{"path": "tmp/in.csv"}, "odd"], "outputs": [{"path": "/x/projects/p1/runs/r1/tmp/out.csv"}]}')
    write(f"{run}/pipeline_core.json", '{"step_id": "no step"}')
    write(f"{run}/list.json", "[1, 2]")
    write(f"{run}/broken.json", "{")
    write("projects/p1/runs/r1/tmp/out.csv", "a\n1\n")
    write("projects/p1/runs/r2/manifests/step4_5.json", '{"step_id": "step4_5", "inputs": {"a": 1}}')
    write("projects/p2/runs/r3/log.txt", "x")
    write("ga_sets/d1/ga_set.json", '{"description": "d", "tags": ["a", "b"]}')
    write("ga_sets/d1/versions/v002/ga_version.json", '{"parent_version_id": "v001", "num_ga": 7}')
    write("model_after_tasks/t1/task.json", '{"metal": "Zn", "negative_file": "n.csv"}')
    write("model_after_results/t1/b1/model_selection_summary.csv", "model_id,status,mrr,selection_score,rank_among_models,hit_at_5,hit_at_10,hit_at_20,hit_at_50\nm2,success,0.5,0.5,1,,,,\nm1,success,0.5,0.5,2,,,,\nm3,failed,,,,,,,\nm4,a,b,c,d,e,f,g,h,i\n")
    write("jobs/j1.json", '{"job_type": "run", "status": "ok"}')
    write("hyperparameter_sets/h1/hp_set.json", '{"name": "H"}')
    first, again = (registry_scan.rebuild(spark, str(tmp_path)) for _ in range(2))
    rows = {name: sorted((r.asDict() for r in df.collect()), key=str) for name, df in first.items()}
    assert rows == {name: sorted((r.asDict() for r in df.collect()), key=str) for name, df in again.items()}
    assert [(r["project"], r["name"], r["notes"]) for r in rows["projects"]] == [("p1", "One", "5"), ("p2", "p2", None)]
    assert [(r["run"], r["files"], r["status"]) for r in rows["runs"]] == [("r1", 7, "done"), ("r2", 1, None), ("r3", 1, None)]
    assert [(r["run"], r["status"], r["dictionary"], r["n_rows"]) for r in rows["bindings"]] == [("r1", "bound", "d9", 3), ("r2", "legacy_auto", None, None), ("r3", "missing", None, None)]
    assert [(r["run"], r["step"], r["seconds"], r["exit_code"]) for r in rows["steps"]] == [("r1", "step1", 1.5, 0), ("r2", "step4_5", None, None)]
    assert {(r["role"], r["path"], r["exists"], r["bytes"]) for r in rows["artifacts"]} == {("input", "tmp/in.csv", False, None), ("output", "/x/projects/p1/runs/r1/tmp/out.csv", True, 4)}
    assert [(r["dictionary"], r["status"], r["tags"]) for r in rows["dictionaries"]] == [("d1", "ok", '["a","b"]'), ("d9", "stub", None)]
    assert [(r["version"], r["parent"], r["n_rows"]) for r in rows["versions"]] == [("v002", "v001", 7)]
    assert [(r["task"], r["hub"], r["candidate_file"], r["negative_file"]) for r in rows["tasks"]] == [("t1", "Zn", "candidates.csv", "n.csv")]
    assert [(r["batch"], r["n_models"], r["n_success"], r["best_model"]) for r in rows["batches"]] == [("b1", 3, 2, "m1")]
    assert len(rows["results"]) == 3 and len(rows["jobs"]) == len(rows["parameter_sets"]) == 1
    assert {(r["path"].rsplit("/", 1)[-1], r["error"]) for r in rows["errors"]} == {("list.json", "not an object"), ("broken.json", "not JSON"), ("model_selection_summary.csv", "10 cells, 9 in the header")}
