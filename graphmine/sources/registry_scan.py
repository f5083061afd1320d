"""All registry tables of a workspace folder, from one scan of its documents.

Documents of unlike shape are parsed as VARIANT in one pass, and each kind gives a typed table. What can't be read is a row of
`errors` and stops nothing. Every table is a function of the files alone, so a second rebuild gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmine.functions import artifact_type
from graphmine.sources.tables import save_table
from graphmine.sources.text_tables import bad_lines, good_rows, tolerant_tables

# fixed values: the layout of a workspace
PROJECT, RUN = r"projects/([^/]+)", r"projects/([^/]+)/runs/([^/]+)"
KINDS = {
    "project": rf"^{PROJECT}/project\.json$",
    "run": rf"^{RUN}/manifests/run\.json$",
    "binding": rf"^{RUN}/manifests/ga_binding\.json$",
    "other": rf"^{RUN}/manifests/(?:pipeline_core|pipeline_training|ga_stale_report)\.json$",
    "step": rf"^{RUN}/manifests/([^/]+)\.json$",
    "dictionary": r"^ga_sets/([^/]+)/ga_set\.json$",
    "version": r"^ga_sets/([^/]+)/versions/([^/]+)/ga_version\.json$",
    "task": r"^model_after_tasks/([^/]+)/task\.json$",
    "job": r"^jobs/([^/]+)\.json$",
    "parameters": r"^hyperparameter_sets/([^/]+)/hp_set\.json$",
}
TOPS = "projects|ga_sets|model_after_tasks|model_after_results|jobs|hyperparameter_sets"
SUMMARY = "model_selection_summary.csv"
MEASURES = ("mrr", "hit_at_5", "hit_at_10", "hit_at_20", "hit_at_50", "selection_score")
LEGACY_STEP = "step4_5"


def _rel(path: Column) -> Column:
    """A path below the workspace."""
    return F.regexp_extract(path, rf"(?:^|/)((?:{TOPS})/.*)$", 1)


def _get(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("doc", f"$.{name}", kind)


def _part(kind: str, i: int) -> Column:
    return F.regexp_extract("rel", KINDS[kind], i)


def rebuild(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """projects, runs, bindings, steps, artifacts, dictionaries, versions, tasks, batches, results, jobs, parameter_sets and errors of a workspace folder.

    A run exists if it has any file. A run without a binding document has the status legacy_auto (it has a manifest of the
    mining step) or missing. A dictionary that a binding names and no folder has is a stub. An artifact is an input or output that a step names, with the size of its file if it is in the workspace.
    A batch has the counts of its results, and the best of them by selection score, ties by id.
    """
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    rel = _rel(F.col("path"))
    read = texts.select("value", F.col("_metadata.file_path").alias("path")).withColumn("rel", rel).withColumn("doc", F.try_parse_json("value"))
    which = F.coalesce(*[F.when(F.col("rel").rlike(pattern), kind) for kind, pattern in KINDS.items()])
    is_object = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
    docs = save_table(read.select("rel", "doc", which.alias("kind"), is_object.alias("ok")).where("kind is not null"), "documents")
    files = save_table(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(rel.alias("rel"), F.col("length").alias("bytes")).where("rel <> ''"), "files")  # contents aren't read

    def of(kind: str) -> DataFrame:
        return docs.where((F.col("kind") == kind) & F.col("ok"))

    run_files = files.where(F.col("rel").rlike(rf"^{RUN}/")).select(F.regexp_extract("rel", RUN, 1).alias("project"), F.regexp_extract("rel", RUN, 2).alias("run"), "rel")
    seen = run_files.groupBy("project", "run").agg(F.count("*").alias("files"), F.max(F.col("rel").endswith(f"/manifests/{LEGACY_STEP}.json")).alias("legacy"))
    named = of("project").select(_part("project", 1).alias("project"), _get("name").alias("name"), _get("created_at").alias("created_at"), _get("notes").alias("notes"))
    projects = files.where(F.col("rel").rlike(rf"^{PROJECT}/")).select(F.regexp_extract("rel", PROJECT, 1).alias("project")).distinct().join(named, "project", "left").withColumn("name", F.coalesce("name", "project"))
    run_docs = of("run").select(_part("run", 1).alias("project"), _part("run", 2).alias("run"), _get("created_at").alias("created_at"), _get("status").alias("status"))
    bound = of("binding").select(_part("binding", 1).alias("project"), _part("binding", 2).alias("run"), _get("ga_set_id").alias("dictionary"), _get("ga_version_id").alias("version"), _get("checksum").alias("checksum"), _get("num_ga", "long").alias("n_rows"), F.coalesce(_get("status"), F.lit("bound")).alias("status"))
    absent = F.when(F.col("legacy"), "legacy_auto").otherwise("missing")
    bindings = seen.select("project", "run", "legacy").join(bound, ["project", "run"], "left").withColumn("status", F.coalesce("status", absent)).drop("legacy")
    step_id = _get("step_id")
    steps = of("step").where(step_id.isNotNull()).select(_part("step", 1).alias("project"), _part("step", 2).alias("run"), step_id.alias("step"), F.coalesce(_get("started_at"), F.lit("")).alias("started_at"), _get("finished_at").alias("finished_at"), _get("status").alias("status"), _get("duration_seconds", "double").alias("seconds"), _get("exit_code", "long").alias("exit_code"), _get("error").alias("error"), "doc")
    # of two manifests of one step and start the later file counts
    keyed = steps.groupBy("project", "run", "step", "started_at").agg(*[F.max_by(c, F.coalesce("finished_at", F.lit(""))).alias(c) for c in ("finished_at", "status", "seconds", "exit_code", "error")])
    entries = None
    for key, role in (("inputs", "input"), ("outputs", "output")):
        rows = steps.select("project", "run", "step", F.lit(role).alias("role"), F.explode(F.try_variant_get("doc", f"$.{key}", "array<variant>")).alias("entry")).withColumn("path", F.try_variant_get("entry", "$.path", "string"))
        entries = rows if entries is None else entries.union(rows)
    told = entries.where("path is not null").select("project", "run", "step", "role", "path").distinct()
    artifacts = told.withColumn("rel", F.coalesce(F.nullif(_rel(F.col("path")), F.lit("")), F.concat_ws("/", F.lit("projects"), "project", F.lit("runs"), "run", "path"))).join(files, "rel", "left").select("project", "run", "step", "role", "path", artifact_type(F.col("path")).alias("type"), F.col("bytes").isNotNull().alias("exists"), "bytes")
    own = of("dictionary").select(_part("dictionary", 1).alias("dictionary"), F.coalesce(_get("name"), _part("dictionary", 1)).alias("name"), _get("description").alias("description"), F.to_json(F.try_variant_get("doc", "$.tags", "array<string>")).alias("tags"), F.lit("ok").alias("status"))
    stubs = bound.select("dictionary").where("dictionary is not null").distinct().join(own, "dictionary", "left_anti")
    dictionaries = own.union(stubs.select("dictionary", F.col("dictionary").alias("name"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("stub")))
    versions = of("version").select(_part("version", 1).alias("dictionary"), _part("version", 2).alias("version"), _get("parent_version_id").alias("parent"), _get("created_at").alias("created_at"), _get("num_ga", "long").alias("n_rows"), _get("checksum").alias("checksum"), _get("notes").alias("notes"))
    tasks = of("task").select(F.coalesce(_get("task_id"), _part("task", 1)).alias("task"), _get("metal").alias("hub"), F.coalesce(_get("embedding"), F.lit("ecfp")).alias("embedding"), *[F.coalesce(_get(f"{k}_file"), F.lit(f"{k}s.csv")).alias(f"{k}_file") for k in ("candidate", "positive", "negative")], _get("notes").alias("notes"))
    jobs = of("job").select(_part("job", 1).alias("job"), _get("job_type").alias("type"), _get("status").alias("status"), _get("created_at").alias("created_at"), _get("error").alias("error"))
    sets = of("parameters").select(_part("parameters", 1).alias("parameter_set"), F.coalesce(_get("name"), _part("parameters", 1)).alias("name"), _get("description").alias("description"))
    results, batches, lost = _results(spark, root, files)
    errors = docs.where(~F.col("ok")).select(F.col("rel").alias("path"), F.when(F.col("doc").isNull(), "not JSON").otherwise("not an object").alias("error"))
    runs = seen.drop("legacy").join(run_docs, ["project", "run"], "left")
    return {"projects": projects, "runs": runs, "bindings": bindings, "steps": keyed, "artifacts": artifacts, "dictionaries": dictionaries, "versions": versions, "tasks": tasks, "batches": batches, "results": results, "jobs": jobs, "parameter_sets": sets, "errors": errors if lost is None else errors.union(lost)}


def _results(spark: SparkSession, root: str, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(results, batches, what couldn't be read) of the summaries of evaluated batches, model_after_results/task/batch/SUMMARY."""
    where = r"^model_after_results/([^/]+)/([^/]+)/"
    kinds = "task string, batch string, model string, status string, rank int, " + ", ".join(f"{m} double" for m in MEASURES)
    lost = None
    if files.where(F.col("rel").rlike(where + SUMMARY.replace(".", r"\.") + "$")).isEmpty():
        results = spark.createDataFrame([], kinds)
    else:
        wanted = {c: [] for c in ("model_id", "status", "rank_among_models", *MEASURES)}
        # the files of that name two folders below
        read = tolerant_tables(spark, f"{root.rstrip('/')}/model_after_results/*/*/{SUMMARY}", wanted, file_path=True)
        read = read.withColumn("rel", _rel(F.col("source_file")))
        lost = bad_lines(read.withColumn("source_file", F.col("rel"))).select(F.col("source_file").alias("path"), "error")
        at = [F.regexp_extract("rel", where, i).alias(n) for i, n in ((1, "task"), (2, "batch"))]
        results = good_rows(read).where("model_id is not null").select(*at, F.col("model_id").alias("model"), "status", F.col("rank_among_models").try_cast("int").alias("rank"), *[F.col(m).try_cast("double").alias(m) for m in MEASURES])
    batches = results.groupBy("task", "batch").agg(F.count("*").alias("n_models"), F.count_if(F.col("status") == "success").alias("n_success"), F.max("selection_score").alias("best_score"))
    heads = results.join(batches.select("task", "batch", F.col("best_score").alias("selection_score")), ["task", "batch", "selection_score"]).groupBy("task", "batch").agg(F.min("model").alias("best_model"))
    return results, batches.join(heads, ["task", "batch"], "left"), lost
