"""Queries of tasks, workspaces and records on the given tables, each with its SQL; registered beside those of catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphmine.functions import composite_id
from graphmine.operators import clean, digests, evaluation, pair_stats, patterns, quantiles, registry, sampling, tasks
from graphmine.plans.catalogue import _REC as REC
from graphmine.plans.catalogue import C, DRAWN_D, H, SEED, _NOTATION, _drawn_blocks, _hub_bits, _notation, _records_of, _scored, edges_of, hash_sql, query, r6, reconciled_tables, uniform_sql
from graphmine.sources import workspace

_SLOT = "('0x' || substr({0}, 1, 12))::BIGINT"

# records ----------------------------------------------------------------

LABELLED = (
    f"{DRAWN_D}, {H}, st AS (SELECT target, quantile_cont(1 - sim, 0.1) AS lo, quantile_cont(1 - sim, 0.9) AS hi FROM d GROUP BY target), "
    "lb AS (SELECT d.target, o.hub, d.item, 1 - sim AS dist, CASE WHEN k.item IS NULL THEN 'NL' ELSE 'KL' END AS label FROM d JOIN h o ON o.item = d.target LEFT JOIN h k ON k.hub = o.hub AND k.item = d.item), "
    "wt AS (SELECT lb.*, CASE WHEN hi = lo THEN 0 ELSE greatest(0, least(1, (dist - lo) / (hi - lo))) END AS s FROM lb JOIN st USING (target)), "
    f"ky AS (SELECT *, ln(greatest({uniform_sql('target', 'hub', 'label', 'item')}, 1e-300)) / CASE WHEN label = 'KL' THEN exp(-4.0 * s) ELSE 0.7 * exp(-2.0 * s) + 0.3 END AS key FROM wt), "
    "sa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, hub, label ORDER BY key DESC, item) AS r FROM ky) WHERE r <= CASE WHEN label = 'KL' THEN 16 ELSE 128 END)"
)
UNRELATED = (
    f"n AS (SELECT count(*) AS n FROM part), sl2 AS (SELECT p_partkey AS item, {_SLOT.format(hash_sql('p_partkey'))} % (SELECT n FROM n) AS slot FROM part), "
    f"w2 AS (SELECT p_partkey AS target, j, {_SLOT.format(hash_sql('p_partkey', 'j'))} % (SELECT n FROM n) AS slot FROM part, (SELECT unnest(range(1, 65)) AS j)), "
    "d2 AS (SELECT target, sl2.item, min(j) AS j FROM w2 JOIN sl2 USING (slot) WHERE sl2.item <> target GROUP BY ALL), "
    "re AS (SELECT DISTINCT d2.target, d2.item FROM d2 JOIN e a ON a.item = d2.target JOIN e b ON b.item = d2.item AND b.feature = a.feature), "
    "f2 AS (SELECT d2.* FROM d2 LEFT JOIN re USING (target, item) WHERE re.target IS NULL), "
    "un AS (SELECT target, item FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY j, item) AS r FROM f2) WHERE r <= 32)"
)


def _labelled(t) -> DataFrame:
    hubs, traits = _hub_bits(t)
    return pair_stats.labelled_sample(_drawn_blocks(t, traits), hubs, SEED)


@query(f"WITH {LABELLED} SELECT target, hub, label, item FROM sa")
def labelled_sample(t):
    return _labelled(t).select("target", "hub", "label", "item")


_LISTS = (
    f"{LABELLED}, {UNRELATED}, ls AS (SELECT target, hub, coalesce(string_agg(item::VARCHAR, ';' ORDER BY item) FILTER (label = 'KL'), '') AS kl, coalesce(string_agg(item::VARCHAR, ';' ORDER BY item) FILTER (label = 'NL'), '') AS nl, "
    "count(*) FILTER (label = 'NL') AS n_nl FROM sa GROUP BY target, hub), ul AS (SELECT target, string_agg(item::VARCHAR, ';' ORDER BY item) AS ul, count(*) AS n_ul FROM un GROUP BY target)"
)


def _records(t) -> DataFrame:
    items = t("part").select(F.col("p_partkey").alias("item"))
    return _records_of(t, sampling.unrelated_drawn(items, edges_of(t), SEED))


def _joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c)


@query(f"WITH {_LISTS} SELECT target, hub, CASE WHEN {uniform_sql('target')} < 0.7 THEN 'train' WHEN {uniform_sql('target')} < 0.8 THEN 'valid' ELSE 'test' END AS split, kl, nl, coalesce(ul, '') AS ul FROM ls LEFT JOIN ul USING (target)")
def record_lists(t):
    return _records(t).select("target", "hub", "split", *[_joined(c) for c in ("kl", "nl", "ul")])


@query(f"WITH {_LISTS} SELECT target, hub FROM ls LEFT JOIN ul USING (target) WHERE 1 + n_nl + coalesce(n_ul, 0) = 161")
def complete_records(t):
    return tasks.complete_records(_records(t), 161)[0].select("target", "hub")


_POOL = ", ".join(f"count(dist) FILTER (label = '{x}') AS {n}_n, round(min(dist) FILTER (label = '{x}'), 6) AS {n}_min, round(avg(dist) FILTER (label = '{x}'), 6) AS {n}_mean, round(quantile_cont(dist, 0.1) FILTER (label = '{x}'), 6) AS {n}_q10, round(quantile_cont(dist, 0.5) FILTER (label = '{x}'), 6) AS {n}_median, round(quantile_cont(dist, 0.9) FILTER (label = '{x}'), 6) AS {n}_q90" for x, n in (("KL", "known"), ("NL", "other")))


@query(f"WITH {LABELLED}, wh AS (SELECT target, hub, count(*) FILTER (label = 'KL') AS n_known, count(*) FILTER (label = 'NL') AS n_other FROM lb GROUP BY ALL), po AS (SELECT target, hub, {_POOL} FROM sa GROUP BY target, hub) SELECT wh.*, round(CASE WHEN n_other > 0 THEN n_known / n_other END, 6) AS ratio, po.* EXCLUDE (target, hub) FROM wh LEFT JOIN po USING (target, hub)")
def pool_report(t):
    hubs, traits = _hub_bits(t)
    out = pair_stats.pool_report(_drawn_blocks(t, traits), hubs, SEED)
    whole = ("target", "hub", "n_known", "n_other", "known_n", "other_n")
    return out.select(*[c if c in whole else r6(F.col(c), c) for c in out.columns])


# tasks ------------------------------------------------------------------


@query("WITH p AS (SELECT doc_id AS id, false AS p FROM documents UNION ALL SELECT doc_id, true FROM labels WHERE quality = 1) SELECT id, bool_or(p) AS positive FROM p WHERE id IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL) GROUP BY id")
def evaluation_pool(t):
    known = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return tasks.evaluation_pool(t("documents").select(F.col("doc_id").alias("id")), t("labels").where("quality = 1").select(F.col("doc_id").alias("id")), known)


_DIM = "SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND vec_id % 3 <> 0"


@query(f"SELECT doc_id, round(coalesce(e.embedding[1], 0), 6) AS first, e.vec_id IS NOT NULL AS found FROM documents LEFT JOIN ({_DIM}) e ON doc_id = vec_id")
def vector_lookup(t):
    rows = t("documents").select("doc_id")
    known = t("embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    out = tasks.vector_lookup(rows, known, "doc_id", 64, "zero")
    return out.select("doc_id", r6(F.col("vector")[0].cast("double"), "first"), F.exists("vector", lambda v: v != 0).alias("found"))


@query(f"SELECT doc_id FROM documents JOIN ({_DIM}) ON doc_id = vec_id")
def vector_lookup_skip(t):
    known = t("embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return tasks.vector_lookup(t("documents").select("doc_id"), known, "doc_id", 64, "skip").select("doc_id")


@query(f"WITH {C}, b AS (SELECT id, context, score, rank FROM rk WHERE context = (SELECT min(context) FROM rk) AND id % 4 <> 0) SELECT vec_id AS id, rank, round(round(score, 9), 6) AS score, CASE WHEN rank IS NULL THEN CASE WHEN vec_id % 8 = 0 THEN 'no vector' ELSE 'not ranked' END END AS error FROM embeddings LEFT JOIN b ON id = vec_id")
def task_results(t):
    ranked = _scored(t)
    first = ranked.agg(F.min("context").alias("context"))  # one row
    ranking = ranked.join(F.broadcast(first), "context").where("id % 4 <> 0")
    rows = t("embeddings").select(F.col("vec_id").alias("id"))
    out = tasks.task_results(rows, ranking, rows.where("id % 8 = 0").withColumn("error", F.lit("no vector")), "id")
    return out.select("id", F.col("rank").cast("long").alias("rank"), r6(F.col("score"), "score"), "error")


@query(
    f"WITH {C}, m AS (SELECT context % 3 AS model_id, context, id, label, CASE WHEN context % 3 = 2 THEN NULL ELSE round(score, 9) END AS score FROM sc), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY model_id, context ORDER BY score DESC, id) AS rank FROM m WHERE score IS NOT NULL), "
    "x AS (SELECT model_id, context, avg(1.0 / rank) AS mrr, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END) AS h FROM r WHERE label = context GROUP BY ALL), "
    "y AS (SELECT model_id, avg(mrr) AS mrr, avg(h) AS h FROM x GROUP BY model_id), g AS (SELECT model_id, avg(score) FILTER (label = context) - avg(score) FILTER (label <> context) AS margin FROM r GROUP BY model_id), "
    "z AS (SELECT k.model_id, mrr, h, margin FROM (SELECT unnest([0, 1, 2]) AS model_id) k LEFT JOIN y USING (model_id) LEFT JOIN g USING (model_id)) "
    "SELECT model_id::BIGINT AS model_id, CASE WHEN mrr IS NULL THEN 'failed' ELSE 'ok' END AS status, round(mrr, 6) AS mrr, round(h, 6) AS hit_5, round(margin, 6) AS margin, CASE WHEN mrr IS NOT NULL THEN row_number() OVER (PARTITION BY mrr IS NULL ORDER BY mrr DESC, model_id) END AS rank_among_models FROM z"
)
def evaluate_models(t):
    """Three models, each scored on the contexts of its own; one of them gives no finite score."""
    s = _scored(t)
    model = F.col("context") % 3
    scores = s.select(model.cast("long").alias("model_id"), "context", "id", F.when(model != 2, F.col("score")).alias("score"))
    positives = t("embeddings").select(F.col("label").alias("context"), F.col("vec_id").alias("id"))
    expected = t("embeddings").select((F.col("label") % 3).cast("long").alias("model_id"))
    ids = t("embeddings").select(F.col("vec_id").alias("id"), "label")
    negatives = positives.select("context").distinct().join(ids, F.col("label") != F.col("context")).select("context", "id")  # some ten contexts
    out = tasks.evaluate_models(scores, positives, expected, (5,), negatives)
    return out.select("model_id", "status", r6(F.col("mrr"), "mrr"), r6(F.col("hit_5"), "hit_5"), r6(F.col("margin"), "margin"), F.col("rank_among_models").cast("long").alias("rank_among_models"))


#: The first six ids of a label are a task's positives, those of the next label its negatives, and all vectors its candidates.
_SUBSETS = (
    f"e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) = 64), "
    "p AS (SELECT label AS task, id, v, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS bit FROM e WHERE label IS NOT NULL QUALIFY bit < 6), "
    "n AS (SELECT task, count(*) AS n FROM p GROUP BY task), "
    "s AS (SELECT task, subset, bit_count(subset) AS size FROM n, (SELECT unnest(range(1, 64)) AS subset) WHERE subset < 1 << n), "
    "c AS (SELECT task, subset, list(m ORDER BY i) AS c FROM (SELECT s.task, subset, i, sum(v[i]) / any_value(size) AS m FROM s JOIN p ON p.task = s.task AND subset & (1 << bit) <> 0, (SELECT unnest(range(1, 65)) AS i) GROUP BY s.task, subset, i) GROUP BY ALL), "
    "x AS (SELECT c.task, subset, e.id, round(list_inner_product(v, c), 9) AS score FROM c, e), "
    "o AS (SELECT x.*, p.bit FROM x LEFT JOIN p ON p.task = x.task AND p.id = x.id), "
    "r AS (SELECT task, subset, id, bit, row_number() OVER (PARTITION BY task, subset ORDER BY score DESC, id) AS rank FROM o WHERE bit IS NULL OR subset & (1 << bit) = 0), "
    "h AS (SELECT r.task, subset, id, rank FROM r JOIN n USING (task) WHERE bit IS NOT NULL AND subset < (1 << n) - 1)"
)


def _subset_counts(t) -> tuple[DataFrame, ...]:
    e = t("embeddings").select(F.col("label").alias("task"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    labels = e.where("task is not null").select("task").distinct()
    first = Window.partitionBy("task").orderBy("id")
    positives = e.where("size(vector) = 64 and task is not null").withColumn("k", F.row_number().over(first)).where("k <= 6").select("task", "id")
    candidates = labels.crossJoin(e.select("id"))  # some ten tasks
    negatives = labels.withColumn("label", F.col("task") + 1).join(e.select(F.col("task").alias("label"), "id"), "label").select("task", "id")
    return candidates, positives, negatives, e.select("id", "vector")


@query(f"WITH {_SUBSETS} SELECT task::BIGINT AS task, subset::BIGINT AS subset, id AS held, rank FROM h")
def subset_ranks(t):
    candidates, positives, negatives, vecs = _subset_counts(t)
    counts = evaluation.context_counts(candidates, positives, negatives, vecs, {"mean": None}, 64)
    return evaluation.heldout_ranks(counts).select(F.col("task").cast("long").alias("task"), "subset", "held", "rank")


@query(
    f"WITH {_SUBSETS}, y AS (SELECT task, subset, avg(1.0 / rank) AS mrr, avg((rank <= 5)::INT) AS h5, avg((rank <= 50)::INT) AS h50 FROM h GROUP BY ALL), "
    "z AS (SELECT task, count(*) AS contexts, avg(mrr) AS mrr, avg(h5) AS h5, avg(h50) AS h50 FROM y GROUP BY task), "
    "w AS (SELECT x.task, list_inner_product(e.v, c.c) AS score, e.label, x.id IN (SELECT id FROM p WHERE p.task = x.task) AS pos FROM x JOIN n ON n.task = x.task AND subset = (1 << n) - 1 JOIN c ON c.task = x.task AND c.subset = x.subset JOIN e ON e.id = x.id), "
    "g AS (SELECT task, avg(score) FILTER (pos) AS pm, avg(score) FILTER (label = task + 1) AS nm FROM w GROUP BY task) "
    "SELECT g.task::BIGINT AS task, CASE WHEN contexts > 0 THEN 'success' ELSE 'partial' END AS status, coalesce(contexts, 0) AS contexts, round(mrr, 6) AS mrr, round(h5, 6) AS hit_5, round(h50, 6) AS hit_50, round(pm, 6) AS positive_mean, round(nm, 6) AS negative_mean, round(pm - nm, 6) AS margin FROM g LEFT JOIN z ON z.task = g.task"
)
def subset_evaluation(t):
    out = evaluation.evaluate_tasks(*_subset_counts(t), {"mean": None}, 64, (5, 50))
    return out.select(F.col("task").cast("long").alias("task"), "status", "contexts", *[r6(F.col(c), c) for c in ("mrr", "hit_5", "hit_50", "positive_mean", "negative_mean", "margin")])


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber > 2) ON l_orderkey = o_orderkey")
def bound_runs(t):
    b = t("orders").select(F.col("o_orderkey").alias("project"), F.lit(0).alias("run"), F.col("o_orderstatus").alias("version"))
    r = t("lineitem").where("l_linenumber > 2").select(F.col("l_orderkey").alias("project"), F.lit(0).alias("run"), "l_linenumber", "l_partkey")
    return tasks.bound_runs(b, r, "O").select(F.col("project").alias("o_orderkey"), "l_linenumber", "l_partkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def unbound_runs(t):
    runs = t("customer").select(F.col("c_custkey").alias("project"), F.lit(0).alias("run"))
    b = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("project"), F.lit(0).alias("run"), F.col("o_orderkey").alias("version"))
    return tasks.unbound_runs(runs, b).select(F.col("project").alias("c_custkey"), F.col("version").alias("o_orderkey"))


@query("SELECT event_id, coalesce(c_name, user_id || '_' || event_type) AS reference FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = user_id AND event_type = 'click'")
def resolve_reference(t):
    known = t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.lit("click").alias("event_type"), F.col("c_name").alias("id"))
    return tasks.resolve_reference(t("events").select("event_id", "user_id", "event_type"), known, ["user_id", "event_type"]).select("event_id", "reference")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def artifacts_not_there(t):
    present = t("orders").where("o_orderpriority in ('1-URGENT', '2-HIGH')").select(F.col("o_orderkey").alias("l_orderkey"))
    return tasks.missing_artifacts(t("lineitem").select("l_orderkey", "l_linenumber"), present, ["l_orderkey"])


@query(
    "WITH b AS (SELECT o_orderkey AS run, o_custkey AS source FROM orders WHERE o_orderkey % 5 = 0) SELECT DISTINCT l_orderkey AS run, 'f' || l_partkey AS path, 'file' AS kind FROM lineitem JOIN b ON run = l_orderkey JOIN orders ON o_orderkey = l_orderkey AND source = o_custkey WHERE l_linenumber % 2 = 0 "
    "UNION SELECT l_orderkey, 'r' || l_linenumber, 'result' FROM lineitem WHERE l_orderkey IN (SELECT run FROM b)"
)
def stale_files(t):
    bound = t("orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("source"), F.lit("a").alias("checksum"), F.when(F.col("o_orderkey") % 5 == 0, "b").otherwise("a").alias("current"))
    line = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    files = line.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("run"), F.concat(F.lit("f"), "l_partkey").alias("path"), F.col("o_custkey").alias("source"))
    results = t("lineitem").select(F.col("l_orderkey").alias("run"), F.concat(F.lit("r"), "l_linenumber").alias("path"))
    return tasks.stale_files(files, bound, results)


@query("SELECT user_id, max_by(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS last, max(event_id) AS best, -max(-event_id) FILTER (event_id = m) AS best_epoch FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS m FROM (SELECT user_id, event_id, ts FROM events)) GROUP BY user_id")
def last_and_best(t):
    e = t("events").select("user_id", "event_id", "ts")
    last = e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last"))
    best = tasks.last_and_best(e, "user_id", "event_id", "event_id").select("user_id", "best", "best_epoch")
    return last.join(best, "user_id")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 1")
def only_where(t):
    return tasks.only_where(t("events"), event_type="click", user_id=1, value=None).select("event_id")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def farthest_first(t):
    return tasks.farthest_first(t("orders"), ["o_custkey"], "o_totalprice", "o_orderkey").select("o_orderkey", F.col("place").cast("long").alias("place"))


_COLS = ("p_partkey", "p_name", "p_size")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {i} AS position, count(*) AS rows, count({c}) AS filled, count(DISTINCT {c}) AS different FROM part" for i, c in enumerate(_COLS)))
def dataset_stats(t):
    return tasks.dataset_stats(t("part").select(*_COLS)).withColumn("position", F.col("position").cast("int"))


# digests and quantiles --------------------------------------------------


_BY_KEY = " UNION ALL ".join(f"SELECT {n} AS level, count(DISTINCT substr(md5('=' || o_orderkey), 1, {n})) AS ranges FROM m" for n in range(5))


@query(f"WITH {REC} SELECT o_orderkey, status, col FROM m")
def reconcile_ranges(t):
    left, right = reconciled_tables(t)
    return digests.reconcile_ranges(left, right, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "status", F.col("column").alias("col"))


@query(f"WITH {REC} {_BY_KEY}")
def changed_ranges(t):
    """Ranges of each level that differ between the two tables."""
    left, right = reconciled_tables(t)
    trees = [digests.digest_tree(x, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"]) for x in (left, right)]
    return digests.differing_ranges(*trees).groupBy("level").agg(F.count("*").alias("ranges"))


@query("SELECT l_returnflag, share, round(CASE share WHEN 0.1 THEN quantile_cont(l_extendedprice, 0.1) WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5) ELSE quantile_cont(l_extendedprice, 0.9) END, 6) AS quantile FROM lineitem, (SELECT unnest([0.1::DOUBLE, 0.5, 0.9]) AS share) GROUP BY l_returnflag, share")
def exact_quantiles(t):
    """Quantiles of three groups that hold the whole table, by brackets of at most 500 distinct values."""
    out = quantiles.quantiles(t("lineitem"), "l_returnflag", "l_extendedprice", [0.1, 0.5, 0.9], 500)
    return out.select("l_returnflag", "share", r6(F.col("quantile"), "quantile"))


# workspaces and statistics ----------------------------------------------


@query("SELECT vec_id, round(embedding[1], 6) AS a, round(embedding[64], 6) AS b FROM embeddings")
def packed_vectors(t):
    rows = t("embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("vector"))
    out = workspace.unpack_vectors(workspace.pack_vectors(rows).drop("vector"))
    return out.select("vec_id", r6(F.col("vector")[0].cast("double"), "a"), r6(F.col("vector")[63].cast("double"), "b"))


@query("WITH s AS (SELECT 'orders' AS step, count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS finished, NULL::BIGINT AS returned FROM orders UNION ALL SELECT 'lines', count(*), NULL, count(*) FILTER (l_returnflag = 'R') FROM lineitem) SELECT * FROM s")
def merged_counters(t):
    a = workspace.step_counters(t("orders"), "orders", finished=F.count_if(F.col("o_orderstatus") == "F"))
    b = workspace.step_counters(t("lineitem"), "lines", returned=F.count_if(F.col("l_returnflag") == "R"))
    return workspace.merge_stats([a, b])


def _edges(a: str, la: str, b: str, lb: str, kind: str, where: str) -> str:
    return f"SELECT DISTINCT '{kind}' AS kind, {a}::VARCHAR AS a, '{la}' AS la, {b}::VARCHAR AS b, '{lb}' AS lb FROM {where}"


@query(
    " UNION ALL ".join(
        _edges(*x)
        for x in (
            ("n_nationkey", "M", "s_suppkey", "L1", "HAS", "nation JOIN supplier ON s_nationkey = n_nationkey"),
            ("l_suppkey", "L1", "l_partkey", "L3", "CONTAINS", "lineitem"),
            ("l_partkey", "L3", "l_orderkey", "L4", "GIVES", "lineitem"),
            ("o_orderkey", "L4", "o_custkey", "L5", "HOLDS", "orders"),
            ("r_regionkey", "R", "n_nationkey", "M", "SPANS", "region JOIN nation ON n_regionkey = r_regionkey"),
            ("c_nationkey", "M", "c_custkey", "L5", "HOUSES", "customer"),
        )
    )
)
def graph_edge_files(t):
    """The six kinds of edges as typed edge files, read in one table."""
    parts = [
        (t("nation").join(t("supplier"), F.col("s_nationkey") == F.col("n_nationkey")), "n_nationkey", "M", "s_suppkey", "L1", "HAS"),
        (t("lineitem"), "l_suppkey", "L1", "l_partkey", "L3", "CONTAINS"),
        (t("lineitem"), "l_partkey", "L3", "l_orderkey", "L4", "GIVES"),
        (t("orders"), "o_orderkey", "L4", "o_custkey", "L5", "HOLDS"),
        (t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")), "r_regionkey", "R", "n_nationkey", "M", "SPANS"),
        (t("customer"), "c_nationkey", "M", "c_custkey", "L5", "HOUSES"),
    ]
    out = None
    for df, a, la, b, lb, kind in parts:
        file = workspace.edge_rows(df, a, la, b, lb, kind)
        rows = file.select(F.col(":TYPE").alias("kind"), F.col(f":START_ID({la})").alias("a"), F.lit(la).alias("la"), F.col(f":END_ID({lb})").alias("b"), F.lit(lb).alias("lb"))
        out = rows if out is None else out.union(rows)
    return out


# cleaning and registries ------------------------------------------------


@query(
    r"WITH n AS (SELECT doc_id, text, nullif(trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g')), '') AS n FROM documents), f AS (SELECT n, min(doc_id) AS source_id, arg_min(CASE WHEN n = text THEN 2 ELSE 1 END, doc_id) AS status FROM n WHERE n IS NOT NULL GROUP BY n) "
    "SELECT 'D' || lpad((('0x' || substr(sha256(n), 1, 12))::BIGINT)::VARCHAR, 15, '0') AS id, source_id, status::INT AS status FROM f"
)
def repair_and_rekey(t):
    return clean.repair_and_rekey(t("documents"), "doc_id", "text").select("id", "source_id", "status")


_SPLIT = f"SELECT p_partkey, i - 1 AS position, parts[i] AS component, hubs, contains(parts[i], 'Zn') OR contains(parts[i], 'Fe') AS has_hub FROM (SELECT p_partkey, parts, hubs, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT p_partkey, string_split({_NOTATION}, '.') AS parts, CASE p_size % 3 WHEN 0 THEN 'Zn' ELSE 'Fe' END AS hubs FROM part WHERE p_size % 3 <> 1)) WHERE parts[i] <> ''"


@query(f"SELECT p_partkey, hubs, CASE WHEN hubs = 'Zn' THEN 2 ELSE 0 END AS quality, position, component, has_hub FROM ({_SPLIT})")
def split_containers(t):
    out = clean.split_containers(_notation(t), "p_partkey", "s", ["Zn", "Fe"])
    return out.select(F.col("id").alias("p_partkey"), F.array_join("hubs", ",").alias("hubs"), "quality", F.col("position").cast("long").alias("position"), "component", "has_hub")


@query(f"SELECT DISTINCT position, hubs AS centre, component AS neighbour FROM ({_SPLIT}) WHERE NOT has_hub")
def neighbour_rows(t):
    return clean.neighbour_rows(clean.split_containers(_notation(t), "p_partkey", "s", ["Zn", "Fe"])).withColumn("position", F.col("position").cast("long"))


@query("SELECT p_partkey FROM part WHERE p_size >= 2 AND p_brand <> 'Brand#11'")
def size_floor(t):
    return clean.sized(t("part"), F.col("p_size"), 2, F.col("p_brand"), ["Brand#11"]).select("p_partkey")


@query("SELECT s_nationkey, '[' || string_agg('{''' || sym || ''':''' || ch || '''}', ',' ORDER BY sym, ch) || ']' AS literal FROM (SELECT DISTINCT s_nationkey, 'S' || chr((97 + s_suppkey % 26)::INT) AS sym, s_suppkey % 3 AS ch FROM supplier) GROUP BY 1")
def hub_literals(t):
    pairs = F.collect_set(F.struct(F.concat(F.lit("S"), F.char(97 + F.col("s_suppkey") % 26)).alias("symbol"), (F.col("s_suppkey") % 3).alias("charge")))
    return t("supplier").groupBy("s_nationkey").agg(pairs.alias("p")).select("s_nationkey", clean.hub_literal(F.col("p")).alias("literal"))


@query("SELECT count(*) AS rows, count(DISTINCT (o_custkey, o_orderstatus)) AS kept, count(*) - count(DISTINCT (o_custkey, o_orderstatus)) AS removed FROM orders")
def keep_first_report(t):
    return clean.keep_first_report(t("orders"), ["o_custkey", "o_orderstatus"], ["o_orderkey"])[1]


@query(" UNION ".join(f"SELECT trim({c}) AS value FROM {n} WHERE trim({c}) <> ''" for n, c in (("part", "p_name"), ("supplier", "s_name"), ("customer", "c_name"), ("nation", "n_name"))))
def named_values(t):
    return clean.named_values([t("part"), t("supplier"), t("customer"), t("nation")], "name")


@query("SELECT c_custkey || '_' || c_mktsegment AS id FROM customer")
def composite_ids(t):
    return t("customer").select(composite_id(F.col("c_custkey"), F.col("c_mktsegment")).alias("id"))


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def stubs_of_half(t):
    return registry.stub_parents(t("events"), t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id")), "user_id")


@query(
    "SELECT s_suppkey, key, value, key IN ('name', 'place.nation') AS applied FROM (SELECT s_suppkey, unnest(['name', 'place.nation', 'place.more.phone']) AS key, unnest([s_name, s_nationkey::VARCHAR, CASE WHEN s_suppkey % 2 = 0 THEN s_name END]) AS value FROM supplier) WHERE value IS NOT NULL"
)
def nested_fields(t):
    phone = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name"))
    spec = F.struct(F.col("s_name").alias("name"), F.struct(F.col("s_nationkey").alias("nation"), F.struct(phone.alias("phone")).alias("more")).alias("place"))
    return registry.flatten_nested(t("supplier").select("s_suppkey", spec.alias("spec")), "s_suppkey", "spec", ["name", "place.nation"])


_SUM = "sha256(string_agg(concat_ws(',', trim(p_partkey::VARCHAR), coalesce(trim(p_name), '')), chr(10) ORDER BY p_partkey))"


@query(
    f"WITH a AS (SELECT p_brand, count(*) AS n, {_SUM} AS c FROM part GROUP BY 1), b AS (SELECT p_brand, count(*) AS n, {_SUM} AS c FROM (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 50 = 1 THEN p_name || '!' ELSE p_name END AS p_name FROM part WHERE p_brand <> 'Brand#11' AND p_partkey % 40 <> 7) GROUP BY 1) "
    "SELECT a.p_brand, CASE WHEN b.n IS NULL THEN 'gone' WHEN a.n <> b.n THEN 'rows differ' WHEN a.c <> b.c THEN 'content differs' ELSE 'same' END AS state FROM a LEFT JOIN b USING (p_brand)"
)
def verify_bindings(t):
    p = t("part")
    later = p.where("p_brand <> 'Brand#11' and p_partkey % 40 <> 7").withColumn("p_name", F.when(F.col("p_partkey") % 50 == 1, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")))
    a, b = (registry.checksums(x, "p_brand", "p_partkey", ["p_partkey", "p_name"]) for x in (p, later))
    return registry.verify_bindings(a, b, "p_brand")


@query("SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders")
def version_parents(t):
    return registry.with_parent(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


# patterns ---------------------------------------------------------------


ANY = r"[\p{L}\p{M}\p{N}]+"


def _grams(most: int, kind: str) -> str:
    runs = " UNION ALL ".join(f"SELECT id, {n} AS length, array_to_string(k[i:i + {n - 1}], ' ') AS p FROM (SELECT id, k, unnest(range(1, len(k) - {n - 2})) AS i FROM t WHERE len(k) >= {n})" for n in range(1, most + 1))
    return f"t AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '{kind}') AS k FROM documents), g AS ({runs})"


@query(rf"WITH {_grams(4, ANY)} SELECT p AS pattern, length, 'G' || lpad(((('0x' || substr(md5(p), 1, 12))::BIGINT) % 1000000)::VARCHAR, 6, '0') AS pattern_id, count(DISTINCT id) AS docs, string_agg(DISTINCT id::VARCHAR, ',' ORDER BY id::VARCHAR) AS sources FROM g GROUP BY p, length HAVING count(DISTINCT id) >= 8")
def patterns_up_to(t):
    found = patterns.mine_up_to(patterns.tokens(t("documents"), "doc_id", "text"), 4, 8)
    by_text = F.array_join(F.array_sort(F.split("sources", ",")), ",")
    return found.select("pattern", "length", "pattern_id", "docs", by_text.alias("sources"))


@query(r"WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS k FROM documents) SELECT id, len(k)::BIGINT AS n, len(list_distinct(k))::BIGINT AS different FROM t")
def tokens_of_any_script(t):
    toks = patterns.tokens(t("documents"), "doc_id", "text")
    return toks.select("id", F.size("tokens").cast("long").alias("n"), F.size(F.array_distinct("tokens")).cast("long").alias("different"))
