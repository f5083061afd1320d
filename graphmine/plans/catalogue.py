"""The library's queries on the given tables, each with the SQL that states the same rows.

Stand-ins: an item is a part, a feature a customer, a mid node an order, a hub the nation of a
supplier. Measures are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmine.functions import add_layer, content_id, decay_weight, hub_id, id_number, keyed_uniform, list_key, name_is_valid, pattern_id, scaled_distance, strip_layer, truth
from graphmine.operators import clean, graph, models, pair_stats, patterns, rank, registry, sampling, tasks, vectors
from graphmine.sources import hub_vectors, index_lists, model_runs, named_rows
from graphmine.sources.tables import save_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Items of a feature from which it counts as common, largest size of sampled items, and the seed.
D, K, SEED = 40, 30, 42


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(col, name: str):
    return F.round(col, 6).alias(name)


def edges_of(t) -> DataFrame:
    first = t("lineitem").select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("mid"))
    return graph.compose(first, t("orders").select(F.col("o_orderkey").alias("mid"), F.col("o_custkey").alias("feature")))


def hub_pairs(t) -> DataFrame:
    sup = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("hub"))  # 25 nations
    return t("lineitem").join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select("hub", F.col("l_partkey").alias("item")).distinct()


E = "e AS (SELECT DISTINCT l_partkey AS item, o_custkey AS feature FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
W = E + ", w AS (SELECT feature, count(*) AS freq, ln((SELECT count(DISTINCT item) FROM e) / count(*)) AS weight FROM e GROUP BY feature)"
H = "h AS (SELECT DISTINCT n_name AS hub, l_partkey AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"
P = (
    W
    + f""", kept AS (SELECT e.* FROM e JOIN w USING (feature) WHERE freq < {D}), pr AS (SELECT DISTINCT a.item AS target, b.item FROM kept a JOIN kept b USING (feature) WHERE a.item <> b.item),
tot AS (SELECT item, sum(weight) AS w FROM e JOIN w USING (feature) GROUP BY item),
cm AS (SELECT a.item AS target, b.item, sum(weight) AS common FROM e a JOIN e b USING (feature) JOIN w USING (feature) WHERE a.item <> b.item GROUP BY ALL),
d AS (SELECT pr.target, pr.item, coalesce(common, 0) / (x.w + y.w - coalesce(common, 0)) AS sim FROM pr LEFT JOIN cm USING (target, item) JOIN tot x ON x.item = pr.target JOIN tot y ON y.item = pr.item)"""
)


def uniform_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{SEED}', {', '.join(parts)})), 1, 13))::BIGINT / 4503599627370496.0)"


def hash_sql(*parts: str) -> str:
    return f"md5(concat_ws('|', '{SEED}', {', '.join(parts)}))"


# graph ------------------------------------------------------------------


@query(f"WITH {E} SELECT item, feature FROM e")
def two_hop_edges(t):
    return edges_of(t)


@query("SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size >= 2)")
def edge_build_checked(t):
    edges = t("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.checked_edges(edges, t("orders").where("o_orderstatus <> 'P'").select("o_orderkey"), t("part").where("p_size >= 2").select("p_partkey"))


@query(f"WITH {E} SELECT feature, count(*) AS n, string_agg(item::VARCHAR, ';' ORDER BY item) AS members FROM e GROUP BY feature")
def inverted_index(t):
    return index_lists(edges_of(t), "feature", "item").select("feature", F.size("members").cast("long").alias("n"), F.array_join(F.transform("members", lambda x: x.cast("string")), ";").alias("members"))


@query(f"WITH {W} SELECT feature, freq, round(weight, 6) AS weight FROM w")
def idf_weights(t):
    return graph.feature_weights(edges_of(t)).select("feature", "freq", r6(F.col("weight"), "weight"))


@query(f"WITH {H} SELECT 'L3_' || item AS ligand, hub, p_size AS size FROM h JOIN part ON item = p_partkey WHERE p_size BETWEEN 10 AND 15")
def hub_item_pairs(t):
    rows = hub_pairs(t).join(t("part"), F.col("item") == F.col("p_partkey"))
    return clean.between_sizes(rows, F.col("p_size"), 10, 15).select(add_layer(F.col("item").cast("string"), "L3").alias("ligand"), "hub", F.col("p_size").alias("size"))


@query(f"WITH {H} SELECT item, hub, coalesce(p_name, '') AS name FROM h JOIN part ON item = p_partkey WHERE trim(p_name) <> ''")
def hub_item_named(t):
    return hub_pairs(t).join(t("part"), F.col("item") == F.col("p_partkey")).where("trim(p_name) <> ''").select("item", "hub", F.coalesce("p_name", F.lit("")).alias("name"))


@query(f"WITH {H} SELECT hub, count(*) AS n, min(item) AS first_item FROM h GROUP BY hub")
def hub_item_from_edges(t):
    return hub_pairs(t).groupBy("hub").agg(F.count("*").alias("n"), F.min("item").alias("first_item"))


@query("WITH last AS (SELECT l_orderkey AS via, max_by(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS dst FROM lineitem GROUP BY 1) SELECT DISTINCT o_custkey AS src, dst FROM orders JOIN last ON o_orderkey = via")
def last_wins_route(t):
    second = t("lineitem").select(F.col("l_orderkey").alias("via"), F.col("l_partkey").alias("dst"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("ord"))
    return graph.route_last(t("orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("via")), second)


@query("SELECT 'M_' || n_nationkey AS start_id, 'L1_' || s_suppkey AS end_id, 'HAS' AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT 'L1_' || l_suppkey, 'L3_' || l_partkey, 'CONTAINS' FROM lineitem")
def graph_export_rows(t):
    a = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(add_layer(F.col("n_nationkey").cast("string"), "M").alias("start_id"), add_layer(F.col("s_suppkey").cast("string"), "L1").alias("end_id"), F.lit("HAS").alias("type"))
    b = t("lineitem").select(add_layer(F.col("l_suppkey").cast("string"), "L1").alias("start_id"), add_layer(F.col("l_partkey").cast("string"), "L3").alias("end_id"), F.lit("CONTAINS").alias("type"))
    return a.union(b).distinct()


@query(
    "WITH i AS (SELECT p_partkey AS id, p_name FROM part), s AS (SELECT s_suppkey AS id, s_name FROM supplier), c AS (SELECT c_custkey AS id, c_name FROM customer) "
    "SELECT id, p_name AS item_name, s_name AS hub_name, c_name AS feature_name FROM i FULL JOIN s USING (id) FULL JOIN c USING (id)"
)
def layer_merge(t):
    layers = {"item": (t("part").select("p_partkey", "p_name"), "p_partkey"), "hub": (t("supplier").select("s_suppkey", "s_name"), "s_suppkey"), "feature": (t("customer").select("c_custkey", "c_name"), "c_custkey")}
    rows = graph.layer_rows(layers)
    return rows.select("id", F.get_json_object("item", "$.p_name").alias("item_name"), F.get_json_object("hub", "$.s_name").alias("hub_name"), F.get_json_object("feature", "$.c_name").alias("feature_name"))


# candidates and samples -------------------------------------------------


@query(
    f"WITH {W}, s AS (SELECT e.* FROM e JOIN part ON item = p_partkey WHERE p_size <= {K}), "
    f"rare AS (SELECT a.item AS target, b.item FROM e a JOIN w USING (feature) JOIN e b USING (feature) WHERE freq < {D} AND a.item <> b.item), "
    f"com AS (SELECT a.item AS target, b.item, row_number() OVER (PARTITION BY a.item, feature ORDER BY {hash_sql('a.item', 'feature', 'b.item')}, b.item) AS r FROM e a JOIN w USING (feature) JOIN s b USING (feature) WHERE freq >= {D} AND a.item <> b.item) "
    f"SELECT target, item FROM rare UNION SELECT target, item FROM com WHERE r <= {D}"
)
def candidates_sampled(t):
    return graph.candidates(edges_of(t), _sizes(t), D, K, SEED)


def _sizes(t) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("size"))


def _slot(*parts: str) -> str:
    return f"('0x' || substr({hash_sql(*parts)}, 1, 12))::BIGINT"


DRAWN = (
    f"cn AS (SELECT e.item, feature FROM e JOIN w USING (feature) WHERE freq >= {D}), sm AS (SELECT cn.* FROM cn JOIN part ON item = p_partkey WHERE p_size <= {K}), "
    "nn AS (SELECT feature, count(*) AS n FROM sm GROUP BY feature), "
    f"sl AS (SELECT feature, item, row_number() OVER (PARTITION BY feature ORDER BY {hash_sql('feature', 'item')}, item) - 1 AS place FROM sm), "
    f"dr AS (SELECT item AS target, feature, ({_slot('item', 'feature')} + j) % n AS place FROM cn JOIN nn USING (feature), (SELECT unnest(range(0, {D})) AS j) WHERE j < n), "
    f"rr AS (SELECT e.* FROM e JOIN w USING (feature) WHERE freq < {D}), "
    "cd AS (SELECT a.item AS target, b.item FROM rr a JOIN rr b USING (feature) WHERE a.item <> b.item UNION SELECT target, item FROM dr JOIN sl USING (feature, place) WHERE item <> target)"
)
DRAWN_D = (
    f"{W}, {DRAWN}, tot AS (SELECT item, sum(weight) AS w FROM e JOIN w USING (feature) GROUP BY item), "
    "cm AS (SELECT cd.target, cd.item, sum(weight) AS common FROM cd JOIN e a ON a.item = cd.target JOIN e b ON b.item = cd.item AND b.feature = a.feature JOIN w ON w.feature = a.feature GROUP BY ALL), "
    "d AS (SELECT cm.target, cm.item, common / (x.w + y.w - common) AS sim FROM cm JOIN tot x ON x.item = cm.target JOIN tot y ON y.item = cm.item)"
)


@query(f"WITH {W}, {DRAWN} SELECT target, item FROM cd")
def candidates_drawn(t):
    return graph.candidates_drawn(edges_of(t), _sizes(t), D, K, SEED)


@query(f"WITH {DRAWN_D} SELECT target, item, round(sim, 6) AS similarity FROM d")
def drawn_distances(t):
    return graph.pairs_of(_drawn_blocks(t)).select("target", "item", r6(F.col("similarity"), "similarity"))


@query(f"WITH {DRAWN_D} SELECT target, count(*) AS n, round(min(1 - sim), 6) AS d_min, round(max(1 - sim), 6) AS d_max, round(avg(1 - sim), 6) AS d_mean, round(quantile_cont(1 - sim, 0.1), 6) AS q10, round(quantile_cont(1 - sim, 0.9), 6) AS q90 FROM d GROUP BY target")
def drawn_distance_stats(t):
    s = pair_stats.distance_stats(_drawn_blocks(t))
    return s.select("target", "n", *[r6(F.col(c), c) for c in ("d_min", "d_max", "d_mean", "q10", "q90")])


def _rare_blocks(t, traits: DataFrame | None = None) -> graph.PairBlocks:
    """Pairs of rare features."""
    return graph.pair_blocks(edges_of(t), D, traits=traits)


def _drawn_blocks(t, traits: DataFrame | None = None) -> graph.PairBlocks:
    """Pairs of rare features and the drawn pairs of common ones."""
    return graph.pair_blocks(edges_of(t), D, _sizes(t), K, SEED, traits=traits)


def _hub_bits(t) -> tuple[pair_stats.Hubs, DataFrame]:
    """The hubs, which own the items that are of them, and the items' bits."""
    bits = sampling.HubBits.of(hub_pairs(t))
    return pair_stats.Hubs(bits), pair_stats.hub_traits(bits, bits)


@query(f"WITH {P} SELECT target, item, round(sim, 6) AS similarity FROM d")
def weighted_jaccard(t):
    return graph.pairs_of(_rare_blocks(t)).select("target", "item", r6(F.col("similarity"), "similarity"))


@query(f"WITH {P} SELECT target, count(*) AS n, round(min(1 - sim), 6) AS d_min, round(max(1 - sim), 6) AS d_max, round(avg(1 - sim), 6) AS d_mean, round(quantile_cont(1 - sim, 0.1), 6) AS q10, round(quantile_cont(1 - sim, 0.9), 6) AS q90 FROM d GROUP BY target")
def distance_stats(t):
    s = pair_stats.distance_stats(_rare_blocks(t))
    return s.select("target", "n", *[r6(F.col(c), c) for c in ("d_min", "d_max", "d_mean", "q10", "q90")])


@query(
    f"WITH {P}, {H}, l AS (SELECT d.target, o.hub, d.item, CASE WHEN k.item IS NULL THEN 'NL' ELSE 'KL' END AS label FROM d JOIN h o ON o.item = d.target LEFT JOIN h k ON k.hub = o.hub AND k.item = d.item) "
    "SELECT target, hub, count(*) FILTER (label = 'KL') AS known, count(*) FILTER (label = 'NL') AS other, round(count(*) FILTER (label = 'KL') / count(*), 6) AS known_share FROM l GROUP BY target, hub"
)
def known_split(t):
    hubs, traits = _hub_bits(t)
    rows = pair_stats.label_counts(_rare_blocks(t, traits), hubs)
    return rows.select("target", "hub", "known", "other", r6(F.col("known") / (F.col("known") + F.col("other")), "known_share"))


@query(
    f"WITH u AS (SELECT l_orderkey, l_partkey, l_quantity, {uniform_sql('l_orderkey', 'l_partkey')} AS r FROM (SELECT l_orderkey, l_partkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ln(greatest(r, 1e-300)) / l_quantity DESC, l_partkey) AS n FROM u WHERE l_quantity > 0) SELECT l_orderkey, l_partkey FROM k WHERE n <= 2"
)
def weighted_sample(t):
    rows = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("l_quantity")).where("l_quantity > 0")
    return sampling.weighted_sample(rows, ["l_orderkey"], "l_partkey", F.col("l_quantity"), 2, SEED).select("l_orderkey", "l_partkey")


@query(f"SELECT p_partkey, CASE WHEN {uniform_sql('p_partkey')} < 0.7 THEN 'train' WHEN {uniform_sql('p_partkey')} < 0.8 THEN 'valid' ELSE 'test' END AS split FROM (SELECT DISTINCT p_partkey FROM part)")
def split_targets(t):
    return sampling.split_targets(t("part"), "p_partkey", SEED)


@query(f"SELECT p_partkey FROM part ORDER BY {hash_sql('p_partkey')}, p_partkey LIMIT 100")
def target_sample(t):
    return sampling.first_targets(t("part"), "p_partkey", SEED, 100).select("p_partkey")


@query(
    f"WITH n AS (SELECT source, greatest(3, floor(count(*) * 0.1 + 0.5)) AS k FROM documents GROUP BY source), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {hash_sql('source', 'doc_id')}, doc_id) AS r FROM documents) SELECT doc_id, r.source FROM r JOIN n ON n.source IS NOT DISTINCT FROM r.source WHERE r <= k"
)
def stratified_sample(t):
    return sampling.stratified(t("documents"), "source", "doc_id", 0.1, 3, SEED).select("doc_id", "source")


@query(
    f"WITH {E}, n AS (SELECT count(*) AS n FROM part), s AS (SELECT p_partkey AS item, {_slot('p_partkey')} % (SELECT n FROM n) AS slot FROM part), "
    f"w AS (SELECT p_partkey AS target, j, {_slot('p_partkey', 'j')} % (SELECT n FROM n) AS slot FROM part, (SELECT unnest(range(1, 65)) AS j)), "
    "d AS (SELECT target, s.item, min(j) AS j FROM w JOIN s USING (slot) WHERE s.item <> target GROUP BY ALL), "
    "f AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM e a JOIN e b USING (feature) WHERE a.item = d.target AND b.item = d.item)) "
    "SELECT target, item FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY j, item) AS r FROM f) WHERE r <= 32"
)
def unrelated_sample(t):
    return sampling.unrelated_drawn(t("part").select(F.col("p_partkey").alias("item")), edges_of(t), SEED)


@query(
    f"WITH {E}, n AS (SELECT p_partkey AS item, row_number() OVER (ORDER BY {hash_sql('p_partkey')}, p_partkey) - 1 AS number, {_slot('p_partkey')} % count(*) OVER () AS start, count(*) OVER () AS n FROM part), "
    "re AS (SELECT DISTINCT a.item AS target, b.item FROM e a JOIN e b USING (feature)), "
    "f AS (SELECT a.item AS target, b.item, row_number() OVER (PARTITION BY a.item ORDER BY (b.number - a.start + a.n) % a.n) AS r FROM n a, n b WHERE a.item <> b.item AND NOT EXISTS (SELECT 1 FROM re WHERE re.target = a.item AND re.item = b.item)) "
    "SELECT target, item FROM f WHERE r <= 32"
)
def unrelated_whole(t):
    """As unrelated_sample, but k items wherever k exist."""
    return sampling.unrelated_sample(t("part").select(F.col("p_partkey").alias("item")), edges_of(t), SEED)


@query()
def training_records(t):
    items = t("part").select(F.col("p_partkey").alias("item"))
    return _records_of(t, sampling.unrelated_sample(items, edges_of(t), SEED))


def _records_of(t, unrelated: DataFrame) -> DataFrame:
    hubs, traits = _hub_bits(t)
    traits = pair_stats.record_traits(traits, unrelated, sampling.split_targets(t("part"), "p_partkey", SEED))
    return pair_stats.training_records(_drawn_blocks(t, traits), hubs, SEED)


_SAMPLED = (
    f"{P}, {H}, dd AS (SELECT target, item, 1 - sim AS dist FROM d), st AS (SELECT target, quantile_cont(dist, 0.1) AS lo, quantile_cont(dist, 0.9) AS hi FROM dd GROUP BY target), "
    "l AS (SELECT dd.target, o.hub, dd.item, dist, CASE WHEN k.item IS NULL THEN 'NL' ELSE 'KL' END AS label FROM dd JOIN h o ON o.item = dd.target LEFT JOIN h k ON k.hub = o.hub AND k.item = dd.item), "
    "ls AS (SELECT target, hub, label, count(*) AS n, min(dist) AS d_min, avg(dist) AS d_mean, median(dist) AS d_median FROM l GROUP BY ALL)"
)


@query(f"WITH {_SAMPLED} SELECT target, hub, label, n, round(d_min, 6) AS d_min, round(d_mean, 6) AS d_mean, round(d_median, 6) AS d_median FROM ls")
def pool_stats(t):
    hubs, traits = _hub_bits(t)
    out = pair_stats.pool_stats(_rare_blocks(t, traits), hubs)
    return out.select("target", "hub", "label", "n", *[r6(F.col(c), c) for c in ("d_min", "d_mean", "d_median")])


@query("SELECT o_custkey, round(0.7 * exp(-2.0 * s) + 1.0 - 0.7, 6) AS w FROM (SELECT o_custkey, CASE WHEN hi = lo THEN 0 ELSE greatest(0, least(1, (m - lo) / (hi - lo))) END AS s FROM (SELECT o_custkey, avg(o_totalprice) AS m, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1))")
def decay_weights(t):
    a = t("orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return a.select("o_custkey", r6(decay_weight(scaled_distance(F.col("m"), F.col("lo"), F.col("hi")), 2.0, 0.7), "w"))


@query(
    "WITH s AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_suppkey)) AS elems, count(DISTINCT l_suppkey) AS size FROM lineitem GROUP BY 1), f AS (SELECT id, size, elems, unnest(elems) AS e FROM s) "
    "SELECT id, size FROM s a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.size < a.size AND list_contains(a.elems, b.e) AND b.e = b.elems[1] AND list_has_all(a.elems, b.elems))"
)
def minimal_sets(t):
    sets = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("elems")).withColumn("size", F.size("elems").cast("long"))
    return graph.minimal_sets(sets).select("id", "size")


# cleaning ---------------------------------------------------------------


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def dedupe_keep_first(t):
    return clean.keep_first(t("events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT coalesce(nullif(trim(lang), ''), 'unknown_' || row_index) AS cid, source, row_index FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_index FROM documents WHERE trim(text) <> '')")
def dirty_scan_rows(t):
    rows = t("documents").where("trim(text) <> ''")
    places = rank.rank_rows(rows.withColumn("_s", -F.col("doc_id")), "source", "_s", "doc_id").withColumn("row_index", F.col("rank").cast("long") - 1)
    return named_rows(places, "lang", "text", "row_index").select(F.col("lang").alias("cid"), "source", "row_index")


@query(
    r"WITH n AS (SELECT text, nullif(trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g')), '') AS n FROM documents) "
    "SELECT count(*) AS total, count(*) FILTER (n IS NULL) AS invalid, count(*) FILTER (n = text) AS unchanged, count(*) FILTER (n <> text) AS repaired FROM n"
)
def status_counts(t):
    rows = t("documents").select("text", clean.normalised(F.col("text")).alias("n"))
    s = clean.repair_status(F.col("text"), F.col("n"))
    return rows.agg(F.count("*").alias("total"), F.count_if(s == 0).alias("invalid"), F.count_if(s == 2).alias("unchanged"), F.count_if(s == 1).alias("repaired"))


@query("WITH a AS (SELECT s_nationkey, '[' || string_agg('{''S' || chr((97 + s_suppkey % 26)::INT) || ''':''1''}', ',' ORDER BY s_suppkey) || ']' AS lit FROM supplier GROUP BY 1) SELECT s_nationkey, len(list_distinct(regexp_extract_all(lit, '''([A-Za-z]+)''\\s*:', 1))) AS n FROM a")
def hub_literal_parse(t):
    item = F.concat(F.lit("{'S"), F.char(97 + F.col("s_suppkey") % 26), F.lit("':'1'}"))
    rows = t("supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", item.alias("x")))).alias("l"))
    lit = F.concat(F.lit("["), F.array_join(F.transform("l", lambda r: r["x"]), ","), F.lit("]"))
    return rows.select("s_nationkey", F.size(clean.literal_symbols(lit)).cast("long").alias("n"))


_NOTATION = "p_name || '.' || CASE WHEN p_size % 3 = 0 THEN '[Zn+2]' WHEN p_size % 3 = 1 THEN '[OH].Cl' ELSE 'C[Fe]C' END"


def _notation(t) -> DataFrame:
    tail = F.when(F.col("p_size") % 3 == 0, "[Zn+2]").when(F.col("p_size") % 3 == 1, "[OH].Cl").otherwise("C[Fe]C")
    return t("part").select("p_partkey", F.concat("p_name", F.lit("."), tail).alias("s"))


@query(f"SELECT p_partkey, i - 1 AS position, parts[i] AS component, contains(parts[i], 'Zn') OR contains(parts[i], 'Fe') AS has_hub FROM (SELECT p_partkey, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT p_partkey, string_split({_NOTATION}, '.') AS parts FROM part)) WHERE parts[i] <> ''")
def component_split(t):
    return clean.components_of(_notation(t), "s", ["Zn", "Fe"]).select("p_partkey", F.col("position").cast("long").alias("position"), "component", "has_hub")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Zn' WHEN 1 THEN '' ELSE 'Fe' END AS hubs FROM part")
def bracket_tokens(t):
    return _notation(t).select("p_partkey", F.array_join(clean.bracket_symbols(F.col("s"), ["Zn", "Fe"]), ",").alias("hubs"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 2 ELSE 0 END AS code FROM part")
def quality_code(t):
    return _notation(t).select("p_partkey", clean.quality_code(F.col("s"), ["Zn"]).alias("code"))


@query("WITH c AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS id, c_mktsegment AS key FROM customer) SELECT 'half_empty' AS violation, '' AS id FROM c WHERE id IS NULL UNION ALL SELECT 'key_repeated', key FROM c WHERE id IS NOT NULL GROUP BY key HAVING count(DISTINCT id) > 1")
def upload_violations(t):
    rows = t("customer").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("id"), F.col("c_mktsegment").alias("key"))
    return clean.upload_violations(rows, "id", "key")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def point_lookup(t):
    return tasks.only_where(t("customer"), c_mktsegment="BUILDING").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT doc_id, d.lang, quality, toxic FROM documents d JOIN (SELECT DISTINCT doc_id, quality, toxic FROM labels) USING (doc_id)")
def text_lookup(t):
    return tasks.text_lookup(t("labels").select("doc_id", "quality", "toxic"), t("documents"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("SELECT doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS place FROM documents")
def ordered_listing(t):
    rows = t("documents").withColumn("n", F.length("text").cast("long"))
    return rank.rank_rows(rows, "source", "n", "doc_id").select("doc_id", "n", F.col("rank").cast("long").alias("place"))


# ids --------------------------------------------------------------------


@query("SELECT doc_id, 'D' || lpad((('0x' || substr(sha256(text), 1, 12))::BIGINT)::VARCHAR, 15, '0') AS did, ('0x' || substr(sha256(text), 1, 12))::BIGINT AS number, 'D' || doc_id || 'E' AS hub FROM documents WHERE text IS NOT NULL")
def content_ids(t):
    did = content_id(F.col("text"))
    return t("documents").where("text is not null").select("doc_id", did.alias("did"), id_number(did).alias("number"), hub_id(F.col("doc_id")).alias("hub"))


@query("SELECT p_partkey, 'G' || lpad(((('0x' || substr(md5(p_name), 1, 12))::BIGINT) % 1000000)::VARCHAR, 6, '0') AS pattern_id FROM part")
def pattern_ids(t):
    return t("part").select("p_partkey", pattern_id(F.col("p_name")).alias("pattern_id"))


@query("SELECT c_custkey, c_custkey % 3 = 0 AS flag, string_split(c_name, '#')[1] AS stripped, regexp_full_match(c_name, '[A-Za-z0-9][A-Za-z0-9_-]{0,63}') AS valid, 'a,b' AS key FROM customer")
def tolerant_fields(t):
    flag = F.when(F.col("c_custkey") % 3 == 0, "Yes").otherwise("0.0")
    return t("customer").select("c_custkey", truth(flag).alias("flag"), strip_layer(F.concat(F.lit("l3_"), F.split("c_name", "#")[0])).alias("stripped"), name_is_valid(F.col("c_name")).alias("valid"), list_key(F.lit("['b', 'a']")).alias("key"))


@query(f"SELECT doc_id, round({uniform_sql('doc_id')}, 6) AS u FROM documents")
def keyed_numbers(t):
    return t("documents").select("doc_id", r6(keyed_uniform(SEED, F.col("doc_id")), "u"))


# patterns ---------------------------------------------------------------

T = r"t AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS k FROM documents), g3 AS (SELECT id, i - 1 AS start, k[i] || ' ' || k[i + 1] || ' ' || k[i + 2] AS p FROM (SELECT id, k, unnest(range(1, len(k) - 1)) AS i FROM t WHERE len(k) >= 3)), a AS (SELECT p, count(DISTINCT id) AS docs FROM g3 GROUP BY p HAVING count(DISTINCT id) >= 5)"


@query(f"WITH {T} SELECT p AS pattern, 'G' || lpad(((('0x' || substr(md5(p), 1, 12))::BIGINT) % 1000000)::VARCHAR, 6, '0') AS pattern_id, docs FROM a")
def pattern_sources(t):
    return patterns.mine(patterns.tokens(t("documents"), "doc_id", "text"), 3, 5)


@query(
    f"WITH {T}, h AS (SELECT id, start FROM g3 JOIN a USING (p)), n AS (SELECT id, count(*) AS n FROM h GROUP BY id), c AS (SELECT id, count(DISTINCT q) AS c FROM (SELECT id, unnest([start, start + 1, start + 2]) AS q FROM h) GROUP BY id) "
    "SELECT id, len(k) AS n_tokens, coalesce(n, 0) AS n_hits, coalesce(n, 0) + len(k) - coalesce(c, 0) AS size FROM t LEFT JOIN n USING (id) LEFT JOIN c USING (id)"
)
def coverage_size(t):
    toks = patterns.tokens(t("documents"), "doc_id", "text")
    return patterns.coverage_size(toks, patterns.mine(toks, 3, 5)).select("id", F.col("n_tokens").cast("long").alias("n_tokens"), "n_hits", "size")


@query(
    f"WITH {T}, g2 AS (SELECT id, i - 1 AS start, k[i] || ' ' || k[i + 1] AS p FROM (SELECT id, k, unnest(range(1, len(k))) AS i FROM t WHERE len(k) >= 2)), b AS (SELECT p FROM g2 GROUP BY p HAVING count(DISTINCT id) >= 10), "
    "h AS (SELECT g3.id, start, p, len(k) AS n FROM g3 JOIN a USING (p) JOIN t ON t.id = g3.id), c AS (SELECT id, q, min(start) AS g FROM (SELECT id, start, unnest([start, start + 1]) AS q FROM g2 JOIN b USING (p)) GROUP BY id, q) "
    "SELECT h.id, h.start, 'G' || lpad(((('0x' || substr(md5(p), 1, 12))::BIGINT) % 1000000)::VARCHAR, 6, '0') AS pattern_id, least(greatest(h.start - 1, 0), coalesce(l.g, 999999999)) AS frag_start, greatest(least(h.start + 3, n - 1), coalesce(r.g + 1, -1)) AS frag_end FROM h LEFT JOIN c l ON l.id = h.id AND l.q = h.start - 1 LEFT JOIN c r ON r.id = h.id AND r.q = h.start + 3"
)
def tag_fragments(t):
    toks = patterns.tokens(t("documents"), "doc_id", "text")
    out = patterns.tag_fragments(toks, patterns.mine(toks, 3, 5), patterns.mine(toks, 2, 10))
    return out.select("id", *[F.col(c).cast("long").alias(c) for c in ("start", "frag_start", "frag_end")], "pattern_id")


@query(
    f"WITH {T}, h AS (SELECT id, start, 'G' || lpad(((('0x' || substr(md5(p), 1, 12))::BIGINT) % 1000000)::VARCHAR, 6, '0') AS pattern_id FROM g3 JOIN a USING (p)), "
    "f AS (SELECT id, list_reduce(list([start] ORDER BY pattern_id, start), lambda taken, x: CASE WHEN len(list_filter(taken, lambda y: abs(y - x[1]) < 3)) > 0 THEN taken ELSE list_concat(taken, x) END) AS taken FROM h GROUP BY id) "
    "SELECT h.id, h.start, 3::BIGINT AS length, pattern_id FROM h JOIN f USING (id) WHERE list_contains(taken, start)"
)
def tag_fragments_exclusive(t):
    toks = patterns.tokens(t("documents"), "doc_id", "text")
    return patterns.tag_exclusive(toks, patterns.mine(toks, 3, 5))


_G7 = " UNION ALL ".join(f"SELECT id, i - 1 AS start, {n} AS n, array_to_string(k[i:i + {n - 1}], ' ') AS p FROM (SELECT id, k, unnest(range(1, len(k) - {n - 2})) AS i FROM t WHERE len(k) >= {n})" for n in range(1, 8))


@query(
    rf"WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}]+') AS k FROM documents), b AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}]+') AS k FROM benchmark), "
    f"d AS (SELECT DISTINCT array_to_string(k[i:i + n - 1], ' ') AS p FROM (SELECT k, unnest(range(1, len(k) + 1)) AS i FROM b), (SELECT unnest(range(1, 8)) AS n) WHERE i + n - 1 <= len(k)), "
    f"g AS ({_G7}), h AS (SELECT id, start, n FROM g JOIN d USING (p)), c AS (SELECT id, count(*) AS c FROM h GROUP BY id), v AS (SELECT id, count(DISTINCT q) AS v FROM (SELECT id, unnest(range(start, start + n)) AS q FROM h) GROUP BY id) "
    "SELECT id, len(k)::BIGINT AS n_tokens, coalesce(c, 0) AS n_hits, coalesce(c, 0) + len(k) - coalesce(v, 0) AS size FROM t LEFT JOIN c USING (id) LEFT JOIN v USING (id)"
)
def coverage_of_all_lengths(t):
    """Coverage by the runs of one to seven tokens of the benchmark passages."""
    runs = None
    bench = patterns.tokens(t("benchmark"), "item_id", "text")
    for n in range(1, 8):
        part = patterns.mine(bench, n, 1).select("pattern", "pattern_id")
        runs = part if runs is None else runs.union(part)
    return patterns.coverage_size(patterns.tokens(t("documents"), "doc_id", "text"), runs)


# vectors and ranking ----------------------------------------------------


@query("SELECT 'D' || lpad((('0x' || substr(sha256(text), 1, 12))::BIGINT)::VARCHAR, 15, '0') AS did, len(list_distinct([('0x' || substr(md5(substr(text, i, 3)), 1, 8))::BIGINT % 2048 FOR i IN range(1, greatest(length(text) - 2, 1) + 1)])) AS ones FROM (SELECT DISTINCT text FROM benchmark WHERE text IS NOT NULL)")
def fingerprint_index(t):
    return vectors.fingerprints(t("benchmark"), "text").select("did", F.col("ones").cast("long").alias("ones"))


@query(
    "WITH b AS (SELECT text, list_distinct([('0x' || substr(md5(substr(text, i, 3)), 1, 8))::BIGINT % 2048 FOR i IN range(1, greatest(length(text) - 2, 1) + 1)]) AS bits FROM (SELECT DISTINCT text FROM benchmark WHERE text IS NOT NULL)) "
    "SELECT 'D' || lpad((('0x' || substr(sha256(text), 1, 12))::BIGINT)::VARCHAR, 15, '0') AS did, to_base64(unhex(array_to_string(list_transform(range(0, 256), lambda i: printf('%02x', coalesce(list_sum(list_transform(list_filter(bits, lambda b: b // 8 = i), lambda b: 1 << (7 - b % 8))), 0)::BIGINT)), ''))) AS packed FROM b"
)
def fingerprint_texts(t):
    return vectors.fingerprints(t("benchmark"), "text").select("did", vectors.packed_bits(F.col("bits")).alias("packed"))


@query("SELECT doc_id AS id, CASE WHEN text IS NULL THEN 'no text' WHEN len(text) % 11 = 0 THEN 'no vector' WHEN len(text) % 7 = 0 THEN 'ValueError: odd text' END AS error FROM documents")
def embed_report(t):
    """The report of a vectoriser that returns nothing for some texts and raises on others."""

    def lengths(texts):
        if any(len(x) % 7 == 0 and len(x) % 11 for x in texts):
            raise ValueError("odd text")
        return [[float(len(x))] if len(x) % 11 else None for x in texts]

    return vectors.embed_report(t("documents"), "doc_id", "text", lengths, 1).select("id", "error")


@query("SELECT label, i - 1 AS position, round(avg(embedding[i]), 6) AS mean FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i")
def mean_pool(t):
    return vectors.mean_pool(t("embeddings"), "label", "embedding").select("label", F.col("position").cast("long").alias("position"), r6(F.col("mean"), "mean"))


@query("WITH s AS (SELECT avg(p_size) AS ms, stddev_samp(p_size) AS ss, avg(p_retailprice) AS mp, stddev_samp(p_retailprice) AS sp FROM part) SELECT p_partkey, round((p_size - ms) / ss, 6) AS p_size, round((p_retailprice - mp) / sp, 6) AS p_retailprice FROM part, s")
def zscore_columns(t):
    z = vectors.zscores(t("part"), "p_partkey", ["p_size", "p_retailprice"])
    return z.select("p_partkey", r6(F.col("p_size"), "p_size"), r6(F.col("p_retailprice"), "p_retailprice"))


C = "p AS (SELECT label, i, avg(embedding[i]) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i), c AS (SELECT label AS context, list(m ORDER BY i) AS cv, sqrt(sum(m * m)) AS cn FROM p GROUP BY label), sc AS (SELECT context, vec_id AS id, label, list_inner_product(embedding::DOUBLE[], cv) / ((sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8) * (cn + 1e-8)) AS score FROM embeddings, c), rk AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY round(score, 9) DESC, id) AS rank FROM sc)"


def _scores(t) -> DataFrame:
    e = t("embeddings")
    rows = vectors.score_contexts(e, vectors.mean_pool(e, "label", "embedding"), "label", "embedding")
    return rows.select("context", F.col("vec_id").alias("id"), "label", F.round("score", 9).alias("score"))


def _scored(t) -> DataFrame:
    return rank.rank_rows(_scores(t), "context", "score", "id")


@query(f"WITH {C} SELECT context, id, rank, round(score, 6) AS score FROM rk WHERE rank <= 10")
def knn_cosine(t):
    e = t("embeddings").where("embedding is not null")
    return vectors.nearest_to_pools(e, vectors.mean_pool(e, "label", "embedding"), "label", "vec_id", "embedding", 10).select("context", "id", F.col("rank").cast("long").alias("rank"), r6(F.col("score"), "score"))


@query(f"WITH {C}, v AS (SELECT label, sum(score) AS vote FROM rk WHERE rank <= 20 GROUP BY label) SELECT label, CASE WHEN (SELECT max(vote) = min(vote) FROM v) THEN 1.0 ELSE round((vote - (SELECT min(vote) FROM v)) / ((SELECT max(vote) FROM v) - (SELECT min(vote) FROM v)), 4) END AS affinity FROM v")
def two_hop_vote(t):
    return vectors.scaled_votes(_scored(t).where("rank <= 20"), "label", "score")


@query(f"WITH {C} SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(1.0 / rank), 6) AS mrr FROM rk WHERE label = context")
def ranking_metrics(t):
    m = rank.ranking_metrics(_scored(t), "label = context")
    return m.select("n", *[r6(F.col(c), c) for c in ("recall_1", "recall_5", "mrr")])


@query(f"WITH {C}, e AS (SELECT context, avg(1.0 / rank) AS mrr, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END) AS h5, avg(CASE WHEN rank <= 50 THEN 1.0 ELSE 0 END) AS h50 FROM rk WHERE label = context GROUP BY context) SELECT count(*) AS contexts, round(avg(mrr), 6) AS mrr, round(avg(h5), 6) AS hit_5, round(avg(h50), 6) AS hit_50 FROM e")
def heldout_metrics(t):
    ranked = _scored(t)
    held = t("embeddings").select(F.col("label").alias("context"), F.col("vec_id").alias("id"))
    m = rank.heldout_metrics(ranked, "context", held, (5, 50))
    return m.select("contexts", *[r6(F.col(c), c) for c in ("mrr", "hit_5", "hit_50")])


@query(f"WITH {C}, m AS (SELECT context AS model_id, avg(1.0 / rank) FILTER (label = context AND context % 3 <> 0) AS mrr, avg(score) FILTER (label = context) - avg(score) FILTER (label <> context) AS margin FROM rk GROUP BY context) SELECT model_id, round(coalesce(mrr, margin), 6) AS selection_score, row_number() OVER (ORDER BY coalesce(mrr, margin) DESC, model_id) AS rank_among_models FROM m")
def model_selection(t):
    ranked = _scored(t)
    mg = rank.margins(ranked.withColumn("pos", F.col("label") == F.col("context")).withColumn("neg", F.col("label") != F.col("context")), "context", "score", "pos", "neg")
    mrr = ranked.where("label = context and context % 3 <> 0").groupBy("context").agg(F.avg(1.0 / F.col("rank")).alias("mrr"))
    out = rank.select_models(mg.join(mrr, "context", "left").withColumnRenamed("context", "model_id"))
    return out.select("model_id", r6(F.col("selection_score"), "selection_score"), F.col("rank_among_models").cast("long").alias("rank_among_models"))


@query("SELECT n_regionkey, subset, ids[bit + 1] AS n_nationkey FROM (SELECT n_regionkey, list_sort(list(n_nationkey)) AS ids FROM nation GROUP BY 1), (SELECT unnest(range(1, 4095)) AS subset), (SELECT unnest(range(0, 12)) AS bit) WHERE bit < len(ids) AND subset <= (1 << len(ids)) - 2 AND subset & (1 << bit) <> 0")
def positive_subsets(t):
    return rank.subsets(t("nation"), "n_regionkey", "n_nationkey").select("n_regionkey", F.col("subset").cast("long").alias("subset"), "n_nationkey")


# registry ---------------------------------------------------------------


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(t):
    e = t("events").select("user_id", "event_type", "event_id", "ts", "value")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    order = [F.desc("ts"), F.desc("event_id")]
    once = registry.upsert_latest(old, new, ["user_id", "event_type"], order)
    return registry.upsert_latest(once, new, ["user_id", "event_type"], order).select("user_id", "event_type", "event_id", "value")


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def stub_parents(t):
    return registry.stub_parents(t("events"), t("customer").select(F.col("c_custkey").alias("user_id")), "user_id")


@query("SELECT event_type, coalesce(c_mktsegment, 'missing_model') AS status, count(*) AS n FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY 1, 2")
def results_left_join_status(t):
    known = t("customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return registry.status_of(t("events"), known, "user_id", "c_mktsegment", "missing_model").groupBy("event_type", "status").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_artifacts(t):
    return tasks.missing_artifacts(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT 'lineitem' AS child, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'events', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def fk_violations(t):
    return registry.orphans({"lineitem": (t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"), "events": (t("events"), "user_id", t("customer"), "c_custkey")})


@query(" UNION ALL ".join(f"SELECT '{n}' AS layer, count(*) AS n FROM {n}" for n in ("part", "supplier", "customer", "orders", "lineitem")))
def layer_counts(t):
    return registry.table_counts({n: t(n) for n in ("part", "supplier", "customer", "orders", "lineitem")})


_RIGHT = "r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 17 <> 0)"
_REC = f"{_RIGHT}, j AS (SELECT l.o_orderkey, r.o_orderkey AS k, l.o_orderstatus IS DISTINCT FROM r.o_orderstatus AS a, l.o_orderpriority IS DISTINCT FROM r.o_orderpriority AS b FROM orders l LEFT JOIN r USING (o_orderkey)), m AS (SELECT o_orderkey, 'missing_right' AS status, '' AS col FROM j WHERE k IS NULL UNION ALL SELECT o_orderkey, 'mismatch', 'o_orderstatus' FROM j WHERE k IS NOT NULL AND a UNION ALL SELECT o_orderkey, 'mismatch', 'o_orderpriority' FROM j WHERE k IS NOT NULL AND b)"


def reconciled_tables(t) -> tuple[DataFrame, DataFrame]:
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    right = o.where(k % 17 != 0).select("o_orderkey", F.when(k % 11 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 13 == 0, "X").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return o, right


def _reconciled(t) -> DataFrame:
    return registry.reconcile(*reconciled_tables(t), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query(f"WITH {_REC} SELECT o_orderkey, status, col FROM m")
def reconcile_tables(t):
    return _reconciled(t).select("o_orderkey", "status", F.col("column").alias("col"))


@query(f"WITH {_REC} SELECT col, count(*) AS n FROM m WHERE status = 'mismatch' GROUP BY col ORDER BY n DESC, col LIMIT 5")
def mismatch_columns(t):
    return _reconciled(t).where("status = 'mismatch'").groupBy(F.col("column").alias("col")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "col").limit(5)


@query("SELECT event_id, 'k' AS key, props->>'$.k' AS value, true AS applied FROM events WHERE props->>'$.k' IS NOT NULL")
def manifest_fields(t):
    return registry.flatten_json(t("events"), "event_id", "props", ["k"]).where("key = 'k'")


@query("SELECT p_brand, 'v' || lpad((max(p_size) + 1)::VARCHAR, 3, '0') AS next_version FROM part GROUP BY 1")
def version_next(t):
    return registry.next_version(t("part").withColumn("v", F.concat(F.lit("v"), F.lpad(F.col("p_size").cast("string"), 3, "0"))), "p_brand", F.col("v"))


@query("SELECT p_brand, count(*) AS n_rows, sha256(string_agg(concat_ws(',', trim(p_partkey::VARCHAR), coalesce(trim(p_name), '')), chr(10) ORDER BY p_partkey)) AS checksum FROM part GROUP BY 1")
def binding_check(t):
    return registry.checksums(t("part"), "p_brand", "p_partkey", ["p_partkey", "p_name"])


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_n(t):
    return registry.recent(t("events"), 20, "ts", "event_id").select("event_id", "user_id", "ts")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN NULL ELSE value END DESC NULLS LAST, event_id) AS r FROM events) WHERE r = 1")
def best_row(t):
    e = t("events").withColumn("s", F.when(F.col("event_type") != "error", F.col("value")))
    return registry.best_row(e, "user_id", ["s"], "event_id").select("user_id", "event_id", "value")


@query("SELECT event_type AS model_id, count(*) AS runs, count(*) FILTER (value > 0) AS with_score, max_by(event_id, value * 1000000 + event_id / 1000000) AS best FROM events GROUP BY 1")
def batch_summary(t):
    runs = model_runs(t("events").select(F.lit(None).cast("string").alias("model_id"), F.concat(F.lit("/models/"), F.col("event_type"), F.lit("/")).alias("model_run_root"), "event_id", "value"))
    return runs.groupBy("model_id").agg(F.count("*").alias("runs"), F.count_if(F.col("value") > 0).alias("with_score"), F.max_by("event_id", F.col("value") * 1000000 + F.col("event_id") / 1000000).alias("best"))


@query("SELECT o_orderkey, l_partkey, 'stale' AS state FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate > l_shipdate UNION SELECT o_orderkey, l_partkey, 'current' FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate <= l_shipdate")
def stale_items(t):
    rows = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return registry.freshness(rows, "l_shipdate", "o_orderdate").select("o_orderkey", "l_partkey", "state").distinct()


@query("SELECT s_suppkey, s_nationkey::FLOAT AS a, s_acctbal::FLOAT AS b FROM supplier")
def hub_vector_columns(t):
    v = hub_vectors(t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_suppkey")
    return v.select("s_suppkey", F.col("vector")[0].alias("a"), F.col("vector")[1].alias("b"))


@query()
def embed_items(t):
    def hashed(texts):
        import zlib

        out = []
        for text in texts:
            v = [0.0] * 32
            for w in text.split():
                v[zlib.crc32(w.encode()) % 32] += 1.0
            out.append(v)
        return out

    return vectors.embed_items(t("documents"), "doc_id", "text", hashed, 32)


@query()
def score_candidates(t):
    e = t("embeddings")
    ctx = vectors.mean_pool(e, "label", "embedding").groupBy(F.col("label").alias("context")).agg(F.sort_array(F.collect_list(F.struct("position", "mean"))).alias("p")).select("context", F.transform("p", lambda x: x["mean"]).alias("vector"))
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return models.score_candidates(ctx, rows, {"relu": models.Encoder.of_size(64, 1), "silu": models.Encoder.of_size(64, 2, "silu")}, 64)


def flagship(t) -> DataFrame:
    """For each item its nearest items by weighted Jaccard distance, with the label of each hub."""
    h, edges = hub_pairs(t), save_table(edges_of(t), "edges")
    d = graph.weighted_jaccard(graph.candidates(edges, _sizes(t), D, K, SEED), edges, graph.feature_weights(edges))
    return sampling.known_split(d, h, h)


from graphmine.plans import task_queries  # noqa: E402, F401  registers its queries
