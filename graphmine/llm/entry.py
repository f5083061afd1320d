"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann_forest import nearest
from .embedding_dedup import embedding_dedup
from .filter_audit import filter_audit
from .html_extract import main_text
from .ngram_join import ngram_join
from .packing import pack_documents
from .piece_bpe import piece_digests
from .quality import quality
from .secrets import secrets_report
from .shallot import CENTROIDS, DIM, ROUNDS, SCALE, SEED, centroid_clusters
from .suffix_dedup import passage_report
from .token_ids import token_id_files
from .toxicity import toxicity


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_id_files(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_report(_table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json")).drop("n_loss")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents")).rows


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_report(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_shallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_ids": op1_token_ids,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_html_extract": op3_html_extract,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_secrets": op5_secrets,
        "op6_nearest": op6_nearest,
        "op7_packing": op7_packing,
        "op8_ngram_join": op8_ngram_join,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_filter_audit": op11_filter_audit,
        "op12_quality": op12_quality,
        "op13_shallot": op13_shallot,
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP8 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))
), r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""


_OP9 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, p - 1 AS p, md5(array_to_string(w[p:p + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM w WHERE len(w) >= 50)
), r AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1 AS late FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c > 1
), k AS (SELECT doc_id, p, 'repeated' AS kind FROM r UNION ALL SELECT doc_id, p, 'removed' FROM r WHERE late
), s AS (
  SELECT doc_id, kind, p, CASE WHEN p > lag(p) OVER (PARTITION BY kind, doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS new FROM k
), i AS (SELECT doc_id, kind, p, sum(new) OVER (PARTITION BY kind, doc_id ORDER BY p) AS island FROM s
), j AS (SELECT doc_id, kind, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, kind, island
), t AS (SELECT doc_id, kind, sum(b - a)::BIGINT AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM j GROUP BY doc_id, kind)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(x.n, 0) AS n_repeated, coalesce(y.n, 0) AS n_removed, coalesce(x.spans, '') AS repeated, coalesce(y.spans, '') AS removed
FROM w LEFT JOIN t x ON x.doc_id = w.doc_id AND x.kind = 'repeated' LEFT JOIN t y ON y.doc_id = w.doc_id AND y.kind = 'removed'
"""


#: Each order's steps are simulated on the counts of failure sets: what earlier filters removed is a set of letters.
_OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d
), f AS (
  SELECT part, doc_id, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
         regexp_matches(t, '[#$%&*|]'), coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS fails FROM w
), g AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN g USING (doc_id) GROUP BY part, fails
), l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT part, o, k.i AS step, o[k.i] AS f, sum(n) FILTER (NOT early AND NOT fails[o[k.i]]) AS kept, sum(n) FILTER (NOT early AND fails[o[k.i]]) AS removed,
         sum(n) FILTER (early AND fails[o[k.i]]) AS redundant, sum(n) FILTER (fails[o[k.i]] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
         sum(good) FILTER (NOT early AND fails[o[k.i]]) AS good_lost, sum(toxic) FILTER (NOT early AND fails[o[k.i]]) AS toxic_lost
  FROM (SELECT *, len(list_filter(o[1:k.i - 1], lambda x: fails[x])) > 0 AS early FROM m, o, l k) AS k GROUP BY ALL
)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept,
       coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM s
"""


def _op13() -> str:
    """One block for each round: all distances (exact in doubles at these sizes), the nearest, the floors of the means."""
    out = [
        f"v AS (SELECT vec_id, v, list_inner_product(v, v) AS vv FROM (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings "
        f"WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}))",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c, v AS m FROM v QUALIFY c < {CENTROIDS})",
    ]
    for r in range(ROUNDS + 1):
        distance = "vv - 2 * list_inner_product(v, m) + list_inner_product(m, m)"
        out.append(f"a{r} AS (SELECT vec_id, v, c, d FROM (SELECT vec_id, v, c, {distance} AS d, row_number() OVER (PARTITION BY vec_id ORDER BY {distance}, c) AS r FROM v, c{r}) WHERE r = 1)")
        if r < ROUNDS:
            out.append(f"s{r} AS (SELECT c, i, floor(sum(v[i]) / count(*)) AS x FROM a{r}, (SELECT unnest(range(1, {DIM + 1})) AS i) GROUP BY c, i)")
            out.append(f"c{r + 1} AS (SELECT c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN (SELECT c, list(x ORDER BY i) AS m FROM s{r} GROUP BY c) n USING (c))")
    digest = "sha256(array_to_string(list_transform(m, lambda x: x::BIGINT::VARCHAR), ','))"
    last = f"a{ROUNDS}"
    return (
        f"WITH {', '.join(out)} SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, sum(d::BIGINT) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, "
        f"sum(d::BIGINT) OVER ()::BIGINT AS inertia, {digest} AS centroid_sha256 FROM {last} JOIN c{ROUNDS} USING (c)"
    )


def oracle_sql() -> dict[str, str]:
    return {
        "op8_ngram_join": _OP8,
        "op9_suffix_dedup": _OP9,
        "op11_filter_audit": _OP11,
        "op13_shallot": _op13(),
    }
