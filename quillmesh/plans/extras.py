"""Further linkage, retrieval, model and profiling queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions.text import name_key
from quillmesh.operators import linkage as L
from quillmesh.operators import models as M
from quillmesh.operators import profile as P
from quillmesh.operators import retrieval as R
from quillmesh.plans.evaluation import vectors
from quillmesh.plans.linkage import REC, SCORED, TAG, classified, q, records, tagged
from quillmesh.sources.tables import fetch_rows

QUERIES, ORACLES = {}, {}


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


_add("null_key_diagnostics", lambda s, d: L.null_key_diagnostics(records(s, d), "A"), q(
    REC, "SELECT coalesce(o, 'none') AS found_in, count(*) AS n FROM (SELECT record_id, (SELECT string_agg(DISTINCT b.source, '+' ORDER BY b.source) FROM rec b WHERE b.key = a.key AND b.source <> 'A') AS o FROM rec a WHERE source = 'A' AND exp IS NULL) GROUP BY 1"
))
_add(
    "linkage_key_versions",
    lambda s, d: L.compare_keys(records(s, d).withColumns({"exp": F.floor(F.col("record_id") / 60), "old": name_key(F.col("name"), sort_tokens=False)}), "old", "key"),
    q(REC + r""", k AS (SELECT *, record_id // 60 AS g, regexp_replace(upper(name), '[^A-Z ]', '', 'g') AS old FROM rec)""",
      """SELECT a.source AS source_a, b.source AS source_b, count(*) FILTER (a.old = b.old) AS n_old, count(*) FILTER (a.key = b.key) AS n_new, count(*) FILTER (a.key = b.key AND a.old <> b.old) AS n_gained,
 count(*) FILTER (a.key <> b.key AND a.old = b.old) AS n_lost, round(100 * count(*) FILTER (a.key = b.key AND a.old <> b.old) / greatest(count(*) FILTER (a.key = b.key), 1), 4) AS pct_gained FROM k a JOIN k b ON a.g = b.g AND a.source < b.source GROUP BY 1, 2"""),
)
_add(
    "residual_pairs_export",
    lambda s, d: classified(s, d).filter(F.col("criterion") == L.OPEN).select("source_a", "source_b", "id_a", "id_b", F.concat_ws(" | ", "key_a", "key_b").alias("names")),
    q(SCORED, "SELECT source_a, source_b, id_a, id_b, key_a || ' | ' || key_b AS names FROM cls WHERE criterion = 'unconfirmed'"),
)
_add("display_clusters", lambda s, d: L.display_clusters(tagged(s, d)), q(TAG, "SELECT entity_id, min(record_id) AS first_record FROM tag GROUP BY 1 HAVING count(*) = 3 AND count(DISTINCT source) = 3"))
_add("fetch_rows", lambda s, d: fetch_rows(records(s, d), 10, 19).select("record_id", "source", "name"), q(REC, "SELECT record_id, source, name FROM rec WHERE record_id BETWEEN 10 AND 19"))
_add(
    "source_offsets",
    lambda s, d: P.running_offsets(records(s, d), "source"),
    q(REC, "SELECT source, n, CAST(sum(n) OVER (ORDER BY source) - n AS BIGINT) AS \"offset\" FROM (SELECT source, count(*) AS n FROM rec GROUP BY source)"),
)
_add(
    "directional_metrics",
    lambda s, d: R.directional_metrics(vectors(s, d), [0, 1, 2]).select(F.col("source_a").cast("long").alias("source_a"), F.col("source_b").cast("long").alias("source_b"), "n_queries", "hit", "precision"),
    """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label AS entity, vec_id % 3 AS source FROM embeddings),
x AS (SELECT a.source AS sa, b.source AS sb, a.id AS qid, a.entity = b.entity AS same, row_number() OVER (PARTITION BY a.id, b.source ORDER BY round(list_dot_product(a.e, b.e), 9) DESC, b.id) AS r,
 bool_or(a.entity = b.entity) OVER (PARTITION BY a.id, b.source) AS ok FROM v a JOIN v b ON a.source <> b.source),
h AS (SELECT sa, sb, qid, count(*) FILTER (same AND r <= 5) AS h FROM x WHERE ok GROUP BY 1, 2, 3)
SELECT sa AS source_a, sb AS source_b, count(*) AS n_queries, round(avg(CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END), 4) AS hit, round(avg(h / 5), 4) AS precision FROM h GROUP BY 1, 2""",
)


def _training_pairs(s, d):
    v = vectors(s, d).select("id", "embedding")
    a = v.filter("id % 2 = 0").select(F.floor(F.col("id") / 2).alias("row"), F.col("embedding").alias("a"))
    b = v.filter("id % 2 = 1").select(F.floor(F.col("id") / 2).alias("row"), F.col("embedding").alias("b"))
    return a.join(b, "row").withColumn("batch", F.floor(F.col("row") / 32))


_add(
    "batch_ranking_loss",
    lambda s, d: M.batch_ranking_loss(_training_pairs(s, d)),
    """WITH p AS (SELECT a.vec_id // 2 AS r, a.vec_id // 2 // 32 AS bt, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1),
z AS (SELECT x.r AS ra, y.r AS rb, list_dot_product(x.a, y.b) / 0.07 AS z FROM p x JOIN p y ON x.bt = y.bt)
SELECT round(avg(l), 6) AS loss, count(*) AS n FROM (SELECT ra, ln(sum(exp(z))) - max(z) FILTER (ra = rb) AS l FROM z GROUP BY ra)""",
)


def _encoded(s, d):
    recs = M.encode(records(s, d).filter("key <> ''").select(F.col("record_id").alias("id"), "key"), "key")
    return R.top_k(recs.filter("id % 50 = 0"), recs, 5)


_add("encoded_neighbours", _encoded)
_add(
    "categorical_resume",
    lambda s, d: P.categorical_resume(s.read.parquet(f"{d}/customer.parquet").select(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.concat(F.col("c_mktsegment"), F.lit(" "))).alias("v0")), "v0"),
    """WITH c AS (SELECT v, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment || ' ' END AS v FROM customer) WHERE v IS NOT NULL GROUP BY v)
SELECT count(*) AS n_raw, count(DISTINCT upper(trim(v))) AS n_normal, count(*) FILTER (n = 1) AS n_single, count(DISTINCT upper(trim(v))) < count(*) AS reduces FROM c""",
)
_add(
    "identifier_composition",
    lambda s, d: P.identifier_composition(s.read.parquet(f"{d}/events.parquet").select(F.when(F.col("event_id") % 5 == 0, "S/E").when(F.col("event_id") % 5 == 1, F.concat(F.col("user_id").cast("string"), F.lit(".0"))).when(F.col("event_id") % 5 == 2, F.col("event_type")).when(F.col("event_id") % 5 == 3, F.col("user_id").cast("string")).alias("v")), "v"),
    """WITH e AS (SELECT CASE event_id % 5 WHEN 0 THEN 'S/E' WHEN 1 THEN user_id || '.0' WHEN 2 THEN event_type WHEN 3 THEN CAST(user_id AS VARCHAR) END AS v FROM events)
SELECT CASE WHEN v IS NULL THEN 'null' WHEN v = 'S/E' THEN 'sentinel' WHEN regexp_matches(v, '^\\d+\\.?0?$') THEN 'numeric' ELSE 'other' END AS kind, count(*) AS n, count(DISTINCT v) AS n_distinct FROM e GROUP BY 1""".replace("\\\\", "\\"),
)
