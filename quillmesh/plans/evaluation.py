"""Retrieval queries over `embeddings`, and evaluation of a score over `documents` and `labels`.

Embeddings have the entity `label` and the source vec_id mod 3. The score of a labelled document is
n_chars / (n_chars + 2000), its logit (n_chars - 2000) / 2000, its label `quality`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions.scores import weighted_bce
from quillmesh.operators import evaluate as E
from quillmesh.operators import retrieval as R
from quillmesh.storage import Stage


def vectors(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("entity"), (F.col("vec_id") % 3).alias("source"))


def ranked(s, d, k=20):
    v = vectors(s, d)
    return Stage(s, "ranked").put(R.top_k(v, v, k), "t")


def scored(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars")
    labels = s.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    n = F.col("n_chars").cast("double")
    return docs.join(labels, "doc_id").select("doc_id", "label", F.round(n / (n + 2000.0), 6).alias("score"), ((n - 2000.0) / 2000.0).alias("logit"))


V = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label AS entity, vec_id % 3 AS source FROM embeddings),
sim AS (SELECT a.id AS query_id, b.id AS cand_id, a.entity = b.entity AS same, round(list_dot_product(a.e, b.e), 9) AS sim FROM v a JOIN v b ON a.id <> b.id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, cand_id) AS rank FROM sim)"""
SC = """s AS (SELECT d.doc_id, quality AS label, round(CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + 2000.0), 6) AS score, (CAST(n_chars AS DOUBLE) - 2000.0) / 2000.0 AS logit FROM documents d JOIN labels USING (doc_id))"""
RATIO = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
 round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy"""
SWEEP = f"""sw AS (SELECT step, step / 50.0 AS threshold, count(*) FILTER (score >= step / CAST(50 AS DOUBLE) AND label = 1) AS tp, count(*) FILTER (score >= step / CAST(50 AS DOUBLE) AND label <> 1) AS fp,
 count(*) FILTER (score < step / CAST(50 AS DOUBLE) AND label = 1) AS fn, count(*) FILTER (score < step / CAST(50 AS DOUBLE) AND label <> 1) AS tn FROM s, range(51) t(step) GROUP BY step),
swr AS (SELECT CAST(step AS INTEGER) AS step, step / CAST(50 AS DOUBLE) AS threshold, tp, fp, fn, tn, {RATIO} FROM sw)"""
CUM = """pts AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) AS n FROM s GROUP BY score),
cum AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(n) OVER w AS cum_n FROM pts WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
BIN = """b AS (SELECT greatest(score, 1 - score) AS c, CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END AS r FROM s),
bb AS (SELECT c, r, greatest(0, (SELECT count(*) FROM range(10) t(k) WHERE c > k * CAST(0.1 AS DOUBLE)) - 1) AS bin FROM b)"""

QUERIES, ORACLES = {}, {}


def _add(name, fn, prefix=None, body=None):
    QUERIES[name] = fn
    if body:
        ORACLES[name] = f"WITH {prefix}\n{body}"


_add("cosine_topk", lambda s, d: R.top_k(vectors(s, d), vectors(s, d), 10), V, "SELECT query_id, cand_id, sim, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 10")
_add(
    "metrics_at_k",
    lambda s, d: R.metrics_at_k(ranked(s, d), vectors(s, d), vectors(s, d)),
    V + """, pos AS (SELECT query_id, count(*) FILTER (same) AS n_pos FROM sim GROUP BY 1), h AS (SELECT query_id, k, count(*) FILTER (same AND rank <= k) AS h FROM rk, (VALUES (1), (5), (10)) t(k) GROUP BY ALL)""",
    """SELECT k, round(sum(CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END) / (SELECT count(*) FROM v), 4) AS hit, round(sum(h / n_pos) / (SELECT count(*) FROM v), 4) AS recall,
 round(sum(h / least(k, n_pos)) / (SELECT count(*) FROM v), 4) AS recall_norm, round(sum(h / k) / (SELECT count(*) FROM v), 4) AS precision FROM h JOIN pos USING (query_id) WHERE n_pos > 0 GROUP BY k""",
)
_add("mrr", lambda s, d: R.mean_reciprocal_rank(vectors(s, d), vectors(s, d)), V, "SELECT round(avg(1 / r), 6) AS mrr, count(*) AS n_queries FROM (SELECT query_id, min(rank) AS r FROM rk WHERE same GROUP BY 1)")
_add(
    "separability",
    lambda s, d: R.separability(vectors(s, d), vectors(s, d)),
    V + ", m AS (SELECT avg(sim) FILTER (same) AS mp, stddev_pop(sim) FILTER (same) AS sp, avg(sim) FILTER (NOT same) AS mn, stddev_pop(sim) FILTER (NOT same) AS sn FROM sim)",
    "SELECT round(mp, 6) AS mean_pos, round(sp, 6) AS std_pos, round(mn, 6) AS mean_neg, round(sn, 6) AS std_neg, round((mp - mn) / sqrt((sp * sp + sn * sn) / 2), 6) AS delta FROM m",
)
_add("candidate_pool_stats", lambda s, d: R.pool_statistics(vectors(s, d)), V, "SELECT count(*) AS n_entities, max(n) AS max_positives, round(avg(n), 6) AS mean_positives, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_many FROM (SELECT count(*) AS n FROM v GROUP BY entity)")
def linkable(s, d):
    """Vectors of entities with two sources or more."""
    v = vectors(s, d)
    return v.join(v.groupBy("entity").agg(F.countDistinct("source").alias("n")).filter("n >= 2").select("entity"), "entity", "left_semi")


def hard(s, d, **options):
    v = linkable(s, d)
    return R.mine_hard_pairs(Stage(s, "ranked").put(R.top_k(v, v, 20, exact=True), "t"), v, **options)


HARD = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label AS entity, vec_id % 3 AS source FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(DISTINCT vec_id % 3) >= 2)),
sim AS (SELECT a.id AS query_id, b.id AS cand_id, round(list_dot_product(a.e, b.e), 9) AS sim FROM v a JOIN v b ON a.id <> b.id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, cand_id) AS rank FROM sim), near AS (SELECT DISTINCT least(query_id, cand_id) AS id_a, greatest(query_id, cand_id) AS id_b FROM rk WHERE rank <= 20),
hp AS (SELECT a.id AS id_a, b.id AS id_b, 1 AS label, round(list_dot_product(a.e, b.e), 6) AS similarity, CASE WHEN near.id_a IS NOT NULL THEN 'positive' ELSE 'hard_positive' END AS type FROM v a JOIN v b ON a.entity = b.entity AND a.id < b.id AND a.source <> b.source LEFT JOIN near ON near.id_a = a.id AND near.id_b = b.id
 UNION ALL SELECT near.id_a, near.id_b, 0, round(list_dot_product(a.e, b.e), 6), 'hard_negative' FROM near JOIN v a ON a.id = near.id_a JOIN v b ON b.id = near.id_b WHERE a.entity <> b.entity AND a.source <> b.source)"""
_add("hard_pairs", hard, HARD, "SELECT id_a, id_b, CAST(label AS INTEGER) AS label, similarity, type FROM hp")
_add("hard_pair_type_counts", lambda s, d: hard(s, d).groupBy("type").agg(F.count("*").alias("n_pairs")), HARD, "SELECT type, count(*) AS n_pairs FROM hp GROUP BY type")
_add("hard_pairs_few_easy", lambda s, d: hard(s, d, max_easy=25).groupBy("type").agg(F.count("*").alias("n_pairs")), HARD, "SELECT type, CASE WHEN type = 'positive' THEN least(count(*), 25) ELSE count(*) END AS n_pairs FROM hp GROUP BY type")
_add(
    "sanity_margin",
    lambda s, d: R.sanity_margin(_neighbours(s, d)),
    "p AS (SELECT CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b, a.label = b.label AS same FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1), m AS (SELECT avg(list_dot_product(a, b)) FILTER (same) AS p, avg(list_dot_product(a, b)) FILTER (NOT same) AS n FROM p)",
    "SELECT round(p, 6) AS mean_pos, round(n, 6) AS mean_neg, round(p - n, 6) AS margin, p >= 0.75 AS passed FROM m",
)


def _neighbours(s, d):
    """Each vector of an even id with the next one."""
    v = vectors(s, d)
    left = v.filter("id % 2 = 0").select((F.col("id") + 1).alias("other"), F.col("embedding").alias("a"), F.col("entity").alias("ea"))
    return left.join(v.select(F.col("id").alias("other"), F.col("embedding").alias("b"), F.col("entity").alias("eb")), "other").select("a", "b", (F.col("ea") == F.col("eb")).alias("same"))


_add(
    "cross_source_topk",
    lambda s, d: R.top_k(vectors(s, d).filter("source = 0"), vectors(s, d).filter("source = 1"), 5),
    V + ", x AS (SELECT a.id AS query_id, b.id AS cand_id, round(list_dot_product(a.e, b.e), 9) AS sim FROM v a JOIN v b ON a.source = 0 AND b.source = 1)",
    "SELECT * FROM (SELECT query_id, cand_id, sim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, cand_id) AS INTEGER) AS rank FROM x) WHERE rank <= 5",
)
_add("binary_metrics", lambda s, d: E.binary_metrics(scored(s, d)), SC + ", c AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label <> 1) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label <> 1) AS tn, count(*) AS n FROM s)", f"SELECT tp, fp, fn, tn, n, {RATIO} FROM c")
_add("threshold_sweep", lambda s, d: E.threshold_sweep(scored(s, d)), SC + ", " + SWEEP, "SELECT * FROM swr")
_add("best_threshold", lambda s, d: E.best_threshold(scored(s, d)), SC + ", " + SWEEP, "SELECT round(threshold, 6) AS threshold, f1 FROM swr ORDER BY f1 DESC, threshold LIMIT 1")
_add("pr_auc", lambda s, d: E.average_precision(scored(s, d)), SC + ", " + CUM, "SELECT round(sum(pos * cum_pos / cum_n) / sum(pos), 6) AS average_precision FROM cum")
_add("roc_auc", lambda s, d: E.roc_auc(scored(s, d)), SC + ", " + CUM, "SELECT round(sum((n - pos) * (cum_pos - pos + pos / 2)) / (sum(pos) * sum(n - pos)), 6) AS roc_auc FROM cum")
_add("score_by_class", lambda s, d: E.score_statistics(scored(s, d)), SC, "SELECT label, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM s GROUP BY label")
_add("reliability_curve", lambda s, d: E.reliability(scored(s, d)), SC + ", " + BIN, "SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(r), 6) AS accuracy, round(avg(c), 6) AS confidence FROM bb GROUP BY 1")
_add("ece", lambda s, d: E.calibration_error(scored(s, d)), SC + ", " + BIN, "SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM (SELECT count(*) AS n, avg(r) AS a, avg(c) AS c FROM bb GROUP BY bin)")
_add(
    "uncertainty",
    lambda s, d: E.uncertainty(scored(s, d).select("doc_id", "label", "logit"), temperature=2.0).drop("logit"),
    SC + ", p AS (SELECT doc_id, label, 1 / (1 + exp(-logit / 2)) AS p FROM s), q AS (SELECT *, least(greatest(p, 1e-12), 1 - 1e-12) AS c FROM p)",
    "SELECT doc_id, label, round(p, 6) AS prob, round(-(c * log2(c) + (1 - c) * log2(1 - c)), 6) AS entropy, round(abs(p - 0.12), 6) AS margin FROM q",
)
_add(
    "weighted_bce",
    lambda s, d: scored(s, d).agg(F.round(F.avg(weighted_bce(F.col("logit"), F.col("label").cast("double"), 8.0)), 6).alias("loss")),
    SC,
    "SELECT round(avg(8.0 * label * (greatest(-logit, 0) + ln(1 + exp(-abs(logit)))) + (1 - label) * (greatest(logit, 0) + ln(1 + exp(-abs(logit))))), 6) AS loss FROM s",
)
_add("temperature_fit", lambda s, d: s.createDataFrame([(round(E.fit_temperature(scored(s, d)), 3),)], "temperature double"))
