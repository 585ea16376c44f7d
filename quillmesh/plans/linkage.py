"""Linkage queries over `part` in the role of three sources, with their SQL.

record_id is p_partkey, the source p_partkey mod 3, the file number p_partkey div 3 (null where 51 divides
p_partkey), the name p_name and p_type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import name_key
from quillmesh.operators import consolidate
from quillmesh.operators import linkage as L
from quillmesh.operators.registry import default_registry
from quillmesh.storage import Stage


def records(spark, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    pk = F.col("p_partkey")
    name = F.concat("p_name", F.lit(" "), "p_type")
    return part.select(
        pk.alias("record_id"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (pk % 3 + 1).cast("int")).alias("source"),
        F.when(pk % 51 != 0, F.floor(pk / 3)).alias("exp"), name.alias("name"), name_key(name).alias("key"),
    )


def candidates(spark, d: str) -> DataFrame:
    return L.candidate_pairs(records(spark, d), "A")


def classified(spark, d: str) -> DataFrame:
    return L.classify(L.scored_pairs(candidates(spark, d)))


def decided(spark, d: str) -> DataFrame:
    """The criteria alone, with Python for undecided pairs only."""
    return L.classify(L.scored_pairs(candidates(spark, d), undecided_only=True))


def reviewed(spark, d: str) -> DataFrame:
    """Classified pairs with decisions derived from their ids."""
    h = F.substring(F.md5(F.concat_ws("-", "id_a", "id_b")), 1, 1)
    decision = F.when(h.isin("0", "1", "2"), "match").when(h.isin("3", "4"), "no_match").when(h == "5", "")
    return classified(spark, d).withColumn("decision", decision)


def edges(spark, d: str) -> DataFrame:
    pairs = reviewed(spark, d).filter(L.is_positive(F.col("criterion"), F.col("decision"))).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
    return pairs.unionByName(L.star_edges(records(spark, d)))


def tagged(spark, d: str) -> DataFrame:
    """Records with entity ids; written once, since many plans read it several times."""
    recs = records(spark, d)
    return Stage(spark, "tagged").put(recs.join(L.entities(recs, edges(spark, d)), "record_id"), "t")


REC = r"""rec0 AS (SELECT p_partkey AS record_id, CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS source,
 CASE WHEN p_partkey % 51 <> 0 THEN p_partkey // 3 END AS exp, p_name || ' ' || p_type AS name FROM part),
rec AS (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_replace(strip_accents(upper(replace(trim(name), '?', 'N'))), '[^A-Z ]', '', 'g'), ' '), lambda t: t <> '')), ' ') AS key FROM rec0)"""
CAND = REC + r""",
rep AS (SELECT record_id, source, exp, key FROM (SELECT *, row_number() OVER (PARTITION BY exp, source, key ORDER BY record_id) AS rn FROM rec WHERE exp IS NOT NULL) WHERE rn = 1),
tgt AS (SELECT record_id, source, key FROM (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY record_id) AS rn FROM rec WHERE source <> 'A') WHERE rn = 1),
cand AS (SELECT a.record_id AS id_a, b.record_id AS id_b, a.source AS source_a, b.source AS source_b, a.key AS key_a, b.key AS key_b, a.exp AS exp_shared, false AS null_exp
 FROM rep a JOIN rep b ON a.exp = b.exp AND a.record_id < b.record_id AND a.source <> b.source
 UNION ALL SELECT a.record_id, b.record_id, a.source, b.source, a.key, b.key, NULL, true FROM rec a JOIN tgt b ON a.key = b.key WHERE a.source = 'A' AND a.exp IS NULL AND a.key <> '')"""
SCORED = CAND + r""",
scored AS (SELECT *, CASE WHEN key_a = key_b AND key_a <> '' THEN 1.0 ELSE round(jaro_winkler_similarity(key_a, key_b), 9) END AS jw,
 round(CASE WHEN greatest(length(key_a), length(key_b)) = 0 THEN 1.0 ELSE 1 - levenshtein(key_a, key_b) / greatest(length(key_a), length(key_b)) END, 9) AS lev FROM cand),
cls AS (SELECT *, CASE WHEN NOT null_exp AND key_a = key_b THEN 'exact_key' WHEN NOT null_exp AND (jw >= 0.88 OR lev >= 0.85) THEN 'classic_metric' ELSE 'unconfirmed' END AS criterion FROM scored)"""
REV = SCORED + r""",
rev AS (SELECT *, CASE WHEN h IN ('0', '1', '2') THEN 'match' WHEN h IN ('3', '4') THEN 'no_match' WHEN h = '5' THEN '' END AS decision FROM (SELECT *, substr(md5(id_a || '-' || id_b), 1, 1) AS h FROM cls))"""
POS = "(coalesce(decision = 'match', false) OR (coalesce(trim(decision), '') = '' AND criterion IN ('exact_key', 'classic_metric')))"
EDGES = REV + f""",
star AS (SELECT src, record_id AS dst FROM (SELECT record_id, min(record_id) OVER (PARTITION BY source, exp, key) AS src FROM rec WHERE exp IS NOT NULL AND key <> '') WHERE src <> record_id),
edge AS (SELECT id_a AS src, id_b AS dst FROM rev WHERE {POS} UNION ALL SELECT src, dst FROM star)"""
TAG = EDGES + r""",
sym AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge),
reach AS (SELECT record_id AS node, record_id AS other FROM rec UNION SELECT reach.node, sym.dst FROM reach JOIN sym ON reach.other = sym.src),
ent AS (SELECT node AS record_id, min(other) AS root FROM reach GROUP BY node),
tag AS (SELECT rec.*, ent.root, dense_rank() OVER (ORDER BY ent.root) - 1 AS entity_id FROM rec JOIN ent ON ent.record_id = rec.record_id)"""


def q(prefix: str, body: str) -> str:
    return f"WITH RECURSIVE {prefix}\n{body}"


QUERIES, ORACLES = {}, {}


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


_add("linkage_candidates", lambda s, d: L.key_candidates(records(s, d)), q(CAND, "SELECT * FROM cand WHERE NOT null_exp"))
_add("linkage_null_key_candidates", lambda s, d: L.null_key_candidates(records(s, d), "A"), q(CAND, "SELECT * FROM cand WHERE null_exp"))
_add("linkage_scores", lambda s, d: L.scored_pairs(candidates(s, d)).select("id_a", "id_b", "jw", "lev"), q(SCORED, "SELECT id_a, id_b, jw, lev FROM scored"))
_add("linkage_cascade", lambda s, d: decided(s, d).groupBy("criterion").agg(F.count("*").alias("n_pairs")), q(SCORED, "SELECT criterion, count(*) AS n_pairs FROM cls GROUP BY criterion"))
_add("linkage_classified", lambda s, d: decided(s, d).select("id_a", "id_b", "criterion"), q(SCORED, "SELECT id_a, id_b, criterion FROM cls"))
_add(
    "review_projection",
    lambda s, d: reviewed(s, d).select("id_a", "id_b", "source_a", "source_b", "exp_shared", "key_a", "key_b", F.round("jw", 3).alias("jw"), F.round("lev", 3).alias("lev"), "criterion", "decision"),
    q(REV, "SELECT id_a, id_b, source_a, source_b, exp_shared, key_a, key_b, round(jw, 3) AS jw, round(lev, 3) AS lev, criterion, decision FROM rev"),
)
_add(
    "review_state",
    lambda s, d: reviewed(s, d).select("id_a", "id_b", L.review_state(F.col("criterion"), F.col("decision")).alias("state")),
    q(REV, """SELECT id_a, id_b, CASE WHEN decision = 'match' THEN 'green' WHEN decision = 'no_match' THEN 'red' WHEN coalesce(trim(decision), '') = '' AND criterion IN ('exact_key', 'classic_metric') THEN 'green'
 WHEN coalesce(trim(decision), '') = '' AND criterion = 'unconfirmed' THEN 'yellow' ELSE 'none' END AS state FROM rev"""),
)
_add("review_precedence", lambda s, d: reviewed(s, d).select("id_a", "id_b", L.is_positive(F.col("criterion"), F.col("decision")).alias("positive")), q(REV, f"SELECT id_a, id_b, {POS} AS positive FROM rev"))
_add(
    "review_transitions",
    lambda s, d: L.settle(reviewed(s, d)).select("id_a", "id_b", "criterion", "decision"),
    q(REV, """SELECT id_a, id_b, CASE WHEN criterion = 'unconfirmed' AND coalesce(trim(decision), '') <> '' THEN 'manual_review' ELSE criterion END AS criterion,
 CASE WHEN criterion <> 'unconfirmed' AND coalesce(trim(decision), '') = '' THEN 'match' ELSE decision END AS decision FROM rev"""),
)
_add(
    "review_merge_decisions",
    lambda s, d: L.merge_decisions(
        reviewed(s, d).select("id_a", "id_b", "decision"), reviewed(s, d).filter("id_a % 2 = 0").select("id_a", "id_b", F.when(F.col("id_b") % 3 == 0, "").when(F.col("id_b") % 3 == 1, "match").alias("decision"))
    ),
    q(REV, "SELECT id_a, id_b, CASE WHEN id_a % 2 = 0 AND id_b % 3 = 1 THEN 'match' ELSE decision END AS decision FROM rev"),
)
_add("intra_source_edges", lambda s, d: L.star_edges(records(s, d).withColumn("exp", F.floor(F.col("record_id") / 60))), q(
    REC, "SELECT src, record_id AS dst FROM (SELECT record_id, min(record_id) OVER (PARTITION BY source, record_id // 60, key) AS src FROM rec WHERE key <> '') WHERE src <> record_id"
))
_add("entity_components", lambda s, d: L.entities(records(s, d), edges(s, d)), q(TAG, "SELECT record_id, root, entity_id FROM tag"))
_add(
    "entity_ids_exact_key",
    lambda s, d: L.first_seen_ids(records(s, d), ["exp", "key"]).select("record_id", "entity_id"),
    q(REC, "SELECT record_id, dense_rank() OVER (ORDER BY f) - 1 AS entity_id FROM (SELECT record_id, min(record_id) OVER (PARTITION BY exp, key) AS f FROM rec)"),
)
_add(
    "entity_size_classes",
    lambda s, d: tagged(s, d).groupBy("entity_id").agg(F.count("*").alias("n")).select(L.size_class(F.col("n")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n_entities")),
    q(TAG, "SELECT CASE n WHEN 1 THEN 'singleton' WHEN 2 THEN 'pair' WHEN 3 THEN 'triad' ELSE 'larger' END AS kind, count(*) AS n_entities FROM (SELECT count(*) AS n FROM tag GROUP BY entity_id) GROUP BY 1"),
)
_add(
    "entity_source_counts",
    lambda s, d: tagged(s, d).groupBy("entity_id").agg(F.countDistinct("source").alias("n_sources")).groupBy("n_sources").agg(F.count("*").alias("n_entities")),
    q(TAG, "SELECT n_sources, count(*) AS n_entities FROM (SELECT count(DISTINCT source) AS n_sources FROM tag GROUP BY entity_id) GROUP BY 1"),
)
_add(
    "entity_venn_regions",
    lambda s, d: L.source_regions(tagged(s, d)),
    q(TAG, "SELECT region, count(*) AS n_entities FROM (SELECT string_agg(DISTINCT source, '+' ORDER BY source) AS region FROM tag GROUP BY entity_id) GROUP BY 1"),
)
_add(
    "pair_space",
    lambda s, d: L.pair_space(records(s, d)),
    q(REC, """SELECT a.source AS source_a, b.source AS source_b, a.n * b.n AS space, coalesce(k.shared, 0) AS shared_keys FROM (SELECT source, count(*) AS n FROM rec GROUP BY 1) a
 JOIN (SELECT source, count(*) AS n FROM rec GROUP BY 1) b ON a.source < b.source
 LEFT JOIN (SELECT x.source AS sa, y.source AS sb, count(*) AS shared FROM (SELECT DISTINCT source, exp FROM rec) x JOIN (SELECT DISTINCT source, exp FROM rec) y ON x.exp = y.exp AND x.source < y.source GROUP BY 1, 2) k ON k.sa = a.source AND k.sb = b.source"""),
)
_CASCADE = """SELECT source_a, source_b, count(*) FILTER (criterion = 'exact_key') AS n_exact, count(*) FILTER (criterion = 'classic_metric') AS n_metric,
 count(*) FILTER (criterion = 'unconfirmed' AND coalesce(trim(decision), '') IN ('', 'match')) AS n_review_match, count(*) FILTER (criterion = 'unconfirmed' AND decision = 'no_match') AS n_review_no_match,
 count(*) AS n_candidates, count(*) FILTER (criterion <> 'unconfirmed' OR coalesce(trim(decision), '') IN ('', 'match')) AS n_positive FROM rev GROUP BY 1, 2"""
_add("cascade_by_cross", lambda s, d: L.cascade_by_cross(reviewed(s, d)), q(REV, _CASCADE))
_add(
    "manual_review_by_cross",
    lambda s, d: L.manual_review_by_cross(reviewed(s, d)),
    q(REV, "SELECT source_a, source_b, count(*) FILTER (decision = 'match') AS n_match, count(*) FILTER (decision = 'no_match') AS n_no_match, count(*) FILTER (coalesce(trim(decision), '') = '') AS n_blank FROM rev WHERE criterion = 'unconfirmed' GROUP BY 1, 2"),
)


def synthesis(s, d):
    """One row: pairs of different sources, positives, and negatives for each positive."""
    space = L.pair_space(records(s, d)).agg(F.sum("space").alias("space"))
    positive = L.cascade_by_cross(reviewed(s, d)).agg(F.sum("n_positive").alias("positive"))
    return space.crossJoin(positive).select("space", "positive", F.floor((F.col("space") - F.col("positive")) / F.greatest("positive", F.lit(1))).alias("imbalance"))


_add("synthesis_row", synthesis, q(REV, """SELECT space, positive, (space - positive) // greatest(positive, 1) AS imbalance FROM
 (SELECT (SELECT CAST(sum(a.n * b.n) AS BIGINT) FROM (SELECT source, count(*) AS n FROM rec GROUP BY 1) a JOIN (SELECT source, count(*) AS n FROM rec GROUP BY 1) b ON a.source < b.source) AS space,
 (SELECT count(*) FROM rev WHERE criterion <> 'unconfirmed' OR coalesce(trim(decision), '') IN ('', 'match')) AS positive)"""))
_add(
    "residual_and_confirmed_pairs",
    lambda s, d: classified(s, d).groupBy((F.col("criterion") != L.OPEN).alias("confirmed")).agg(F.count("*").alias("n_pairs"), F.countDistinct("exp_shared").alias("n_keys")),
    q(SCORED, "SELECT criterion <> 'unconfirmed' AS confirmed, count(*) AS n_pairs, count(DISTINCT exp_shared) AS n_keys FROM cls GROUP BY 1"),
)
SPLIT = TAG + r""",
kind AS (SELECT entity_id, count(DISTINCT source) >= 2 AS linkable FROM tag GROUP BY entity_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY linkable ORDER BY md5(entity_id || '|42'), entity_id) AS rn, count(*) OVER (PARTITION BY linkable) AS n FROM kind),
spl AS (SELECT entity_id, linkable, CASE WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM rk)"""
_add("entity_split", lambda s, d: L.split_entities(tagged(s, d)).select("record_id", "entity_id", "linkable", "split"), q(SPLIT, "SELECT record_id, tag.entity_id, linkable, split FROM tag JOIN spl ON spl.entity_id = tag.entity_id"))
_add(
    "entity_split_stats",
    lambda s, d: L.split_statistics(L.split_entities(tagged(s, d))),
    q(SPLIT, """SELECT split, count(*) FILTER (linkable) AS n_linkable, count(*) FILTER (NOT linkable) AS n_singleton, count(*) AS n_entities, CAST(sum(n) AS BIGINT) AS n_records, CAST(sum(s * (s - 1) // 2) AS BIGINT) AS n_natural_pairs
 FROM (SELECT spl.split, spl.entity_id, linkable, count(*) AS n, count(DISTINCT source) AS s FROM tag JOIN spl ON spl.entity_id = tag.entity_id GROUP BY ALL) GROUP BY split"""),
)
_add("linkable_records", lambda s, d: L.linkable(tagged(s, d)).select("record_id", "entity_id", "source"), q(TAG, "SELECT record_id, entity_id, source FROM tag WHERE entity_id IN (SELECT entity_id FROM tag GROUP BY 1 HAVING count(DISTINCT source) >= 2)"))
_add("unlinkable_records", lambda s, d: L.linkable(tagged(s, d), other=True).select("record_id", "entity_id", "source"), q(TAG, "SELECT record_id, entity_id, source FROM tag WHERE entity_id NOT IN (SELECT entity_id FROM tag GROUP BY 1 HAVING count(DISTINCT source) >= 2)"))
NAT = "SELECT a.entity_id, a.record_id AS id_a, b.record_id AS id_b, a.source AS source_a, b.source AS source_b FROM tag a JOIN tag b ON a.entity_id = b.entity_id AND a.source < b.source"
_add("natural_positive_pairs", lambda s, d: L.natural_pairs(tagged(s, d)), q(TAG, NAT))


def documents(s, d):
    return consolidate.entity_documents(tagged(s, d).select("entity_id", "record_id", "source", "key", "exp", "name"), default_registry())


_add(
    "entity_documents",
    lambda s, d: documents(s, d).select("entity_id", "cluster_size", F.array_join(F.transform("items", lambda x: x["record_id"].cast("string")), ",").alias("record_ids"), F.array_join(F.transform("items", lambda x: x["record"]["name"]), "|").alias("names")),
    q(TAG, "SELECT entity_id, count(*) AS cluster_size, string_agg(CAST(record_id AS VARCHAR), ',' ORDER BY record_id) AS record_ids, string_agg(name, '|' ORDER BY record_id) AS names FROM tag GROUP BY entity_id"),
)
_add(
    "entity_document_scores",
    lambda s, d: documents(s, d).select("entity_id", F.explode("scores").alias("x")).select("entity_id", "x.id_a", "x.id_b", "x.method", "x.value"),
    q(TAG + f""", nat AS ({NAT}), sc AS (SELECT nat.*, a.key AS ka, b.key AS kb, a.exp AS ea, b.exp AS eb FROM nat JOIN tag a ON a.record_id = id_a JOIN tag b ON b.record_id = id_b)""",
      """SELECT entity_id, id_a, id_b, method, value FROM (
 SELECT entity_id, id_a, id_b, 'exact_key' AS method, CAST(CASE WHEN ea IS NOT NULL AND eb IS NOT NULL THEN CASE WHEN ea = eb AND ka = kb THEN 1 ELSE 0 END END AS DOUBLE) AS value FROM sc
 UNION ALL SELECT entity_id, id_a, id_b, 'jaro_winkler', CASE WHEN ka <> '' AND kb <> '' THEN round(jaro_winkler_similarity(ka, kb), 4) END FROM sc
 UNION ALL SELECT entity_id, id_a, id_b, 'levenshtein', CASE WHEN ka <> '' AND kb <> '' THEN round(1 - levenshtein(ka, kb) / greatest(length(ka), length(kb)), 4) END FROM sc) WHERE value IS NOT NULL"""),
)
_add(
    "entity_documents_stats",
    lambda s, d: consolidate.document_statistics(documents(s, d)),
    q(TAG + f""", nat AS ({NAT}), sz AS (SELECT entity_id, count(*) AS n FROM tag GROUP BY 1), sc AS (SELECT nat.entity_id, sum(CASE WHEN a.exp IS NOT NULL AND b.exp IS NOT NULL THEN 3 ELSE 2 END) AS k FROM nat JOIN tag a ON a.record_id = id_a JOIN tag b ON b.record_id = id_b GROUP BY 1)""",
      """SELECT count(*) AS n_entities, count(*) FILTER (n = 1) AS n_singletons, count(*) FILTER (n = 2) AS n_pairs, count(*) FILTER (n >= 3) AS n_larger, max(n) AS max_size,
 CAST(coalesce(sum(k), 0) AS BIGINT) AS n_scores, count(*) FILTER (k IS NULL) AS n_without_scores FROM sz LEFT JOIN sc ON sc.entity_id = sz.entity_id"""),
)
_add(
    "entity_documents_json",
    lambda s, d: consolidate.as_json(documents(s, d)).select("entity_id", F.get_json_object("document", "$.cluster_size").cast("long").alias("cluster_size"), F.get_json_object("document", "$.items[0].record.name").alias("first_name")),
    q(TAG, "SELECT entity_id, count(*) AS cluster_size, arg_min(name, record_id) AS first_name FROM tag GROUP BY entity_id"),
)
_add(
    "names_by_key",
    lambda s, d: records(s, d).filter("exp is not null").groupBy("exp").agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("record_id", "name"))), lambda x: x["name"])), " | ").alias("names")),
    q(REC, "SELECT exp, string_agg(name, ' | ' ORDER BY r) AS names FROM (SELECT exp, name, min(record_id) AS r FROM rec WHERE exp IS NOT NULL GROUP BY exp, name) GROUP BY exp"),
)
_add("comparator_catalogue", lambda s, d: default_registry().catalogue(s), """SELECT * FROM (VALUES (CAST(0 AS INTEGER), 'exact_key', 'exp,key', '{0,1}', 'equal file number and equal name key'),
 (1, 'jaro_winkler', 'key', '[0,1]', 'Jaro-Winkler similarity of name keys'), (2, 'levenshtein', 'key', '[0,1]', 'Levenshtein similarity of name keys')) t(place, method, fields, span, description)""")
