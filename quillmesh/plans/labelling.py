"""Queries of the review sheet, the labelling steps, reports, training tables and the smaller profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text as X
from quillmesh.operators import consolidate
from quillmesh.operators import linkage as L
from quillmesh.operators import profile as P
from quillmesh.operators import serialize as S
from quillmesh.operators import training as T
from quillmesh.operators.labelling import Labelling, key_label_statistics, labelled_by_key, linkage_report, report_json
from quillmesh.plans.linkage import REC, REV, SCORED, TAG, candidates, q, records, reviewed, tagged
from quillmesh.plans.profiling import CUST, _cust
from quillmesh.sources.sheets import read_sheet, write_sheet
from quillmesh.sources.tables import json_schema_dictionary
from quillmesh.storage import Stage

QUERIES, ORACLES = {}, {}


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


def t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _sheet(s, d):
    path = f"{Stage(s, 'sheet').root}/pairs_for_review.xlsx"
    write_sheet(reviewed(s, d).select("id_a", "id_b", "source_a", "source_b", "exp_shared", "key_a", "key_b", F.round("jw", 3).alias("jw"), F.round("lev", 3).alias("lev"), "criterion", "decision"), path)
    return read_sheet(s, path)


_add("review_sheet", _sheet, q(REV, "SELECT id_a, id_b, source_a, source_b, exp_shared, nullif(trim(key_a), '') AS key_a, nullif(trim(key_b), '') AS key_b, round(jw, 3) AS jw, round(lev, 3) AS lev, criterion, nullif(trim(decision), '') AS decision FROM rev"))


def _labelled(s, d):
    """The two steps, with the decisions of reviewed() in between; records are named by their part key."""
    recs = records(s, d).withColumns({"text": F.col("record_id").cast("string"), "place": F.col("record_id")})
    work = Labelling(s, Stage(s, "labelling").root)
    work.classify([recs.filter(F.col("source") == x) for x in "ABC"])
    ids = s.read.parquet(work.records_path).select(F.col("text").cast("long").alias("part"), F.col("record_id").alias("own"))
    said = reviewed(s, d).select("id_a", "id_b", "decision").join(ids.toDF("id_a", "a"), "id_a").join(ids.toDF("id_b", "b"), "id_b")
    work.decide(said.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "decision"))
    done = work.finalize().select(F.col("text").cast("long").alias("record_id"), "entity_id")
    return done.join(done.groupBy("entity_id").agg(F.min("record_id").alias("root")), "entity_id").select("record_id", "root")


_add("labelling_steps", _labelled, q(TAG, "SELECT record_id, root FROM tag"))
_add(
    "review_merge_report",
    lambda s, d: L.merge_report(reviewed(s, d).filter("id_a % 5 <> 0").select("id_a", "id_b", "decision"), reviewed(s, d).filter("id_a % 3 <> 0").select("id_a", "id_b", F.when(F.col("id_b") % 2 == 0, "match").alias("decision"))),
    q(REV + """, n AS (SELECT id_a, id_b, decision FROM rev WHERE id_a % 5 <> 0), o AS (SELECT id_a, id_b, CASE WHEN id_b % 2 = 0 THEN 'match' END AS was FROM rev WHERE id_a % 3 <> 0)""",
      """SELECT (SELECT count(*) FROM o) AS n_old, (SELECT count(*) FROM n) AS n_new, (SELECT count(*) FROM o ANTI JOIN n USING (id_a, id_b)) AS n_lost, (SELECT count(*) FROM n ANTI JOIN o USING (id_a, id_b)) AS n_added,
 (SELECT count(*) FROM n JOIN o USING (id_a, id_b) WHERE was IS NOT NULL) AS n_copied, (SELECT count(*) FROM n LEFT JOIN o USING (id_a, id_b) WHERE was IS NOT NULL OR coalesce(trim(decision), '') <> '') AS n_filled,
 (SELECT count(*) FROM n LEFT JOIN o USING (id_a, id_b) WHERE was IS NULL AND coalesce(trim(decision), '') = '') AS n_open"""),
)
KEYED = REC + r""", e AS (SELECT *, dense_rank() OVER (ORDER BY f) - 1 AS entity_id FROM (SELECT *, min(record_id) OVER (PARTITION BY exp, key) AS f FROM rec)),
one AS (SELECT exp, source, entity_id, min(record_id) AS r FROM e WHERE exp IS NOT NULL GROUP BY ALL), sz AS (SELECT entity_id, count(*) AS n, count(DISTINCT source) AS s FROM e GROUP BY 1)"""
_add(
    "key_label_statistics",
    lambda s, d: key_label_statistics(labelled_by_key(records(s, d))),
    q(KEYED, """SELECT CAST(sum(n) AS BIGINT) AS n_records, count(*) AS n_entities, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS n_pairs, CAST(sum(s * (s - 1) // 2) AS BIGINT) AS n_confirmed,
 (SELECT count(*) FROM one a JOIN one b ON a.exp = b.exp AND a.r < b.r AND a.source <> b.source) AS n_same_key, (SELECT count(*) FROM one a JOIN one b ON a.exp = b.exp AND a.r < b.r AND a.source <> b.source AND a.entity_id <> b.entity_id) AS n_residual FROM sz"""),
)
SPACE = """n AS (SELECT source, count(*) AS n FROM rec GROUP BY 1), sk AS (SELECT x.source AS sa, y.source AS sb, count(*) AS k FROM (SELECT DISTINCT source, exp FROM rec) x JOIN (SELECT DISTINCT source, exp FROM rec) y ON x.exp = y.exp AND x.source < y.source GROUP BY 1, 2),
sp AS (SELECT a.source AS sa, b.source AS sb, a.n * b.n AS space, coalesce(k, 0) AS k FROM n a JOIN n b ON a.source < b.source LEFT JOIN sk ON sk.sa = a.source AND sk.sb = b.source)"""
_add("space_totals", lambda s, d: L.space_totals(records(s, d), L.pair_space(records(s, d))), q(REC + ", " + SPACE, "SELECT (SELECT count(*) FROM rec) AS n_records, (SELECT count(*) * (count(*) - 1) // 2 FROM rec) AS n_pairs, CAST(sum(space) AS BIGINT) AS n_cross_pairs, CAST(sum(k) AS BIGINT) AS n_shared_keys FROM sp"))
_add("region_total", lambda s, d: L.region_total(L.source_regions(tagged(s, d))), q(TAG, "SELECT count(DISTINCT entity_id) AS n_entities FROM tag"))
_add("residual_entity_pairs", lambda s, d: L.residual_entity_pairs(tagged(s, d)), q(TAG + ", one AS (SELECT exp, source, entity_id, min(record_id) AS r FROM tag WHERE exp IS NOT NULL GROUP BY ALL)",
     "SELECT count(*) AS n_same_key, count(*) FILTER (a.entity_id <> b.entity_id) AS n_residual FROM one a JOIN one b ON a.exp = b.exp AND a.r < b.r AND a.source <> b.source"))
OUTCOME = """oc AS (SELECT source_a || '+' || source_b AS c, count(*) FILTER (criterion = 'exact_key') AS n_exact, count(*) FILTER (criterion = 'classic_metric') AS n_metric,
 count(*) FILTER (criterion = 'unconfirmed' AND coalesce(trim(decision), '') IN ('', 'match')) AS n_review_match, count(*) FILTER (criterion = 'unconfirmed' AND decision = 'no_match') AS n_review_no_match,
 count(*) AS n_candidates, count(*) FILTER (criterion <> 'unconfirmed' OR coalesce(trim(decision), '') IN ('', 'match')) AS n_positive FROM rev GROUP BY 1)"""
_ONE = lambda section, name, value, table: f"SELECT '{section}' AS section, {name} AS name, CAST({value} AS BIGINT) AS value FROM {table}"
REPORT = " UNION ALL ".join([
    _ONE("space", "sa || '+' || sb || '.space'", "space", "sp"), _ONE("space", "sa || '+' || sb || '.shared_keys'", "k", "sp"),
    _ONE("totals", "'all.n_records'", "count(*)", "rec"), _ONE("totals", "'all.n_pairs'", "count(*) * (count(*) - 1) // 2", "rec"), _ONE("totals", "'all.n_cross_pairs'", "sum(space)", "sp"), _ONE("totals", "'all.n_shared_keys'", "sum(k)", "sp"),
    *[_ONE("outcomes", f"c || '.{x}'", x, "oc") for x in ("n_exact", "n_metric", "n_review_match", "n_review_no_match", "n_candidates", "n_positive")],
    "SELECT 'regions', region, count(*) FROM (SELECT string_agg(DISTINCT source, '+' ORDER BY source) AS region FROM tag GROUP BY entity_id) GROUP BY 2",
    *[_ONE("entities", f"'all.{x}'", f"count(*) FILTER ({c})", "es") for x, c in (("n_entities", "true"), ("in_two", "s = 2"), ("in_three", "s >= 3"), ("singletons", "n = 1"), ("pairs", "n = 2"), ("triads", "n = 3"), ("larger", "n > 3"))],
])
_report = lambda s, d: linkage_report(records(s, d), reviewed(s, d), tagged(s, d))
REPORT_WITH = TAG + ", " + SPACE + ", " + OUTCOME + ", es AS (SELECT entity_id, count(*) AS n, count(DISTINCT source) AS s FROM tag GROUP BY 1)"
_add("linkage_report", _report, q(REPORT_WITH, REPORT))
_add("linkage_report_json", lambda s, d: report_json(_report(s, d)).select(F.size(F.json_object_keys("json")).cast("long").alias("n_sections"), F.get_json_object("json", "$.entities['all.n_entities']").cast("long").alias("n_entities")), q(TAG, "SELECT 5 AS n_sections, count(DISTINCT entity_id) AS n_entities FROM tag"))
_add(
    "pair_index",
    lambda s, d: L.pair_index(L.scored_pairs(candidates(s, d)).select(F.when(F.col("id_a") % 2 == 0, F.col("id_a")).otherwise(F.col("id_b")).alias("id_a"), F.when(F.col("id_a") % 2 == 0, F.col("id_b")).otherwise(F.col("id_a")).alias("id_b"), "jw", "lev")),
    q(SCORED, "SELECT least(id_a, id_b) AS id_a, greatest(id_a, id_b) AS id_b, min(jw) AS jw, min(lev) AS lev FROM scored GROUP BY 1, 2"),
)


def _legacy(s, d):
    docs = consolidate.legacy_documents(tagged(s, d).select("entity_id", "record_id", "source", "key", "exp", "name"), L.pair_index(L.scored_pairs(candidates(s, d))))
    return docs.select(
        "entity_id", "cluster_size", F.array_join(F.transform("linked_items", lambda x: x["source"]), "+").alias("sources"), F.array_join(F.transform("records", lambda r: r["name"]), "|").alias("names"), F.size("scores").cast("long").alias("n_scores"),
        F.round(F.aggregate(F.transform("scores", lambda x: x["value"]), F.lit(0.0), lambda a, b: a + b), 4).alias("total"),
    )


_add("legacy_documents", _legacy, q(TAG + """, pi AS (SELECT least(id_a, id_b) AS a, greatest(id_a, id_b) AS b, min(jw) AS jw, min(lev) AS lev FROM scored GROUP BY 1, 2),
sc AS (SELECT x.entity_id, 2 * count(*) AS n, sum(round(jw, 4) + round(lev, 4)) AS total FROM pi JOIN tag x ON x.record_id = a JOIN tag y ON y.record_id = b AND x.entity_id = y.entity_id GROUP BY 1)""",
    """SELECT tag.entity_id, count(*) AS cluster_size, string_agg(source, '+' ORDER BY record_id) AS sources, string_agg(name, '|' ORDER BY record_id) AS names, coalesce(any_value(sc.n), 0) AS n_scores, round(coalesce(any_value(total), 0), 4) AS total
 FROM tag LEFT JOIN sc ON sc.entity_id = tag.entity_id GROUP BY tag.entity_id"""))
_BLK = [("ALL", ["c_custkey", "c_mktsegment", "c_region"]), ("SEG", ["c_mktsegment"])]
_add("serialize_blocks_tok", lambda s, d: _cust(s, d).select("c_custkey", S.serialize_blocks(_cust(s, d), _BLK).alias("text")), f"WITH {CUST} SELECT c_custkey, concat_ws(' ', '[BLK_ALL] [COL] c_custkey [VAL] ' || c_custkey || ' [COL] c_mktsegment [VAL] ' || coalesce(m, 'NULL') || ' [COL] c_region [VAL] ' || coalesce(CAST(r AS VARCHAR), 'NULL'), '[BLK_SEG] [COL] c_mktsegment [VAL] ' || m) AS text FROM c")
_add("serialize_blocks_notok", lambda s, d: _cust(s, d).select("c_custkey", S.serialize_blocks(_cust(s, d), _BLK, False).alias("text")), f"WITH {CUST} SELECT c_custkey, concat_ws(' ', 'c_custkey: ' || c_custkey, 'c_mktsegment: ' || m, 'c_region: ' || r, 'c_mktsegment: ' || m) AS text FROM c")
_add("name_text", lambda s, d: _cust(s, d).select("c_custkey", S.name_text(_cust(s, d), "c_mktsegment", ("c_name", "c_region")).alias("text")), f"WITH {CUST} SELECT c_custkey, CASE WHEN m IS NOT NULL THEN 'c_mktsegment: ' || m ELSE 'nombre: ' || concat_ws(' ', c_name, r) END AS text FROM c")
_add("name_flags", lambda s, d: t(s, d, "part").select("p_partkey", X.name_flags(F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), "p_type")))).alias("f")).select("p_partkey", "f.*"),
     r"""WITH n AS (SELECT p_partkey, concat_ws(' ', p_name, CASE WHEN p_partkey % 3 = 0 THEN '  ' || p_type END) AS x FROM part), k AS (SELECT *, len(list_filter(regexp_split_to_array(trim(x), '\s+'), lambda w: w <> '')) AS n FROM n)
SELECT p_partkey, n AS n_tokens, n = 2 AS two_tokens, n >= 5 AS many_tokens, regexp_matches(x, '  +') AS multi_space FROM k""")
_add("plain_key", lambda s, d: t(s, d, "part").select("p_partkey", X.plain_key(F.concat("p_name", F.lit("  é "), "p_type")).alias("key")), r"SELECT p_partkey, regexp_replace(strip_accents(upper(trim(p_name || '  é ' || p_type))), '\s+', ' ', 'g') AS key FROM part")
_add("binary_flags", lambda s, d: t(s, d, "labels").select("doc_id", X.to_flag(F.when(F.col("doc_id") % 4 != 0, F.col("quality").cast("double"))).alias("quality"), X.to_flag(F.when(F.col("toxic") == 1, "true").otherwise("2")).alias("toxic")),
     "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN CAST(quality AS BIGINT) END AS quality, CASE WHEN toxic = 1 THEN CAST(1 AS BIGINT) END AS toxic FROM labels")
_add("anchored_patterns", lambda s, d: t(s, d, "events").select("event_id", F.concat(F.substr("event_type", F.lit(1), F.lit(1)), F.format_string("%02d", F.col("user_id") % 100)).rlike(X.CODE).alias("code"), F.concat(F.upper(F.substr("event_type", F.lit(1), F.lit(3))), F.format_string("%06d", F.col("event_id"))).rlike(X.HISTORY_ID).alias("history"), F.concat(F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".0").otherwise(".5")).rlike(X.NUMERIC_ID).alias("numeric")),
     r"""SELECT event_id, regexp_matches(substr(event_type, 1, 1) || printf('%02d', user_id % 100), '(?i)^[A-Z]\d{2}(\.\d{1,2})?$') AS code, regexp_matches(upper(substr(event_type, 1, 3)) || printf('%06d', event_id), '^[A-Z]{3}\d{6}$') AS history,
 regexp_matches(user_id || CASE WHEN event_id % 2 = 0 THEN '.0' ELSE '.5' END, '^\d+\.?0?$') AS numeric FROM events""")
_add("domain_outliers", lambda s, d: P.domain_outliers(t(s, d, "lineitem"), {"l_quantity": (5, 45), "l_discount": (None, 0.08)}), """SELECT 'l_quantity' AS "column", count(*) FILTER (l_quantity < 5) AS n_low, count(*) FILTER (l_quantity > 45) AS n_high FROM lineitem UNION ALL SELECT 'l_discount', 0, count(*) FILTER (l_discount > 0.08) FROM lineitem""")
_add("declared_difference", lambda s, d: P.declared_difference(_docs_declared(s, d), "n_chars", F.char_length("text"), 5), "SELECT count(*) AS n_both, count(*) FILTER (x > 5) AS n_apart, round(avg(x), 6) AS mean_apart FROM (SELECT abs(length(text) - (n_chars + doc_id % 9)) AS x FROM documents) WHERE x IS NOT NULL")
_add("equals_row_number", lambda s, d: P.equals_row_number(t(s, d, "labels"), "doc_id", ["doc_id"]), "SELECT count(*) AS n, count(*) FILTER (doc_id = rn) AS n_equal FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM labels)")
_add("group_sizes", lambda s, d: P.group_sizes(t(s, d, "documents"), ["text"]), "SELECT n AS size, count(*) AS n_groups FROM (SELECT count(*) AS n FROM documents GROUP BY text) WHERE n > 1 GROUP BY n")
_add("head_rows", lambda s, d: P.head_rows(t(s, d, "orders").select("o_orderkey", "o_totalprice"), 20, ["o_totalprice", "o_orderkey"], F.col("o_orderstatus") == "F"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 20")
_add("sample_rows", lambda s, d: P.sample_rows(t(s, d, "orders").select("o_orderkey"), 50, "o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '|42'), o_orderkey LIMIT 50")
_TOK = [("ID", ["c_custkey", "c_name"]), ("REST", ["c_mktsegment", "c_region"])]
_add("estimated_tokens", lambda s, d: _cust(s, d).select("c_custkey", P.estimated_tokens(_cust(s, d), _TOK, ("c_custkey",)).cast("long").alias("n")), rf"""WITH {CUST}, w AS (SELECT *, len(regexp_split_to_array(trim(c_name), '\s+')) AS wn, len(regexp_split_to_array(trim(m), '\s+')) AS wm FROM c)
SELECT c_custkey, CAST(1 + (2 + 3 + 1) + (2 + 1 + wn) + CASE WHEN m IS NULL AND r IS NULL THEN 0 ELSE 1 + (2 + coalesce(1 + wm, 1)) + (2 + CASE WHEN r IS NULL THEN 1 ELSE 2 END) END AS BIGINT) AS n FROM w""")
_add("running_mean", lambda s, d: T.running_mean(t(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"]), "SELECT o_orderkey, o_totalprice, round(sum(o_totalprice) OVER (ORDER BY o_orderkey) / row_number() OVER (ORDER BY o_orderkey), 6) AS running_mean FROM orders")
HIST = "h AS (SELECT o_orderpriority AS run, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS epoch, round(avg(o_totalprice), 2) AS loss FROM orders GROUP BY 1, 2)"
_history = lambda s, d: t(s, d, "orders").groupBy(F.col("o_orderpriority").alias("run"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("epoch")).agg(F.round(F.avg("o_totalprice"), 2).alias("loss"))
_add("early_stop", lambda s, d: T.early_stop(_history(s, d), 6), f"""WITH {HIST}, b AS (SELECT *, coalesce(loss < min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM h),
l AS (SELECT *, epoch - max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS since FROM b), st AS (SELECT run, min(CASE WHEN since >= 6 THEN epoch END) AS stop_epoch FROM l GROUP BY run)
SELECT l.run, arg_min(epoch, (loss, epoch)) AS best_epoch, min(loss) AS best_loss, stop_epoch FROM l JOIN st ON st.run = l.run AND (stop_epoch IS NULL OR epoch <= stop_epoch) GROUP BY l.run, stop_epoch""")
_SCHEMA = {"items": {"$ref": "#/$defs/entity"}, "$defs": {"entity": {"properties": {"id": {"type": "integer", "description": "number"}, "items": {"type": "array", "items": {"$ref": "#/$defs/item"}}, "note": {"type": ["string", "null"]}, "tags": {"type": "array", "items": {"type": "string"}}}}, "item": {"properties": {"source": {"type": "string"}, "values": {"type": "object", "properties": {"key": {"type": "number"}}}}}}}
_add("json_schema_dictionary", lambda s, d: s.createDataFrame([(k, *r) for k, r in enumerate(json_schema_dictionary(_SCHEMA))], "place int, path string, type string, description string"),
     "SELECT * FROM (VALUES (CAST(0 AS INTEGER), 'id', 'int', 'number'), (1, 'items', 'array<object>', ''), (2, 'items[].source', 'str', ''), (3, 'items[].values', 'object', ''), (4, 'items[].values.key', 'float', ''), (5, 'note', 'str|null', ''), (6, 'tags', 'array<str>', '')) v(place, path, type, description)")


def _docs_declared(s, d):
    return t(s, d, "documents").withColumn("n_chars", F.col("n_chars") + F.col("doc_id") % 9)
