"""Cleaning, serialisation, set and data-quality queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text as X
from quillmesh.operators import augment as A
from quillmesh.operators import cleaning as C
from quillmesh.operators import profile as P
from quillmesh.operators import serialize as S

QUERIES, ORACLES = {}, {}


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


def t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


SQZ = r"regexp_replace(regexp_replace({0}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g'), '[\s\x{{00A0}}]+', ' ', 'g')"
KEY = r"array_to_string(list_sort(list_filter(string_split(regexp_replace(strip_accents(upper(replace(replace(trim(coalesce({0}, '')), 'ß', 'SS'), '?', 'N'))), '[^A-Z ]', '', 'g'), ' '), lambda t: t <> '')), ' ')"

# cleaning
SPEC = C.SourceSpec(lost_letter=("text",), names=("text",), drop=("n_chars",), rename={"text": "body"}, name_parts=("lang", "source"), full_name="origin")
_docs = lambda s, d: t(s, d, "documents")
_add("clean_profile_min", lambda s, d: C.apply_profile(_docs(s, d), "min", SPEC).select("doc_id", F.md5("text").alias("text_md5"), "n_chars"), f"SELECT doc_id, md5(replace({SQZ.format('text')}, '?', 'Ñ')) AS text_md5, n_chars FROM documents")
_add(
    "clean_profile_std",
    lambda s, d: C.apply_profile(_docs(s, d), "std", SPEC).select("doc_id", F.md5("text").alias("text_md5"), "origin"),
    f"SELECT doc_id, md5(replace({SQZ.format('text')}, '?', 'Ñ')) AS text_md5, trim(coalesce(lang, '') || ' ' || coalesce(source, '')) AS origin FROM documents",
)
_add(
    "clean_profile_renamed",
    lambda s, d: C.apply_profile(_docs(s, d), "renamed", SPEC).select("doc_id", F.md5("body").alias("body_md5"), "origin"),
    f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace({SQZ.format('text')}, '?', 'Ñ'), '[.|/]', '', 'g'), '\\s{{2,}}', ' ', 'g'))) AS body_md5, trim(coalesce(lang, '') || ' ' || coalesce(source, '')) AS origin FROM documents",
)
_add(
    "clean_profile_full",
    lambda s, d: C.apply_profile(t(s, d, "supplier"), "full", C.SourceSpec(names=("s_name",), rename={"s_name": "name"})).select("s_suppkey", "name", "s_name_key"),
    f"SELECT s_suppkey, trim(regexp_replace(regexp_replace(upper({SQZ.format('s_name')}), '[.|/]', '', 'g'), '\\s{{2,}}', ' ', 'g')) AS name, {KEY.format('upper(s_name)')} AS s_name_key FROM supplier",
)
_add(
    "name_key",
    lambda s, d: _docs(s, d).select("doc_id", X.name_key(F.col("text")).alias("key"), X.name_key(F.col("text"), sort_tokens=False).alias("key_v1")),
    f"SELECT doc_id, {KEY.format('text')} AS key, {KEY.format('text').replace('list_sort', '')} AS key_v1 FROM documents",
)
_add("whitespace_key", lambda s, d: _docs(s, d).select("doc_id", F.md5(F.upper(X.squeeze_space(F.translate("text", "ß", "s")))).alias("key")), f"SELECT doc_id, md5(upper({SQZ.format(chr(39).join(['replace(text, ', 'ß', ', ', 's', ')']))})) AS key FROM documents")
_add(
    "numeric_parse",
    lambda s, d: t(s, d, "events").select("event_id", X.to_number(F.get_json_object("props", "$.k")).alias("k"), X.to_number(F.col("event_type")).alias("none"), X.to_key(F.when(F.col("event_id") % 7 == 0, "S/E").otherwise(F.concat(F.col("user_id").cast("string"), F.lit(".0")))).alias("key")),
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS none, CASE WHEN event_id % 7 <> 0 THEN user_id END AS key FROM events",
)
_add(
    "age_parse",
    lambda s, d: t(s, d, "events").select("event_id", X.age_years(F.when(F.col("event_id") % 3 == 0, F.concat(F.col("user_id").cast("string"), F.lit(" AÑOS 3 meses"))).when(F.col("event_id") % 3 == 1, F.col("user_id").cast("string")).otherwise("5 meses")).alias("age")),
    "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN user_id END AS age FROM events",
)
_add(
    "date_parse",
    lambda s, d: t(s, d, "orders").select("o_orderkey", X.parse_date(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("no date")).alias("day")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
)
FV = "CASE WHEN {0} IS NULL THEN '' ELSE regexp_replace(regexp_replace(CAST(CAST(round(CAST({0} AS DECIMAL(28,10)), 2) AS DECIMAL(28,2)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') END"
_add("format_value", lambda s, d: t(s, d, "part").select("p_partkey", X.format_value(F.col("p_retailprice")).alias("price"), X.format_value(F.col("p_size")).alias("size"), X.format_value(F.concat(F.lit("00"), F.col("p_size").cast("string"))).alias("padded"), X.format_value(F.concat(F.lit(" "), "p_name")).alias("name")),
     f"SELECT p_partkey, {FV.format('p_retailprice')} AS price, CAST(p_size AS VARCHAR) AS size, CAST(p_size AS VARCHAR) AS padded, p_name AS name FROM part")
BLOCKS = [("ID", ["c_custkey", "c_name"]), ("ADMIN", ["c_mktsegment", "missing"]), ("GEO", ["c_region"])]
_cust = lambda s, d: t(s, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("c_region"))
CUST = "c AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS m, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS r FROM customer)"
for _tok in (True, False):
    for _skip in (True, False):
        _n = f"serialize_{'tok' if _tok else 'notok'}_{'skipnull' if _skip else 'keepnull'}"
        _v = (lambda c, col, b: f"CASE WHEN {c} IS NOT NULL THEN '[BLK_{b}] [COL] {col} [VAL] ' || {c} END") if _tok else (lambda c, col, b: f"CASE WHEN {c} IS NOT NULL THEN '{col}: ' || {c} END")
        _id = "'[BLK_ID] [COL] c_custkey [VAL] ' || c_custkey || ' [COL] c_name [VAL] ' || c_name" if _tok else "'c_custkey: ' || c_custkey || ', c_name: ' || c_name"
        _add(_n, lambda s, d, a=_tok, b=_skip: _cust(s, d).select("c_custkey", S.serialize(_cust(s, d), BLOCKS, a, b).alias("text")), f"WITH {CUST} SELECT c_custkey, concat_ws('{' ' if _tok else '. '}', {_id}, {_v('m', 'c_mktsegment', 'ADMIN')}, {_v('r', 'c_region', 'GEO')}) AS text FROM c")
_add("serialize_keepnull_inside", lambda s, d: _cust(s, d).select("c_custkey", S.serialize(_cust(s, d), [("ALL", ["c_custkey", "c_mktsegment", "c_region"])], True, False).alias("text")),
     f"WITH {CUST} SELECT c_custkey, '[BLK_ALL] [COL] c_custkey [VAL] ' || c_custkey || ' [COL] c_mktsegment [VAL] ' || coalesce(m, 'NULL') || ' [COL] c_region [VAL] ' || coalesce(CAST(r AS VARCHAR), 'NULL') AS text FROM c")
_add("serialize_zeroshot", lambda s, d: _cust(s, d).select("c_custkey", S.serialize_zeroshot(_cust(s, d)).alias("text")), f"WITH {CUST} SELECT c_custkey, concat_ws(', ', 'c_custkey: ' || c_custkey, 'c_name: ' || c_name, 'c_mktsegment: ' || m, 'c_region: ' || r) AS text FROM c")
_add("serialize_pretty", lambda s, d: _cust(s, d).select("c_custkey", S.pretty(_cust(s, d)).alias("text")), f"WITH {CUST} SELECT c_custkey, concat_ws(chr(10), 'c_custkey: ' || c_custkey, 'c_name: ' || c_name, 'c_mktsegment: ' || m, 'c_region: ' || r) AS text FROM c")
_add("serialize_parse", lambda s, d: _cust(s, d).select("c_custkey", F.explode(S.parse(S.serialize(_cust(s, d), BLOCKS))).alias("x")).select("c_custkey", "x.block", "x.col", "x.val"),
     f"WITH {CUST} SELECT c_custkey, 'ID' AS block, 'c_custkey' AS col, CAST(c_custkey AS VARCHAR) AS val FROM c UNION ALL SELECT c_custkey, 'ID', 'c_name', c_name FROM c UNION ALL SELECT c_custkey, 'ADMIN', 'c_mktsegment', m FROM c WHERE m IS NOT NULL UNION ALL SELECT c_custkey, 'GEO', 'c_region', CAST(r AS VARCHAR) FROM c WHERE r IS NOT NULL")


def _augmented(s, d, fn):
    c = _cust(s, d)
    return c.select("c_custkey", S.serialize(c, BLOCKS, True, False).alias("text")).select("c_custkey", "text", fn(F.col("text"), F.col("c_custkey")).alias("augmented"))


_add("augment_shuffle_mask", lambda s, d: _augmented(s, d, lambda x, k: A.mask_attributes(A.shuffle_columns(A.shuffle_blocks(x, k, 1), k, 1), k, 1, 0.3, ("c_name",))))
_add("augment_typos", lambda s, d: _augmented(s, d, lambda x, k: A.inject_typos(x, k, 1, 0.3)))
_add("augment_all", lambda s, d: _augmented(s, d, lambda x, k: A.augment(x, k, 7, span=0.2)))

# profiles
_ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
_add("column_profile", lambda s, d: P.column_profile(t(s, d, "orders")).withColumn("example", F.when(F.col("dtype").isin("bigint", "string"), F.col("example"))), " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{k}' AS dtype, count(*) AS rows, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INTEGER) AS n_values,
 round(100 * (count(*) - count({c})) / greatest(count(*), 1), 4) AS null_pct, {f"CAST(min({c}) AS VARCHAR)" if k in ("bigint", "string") else "NULL"} AS example FROM orders""" for c, k in _ORDERS.items()))
_add("null_profile", lambda s, d: P.null_profile(_cust(s, d)), f"WITH {CUST} " + " UNION ALL ".join(f"SELECT '{n}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_distinct, round(100 * (count(*) - count({c})) / count(*), 4) AS null_pct FROM c" for n, c in (("c_custkey", "c_custkey"), ("c_name", "c_name"), ("c_mktsegment", "m"), ("c_region", "r"))))
_add("describe_numeric", lambda s, d: P.describe(t(s, d, "orders"), "o_totalprice"), "SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS std, round(min(o_totalprice), 6) AS min, round(max(o_totalprice), 6) AS max, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS q3 FROM orders")
_add("quantiles", lambda s, d: P.quantiles(t(s, d, "lineitem"), "l_extendedprice"), " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS point, round(quantile_cont(l_extendedprice, {p}), 6) AS value FROM lineitem" for p in (0.25, 0.75, 0.9, 0.95, 0.99)))
_add("top_n_with_others", lambda s, d: P.top_n_with_others(t(s, d, "events"), "user_id"), """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value NULLS LAST) <= 10 AS top FROM c)
SELECT CASE WHEN top THEN value ELSE '(others)' END AS value, top, CAST(sum(n) AS BIGINT) AS "count", round(100 * sum(n) / (SELECT sum(n) FROM c), 4) AS pct FROM r GROUP BY 1, 2""")
_add("value_counts_with_null", lambda s, d: P.value_counts(_cust(s, d), "c_mktsegment"), f"WITH {CUST} SELECT m AS value, count(*) AS \"count\", round(count(*) / (SELECT count(*) FROM c), 6) AS ratio FROM c GROUP BY m")
_add("group_mode", lambda s, d: P.group_mode(t(s, d, "lineitem"), "l_suppkey", "l_linenumber"), "SELECT l_suppkey, l_linenumber AS mode, n FROM (SELECT l_suppkey, l_linenumber, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1")
_add("frequency_of_frequencies", lambda s, d: P.frequency_of_frequencies(t(s, d, "lineitem"), "l_orderkey"), "SELECT size, count(*) AS n_keys FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY size")
_add("iqr_outliers", lambda s, d: P.iqr_outliers(_docs(s, d), "n_chars"), "WITH q AS (SELECT quantile_cont(n_chars, 0.75) + 1.5 * (quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25)) AS b FROM documents) SELECT round(b, 6) AS bound, count(*) FILTER (n_chars > b) AS n_outliers, count(*) AS n FROM documents, q GROUP BY b")
_add("agreement_pct", lambda s, d: P.agreement(_docs(s, d).join(t(s, d, "labels"), "doc_id", "left"), "quality", "toxic"), "SELECT round(100 * avg(CASE WHEN quality = toxic THEN 1 ELSE 0 END), 4) AS pct_all, round(100 * avg(CASE WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN CASE WHEN quality = toxic THEN 1 ELSE 0 END END), 4) AS pct_both, count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL) AS n_both FROM documents LEFT JOIN labels USING (doc_id)")
_add("concordance_matrix", lambda s, d: P.concordance(_docs(s, d).join(t(s, d, "labels"), "doc_id"), "lang", ["quality", "toxic"]), "SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS n_quality, count(*) FILTER (toxic = 1) AS n_toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang")
_add("block_completeness", lambda s, d: P.block_completeness(_cust(s, d), {"ID": ["c_custkey", "c_name"], "REST": ["c_mktsegment", "c_region"]}), f"""WITH {CUST} SELECT 'ID' AS block, CAST(100 AS DOUBLE) AS "full", CAST(0 AS DOUBLE) AS partial, CAST(0 AS DOUBLE) AS empty
 UNION ALL SELECT 'REST', round(100 * avg(CASE WHEN m IS NOT NULL AND r IS NOT NULL THEN 1 ELSE 0 END), 4), round(100 * avg(CASE WHEN (m IS NULL) <> (r IS NULL) THEN 1 ELSE 0 END), 4), round(100 * avg(CASE WHEN m IS NULL AND r IS NULL THEN 1 ELSE 0 END), 4) FROM c""")
_add("offending_characters", lambda s, d: P.offending_characters(_docs(s, d), "text", "[^A-Za-z0-9 .,]"), "SELECT character, count(*) AS n_rows FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[^A-Za-z0-9 .,]')) AS character FROM documents) GROUP BY character")
_add("token_length_stats", lambda s, d: P.length_statistics(_docs(s, d), X.token_count(F.col("text"))), r"""WITH n AS (SELECT len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) AS n FROM documents)
SELECT count(*) AS rows, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS max, """ + ", ".join(f"round(100 * avg(CASE WHEN n <= {k} THEN 1 ELSE 0 END), 4) AS pct_le_{k}" for k in (128, 256, 384, 512)) + " FROM n")
_add("length_histogram", lambda s, d: _docs(s, d).groupBy((F.floor(F.col("n_chars") / 500) * 500).alias("bin")).agg(F.count("*").alias("n")), "SELECT n_chars // 500 * 500 AS bin, count(*) AS n FROM documents GROUP BY 1")
_add("exact_duplicates", lambda s, d: P.duplicate_flags(_docs(s, d).withColumn("h", F.md5("text")), ["h"], "doc_id").select("doc_id", "duplicated", "repeated"), "SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS duplicated, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS repeated FROM documents")
_add("key_duplicates_diff", lambda s, d: P.differing_columns(_docs(s, d).withColumn("h", F.md5("text")), "h", ["lang", "source", "n_chars"]), """SELECT count(*) AS n_groups, count(*) FILTER (a > 1) AS n_lang, count(*) FILTER (b > 1) AS n_source, count(*) FILTER (c > 1) AS n_n_chars FROM
 (SELECT count(DISTINCT lang) + max(CASE WHEN lang IS NULL THEN 1 ELSE 0 END) AS a, count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS b, count(DISTINCT n_chars) AS c FROM documents GROUP BY text HAVING count(*) > 1)""")
_add("key_conflicts", lambda s, d: P.key_conflicts(t(s, d, "part"), "p_brand", "p_type"), "SELECT p_brand, count(DISTINCT p_type) AS n_values, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS \"values\" FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
_add("id_gaps", lambda s, d: P.id_gaps(t(s, d, "events").filter("event_id % 7 <> 3 and event_id % 11 <> 5"), "event_id", 1000), "SELECT * FROM (SELECT lag(event_id) OVER (ORDER BY event_id) AS after_id, event_id AS next_id, event_id - lag(event_id) OVER (ORDER BY event_id) - 1 AS n_missing FROM events WHERE event_id % 7 <> 3 AND event_id % 11 <> 5) WHERE n_missing > 0")
_add("sequence_missing", lambda s, d: P.missing_between_ends(t(s, d, "labels"), "doc_id"), "SELECT missing FROM (SELECT unnest(range(min(doc_id), max(doc_id) + 1)) AS missing FROM labels) WHERE missing NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
_add("date_coherence", lambda s, d: t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("days", F.datediff("l_shipdate", "o_orderdate")).agg(
    F.count("*").alias("n"), F.sum((F.col("days") < 0).cast("long")).alias("n_inverted"), F.sum((F.col("days") == 0).cast("long")).alias("n_same_day"), F.sum((~F.year("l_shipdate").between(1993, 2000)).cast("long")).alias("n_out_of_range"), F.round(F.avg("days"), 6).alias("mean_days")),
    "SELECT count(*) AS n, count(*) FILTER (days < 0) AS n_inverted, count(*) FILTER (days = 0) AS n_same_day, count(*) FILTER (y NOT BETWEEN 1993 AND 2000) AS n_out_of_range, round(avg(days), 6) AS mean_days FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days, year(l_shipdate) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
_add("year_overlap", lambda s, d: t(s, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.min("o_orderdate").cast("date").alias("first"), F.max("o_orderdate").cast("date").alias("last"), F.count("*").alias("n")), "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(min(o_orderdate) AS DATE) AS \"first\", CAST(max(o_orderdate) AS DATE) AS \"last\", count(*) AS n FROM orders GROUP BY 1")
_add("span_patterns", lambda s, d: _docs(s, d).select("doc_id", X.token_count(F.col("text")).cast("long").alias("n_tokens"), F.col("text").rlike("  +").alias("multi_space"), F.col("text").rlike(r"[A-Z]\d{2}(\.\d{1,2})?").alias("code"), F.col("source").rlike(r"^[a-z]{3}\d+$").alias("numbered")),
     r"SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) AS n_tokens, regexp_matches(text, '  +') AS multi_space, regexp_matches(text, '[A-Z]\d{2}(\.\d{1,2})?') AS code, regexp_matches(source, '^[a-z]{3}\d+$') AS numbered FROM documents")
_add("visible_spaces", lambda s, d: t(s, d, "part").select("p_partkey", X.visible_spaces(F.concat("p_name", F.lit("   "), "p_type")).alias("seen")), "SELECT p_partkey, replace(p_name, ' ', '␣') || '--' || replace(p_type, ' ', '␣') AS seen FROM part")
_META = lambda s, d: P.schema_rows(t(s, d, "orders")).unionByName(P.schema_rows(t(s, d, "events")))
_add("cleaning_plan", lambda s, d: P.cleaning_plan(_META(s, d)), """SELECT * FROM (VALUES ('o_orderkey', 'bigint', 'none'), ('o_custkey', 'bigint', 'none'), ('o_orderstatus', 'string', 'trim spaces'), ('o_totalprice', 'double', 'none'), ('o_orderdate', 'timestamp_ntz', 'none'), ('o_orderpriority', 'string', 'trim spaces'),
 ('event_id', 'bigint', 'none'), ('ts', 'timestamp_ntz', 'none'), ('user_id', 'bigint', 'none'), ('event_type', 'string', 'trim spaces'), ('value', 'double', 'none'), ('props', 'string', 'trim spaces')) t("column", dtype, action)""")
_add("imputation_plan", lambda s, d: P.imputation_plan(P.null_profile(_cust(s, d)).select("column", "null_pct")), f"""WITH {CUST}, p AS (SELECT 'c_custkey' AS n, 0.0 AS x UNION ALL SELECT 'c_name', 0.0 UNION ALL SELECT 'c_mktsegment', round(100 * (count(*) - count(m)) / count(*), 4) FROM c UNION ALL SELECT 'c_region', round(100 * (count(*) - count(r)) / count(*), 4) FROM c)
SELECT n AS "column", CAST(x AS DOUBLE) AS null_pct, CASE WHEN n = 'c_custkey' THEN 'critical' WHEN x > 80 THEN 'drop' WHEN x < 5 THEN 'simple' ELSE 'advanced' END AS plan FROM p""")
_add("target_dictionary", lambda s, d: P.target_dictionary(P.schema_rows(t(s, d, "orders")), [("key$", "ID"), ("date", "TIME"), ("price", "MONEY")]), """SELECT * FROM (VALUES ('o_orderkey', 'ID', 'o_orderkey', 'numeric', 'o_orderkey -> o_orderkey'), ('o_custkey', 'ID', 'o_custkey', 'numeric', 'o_custkey -> o_custkey'), ('o_orderstatus', 'other', 'o_orderstatus', 'categorical', 'o_orderstatus -> o_orderstatus'),
 ('o_totalprice', 'MONEY', 'o_totalprice', 'numeric', 'o_totalprice -> o_totalprice'), ('o_orderdate', 'TIME', 'o_orderdate', 'temporal', 'o_orderdate -> o_orderdate'), ('o_orderpriority', 'other', 'o_orderpriority', 'categorical', 'o_orderpriority -> o_orderpriority')) t("column", block, target, kind, lineage)""")
_add("snake_case", lambda s, d: _docs(s, d).select("doc_id", X.snake_case(F.col("text")).alias("name")), "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]', '_', 'g'), '_+', '_', 'g'), '_') AS name FROM documents")
_nations = lambda s, d, n, c: t(s, d, n).select(F.col(c).alias("nation"))
_add("union_by_name", lambda s, d: t(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind")).unionByName(t(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("kind")), allowMissingColumns=True), "SELECT s_name AS name, s_nationkey AS nation, 'supplier' AS kind, NULL AS segment FROM supplier UNION ALL SELECT c_name, NULL, 'customer', c_mktsegment FROM customer")
_add("set_intersection", lambda s, d: _nations(s, d, "supplier", "s_nationkey").intersect(_nations(s, d, "customer", "c_nationkey")), "SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer")
_add("set_difference", lambda s, d: t(s, d, "customer").select(F.col("c_custkey").alias("key")).exceptAll(t(s, d, "orders").select(F.col("o_custkey").alias("key")).distinct()), "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
_add("set_union_size", lambda s, d: _nations(s, d, "supplier", "s_nationkey").union(_nations(s, d, "customer", "c_nationkey")).distinct().agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer)")
_add("running_offsets", lambda s, d: P.running_offsets(_docs(s, d), "source"), "SELECT source, n, CAST(sum(n) OVER (ORDER BY source) - n AS BIGINT) AS \"offset\" FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
