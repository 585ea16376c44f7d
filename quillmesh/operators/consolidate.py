"""Entity documents: nested items and scores, one object an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.linkage import natural_pairs
from quillmesh.operators.registry import Registry


def _by_record(a, b):
    return F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)


def entity_documents(tagged: DataFrame, registry: Registry, decimals: int = 4) -> DataFrame:
    """(entity_id, cluster_size, items, scores): items in record order, scores of cross-source item pairs.

    tagged has entity_id, record_id, source, key, exp and any other columns, which go to the item's record map.
    Pair scores are joined and regrouped, so no task loops over an entity's pairs.
    """
    base = ["entity_id", "record_id", "source", "key", "exp"]
    others = [c for c in tagged.columns if c not in base]
    record = F.map_filter(F.create_map(*[x for c in others for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull()) if others else F.create_map().cast("map<string,string>")
    item = F.struct(F.col("record_id"), F.col("source"), F.col("key"), F.col("exp"), record.alias("record"))
    items = tagged.groupBy("entity_id").agg(F.count("*").alias("cluster_size"), F.array_sort(F.collect_list(item), _by_record).alias("items"))
    pairs = natural_pairs(tagged).join(tagged.select(*[F.col(c).alias(f"a_{c}") for c in base[1:]]), F.col("id_a") == F.col("a_record_id"))
    pairs = pairs.join(tagged.select(*[F.col(c).alias(f"b_{c}") for c in base[1:]]), F.col("id_b") == F.col("b_record_id"))
    scored = F.explode(F.filter(F.array(*registry.scores("a_", "b_", decimals)), lambda s: s["value"].isNotNull()))
    scores = pairs.select("entity_id", "id_a", "id_b", scored.alias("s"))
    scores = scores.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("id_a", "id_b", F.col("s.place").alias("place"), F.col("s.method").alias("method"), F.col("s.value").alias("value")))).alias("scores"))
    return items.join(scores, "entity_id", "left").withColumn("scores", F.coalesce("scores", F.array().cast("array<struct<id_a:bigint,id_b:bigint,place:int,method:string,value:double>>")))


def legacy_documents(tagged: DataFrame, index: DataFrame, decimals: int = 4) -> DataFrame:
    """(entity_id, cluster_size, linked_items, records, scores): the older form, with parallel arrays in record order.

    Scores are looked up in a pair index (id_a, id_b, jw, lev), for every two records of an entity that it has, and
    name them by their places.
    """
    base = ["entity_id", "record_id", "source", "key", "exp"]
    others = [c for c in tagged.columns if c not in base]
    record = F.map_filter(F.create_map(*[x for c in others for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull()) if others else F.create_map().cast("map<string,string>")
    item = F.struct(F.col("record_id"), F.col("source"), F.col("key"), F.col("exp"), record.alias("record"))
    rows = tagged.groupBy("entity_id").agg(F.count("*").alias("cluster_size"), F.array_sort(F.collect_list(item), _by_record).alias("rows"))
    own = tagged.select("entity_id", "record_id")
    found = index.join(own.toDF("ea", "id_a"), "id_a").join(own.toDF("eb", "id_b"), "id_b").filter("ea = eb")
    scores = found.groupBy(F.col("ea").alias("entity_id")).agg(F.sort_array(F.collect_list(F.struct("id_a", "id_b", "jw", "lev"))).alias("pairs"))
    both = rows.join(scores, "entity_id", "left")
    place = lambda c: (F.array_position(F.transform("rows", lambda r: r["record_id"]), c) - 1).cast("int")
    one = lambda p, name, c: F.struct(F.lit(name).alias("method"), F.array(place(p["id_a"]), place(p["id_b"])).alias("items"), F.round(p[c], decimals).alias("value"))
    listed = F.flatten(F.transform("pairs", lambda p: F.array(one(p, "jaro_winkler", "jw"), one(p, "levenshtein", "lev"))))
    return both.select(
        "entity_id", "cluster_size", F.transform("rows", lambda r: F.struct(r["source"].alias("source"), F.struct(r["key"].alias("key"), r["exp"].alias("exp")).alias("linking_values"))).alias("linked_items"),
        F.transform("rows", lambda r: r["record"]).alias("records"), F.coalesce(listed, F.array().cast("array<struct<method:string,items:array<int>,value:double>>")).alias("scores"),
    )


def document_statistics(documents: DataFrame) -> DataFrame:
    """One row of totals over the entity documents."""
    one = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    return documents.agg(
        F.count("*").alias("n_entities"), one(F.col("cluster_size") == 1).alias("n_singletons"), one(F.col("cluster_size") == 2).alias("n_pairs"), one(F.col("cluster_size") >= 3).alias("n_larger"),
        F.coalesce(F.max("cluster_size"), F.lit(0)).alias("max_size"), F.coalesce(F.sum(F.size("scores").cast("long")), F.lit(0)).alias("n_scores"), one(F.size("scores") == 0).alias("n_without_scores"),
    )


def as_json(documents: DataFrame) -> DataFrame:
    """One JSON text an entity, with its nulls."""
    return documents.select("entity_id", F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"}).alias("document"))
