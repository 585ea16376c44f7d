"""Labelling in two steps around a person: classify() writes records and a review sheet, finalize() reads it and numbers entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.scores import pairs_of
from quillmesh.operators import linkage as L
from quillmesh.sources.sheets import file_exists, read_sheet, write_sheet
from quillmesh.sources.tables import require_columns

SOURCES = 3
BASE = ("source", "exp", "name", "key", "text", "place")


class Labelling:
    """The stage tables and the sheet of one folder that all machines share.

    Tables are (source, exp, name, key, text, place), place a row's number in its file; there are exactly three, in an
    order that stays, as records are numbered in it. The first source's records without a file number are paired by name.
    """

    def __init__(self, spark: SparkSession, folder: str, canonical: bool = False):
        self.spark, self.folder, self.canonical = spark, folder.rstrip("/"), canonical
        self.records_path, self.sheet_path, self.dataset_path = (f"{self.folder}/{x}" for x in ("records.parquet", "pairs_for_review.xlsx", "dataset.parquet"))

    def _records(self, tables: list[DataFrame]) -> DataFrame:
        if len(tables) != SOURCES:
            raise ValueError(f"{len(tables)} tables where {SOURCES} are expected")
        every = None
        for k, table in enumerate(tables):
            require_columns(table, BASE)
            own = table.select(F.lit(k).alias("file"), *BASE)
            every = own if every is None else every.unionByName(own)
        return L.number_records(every, ["file", "place"]).drop("file", "place")

    def classify(self, tables: list[DataFrame]) -> DataFrame:
        """Classified pairs; writes the records, and the review sheet with blank decisions. A canonical folder is not classified again."""
        if self.canonical:
            raise PermissionError("a canonical folder keeps its review sheet; use finalize()")
        records = self._records(tables)
        records.write.mode("overwrite").parquet(self.records_path)
        records = self.spark.read.parquet(self.records_path)
        first = tables[0].select("source").first()
        pairs = L.classify(L.scored_pairs(L.candidate_pairs(records, first.source if first else "")))
        sheet = pairs.select("id_a", "id_b", "source_a", "source_b", "exp_shared", "key_a", "key_b", F.round("jw", 3).alias("jw"), F.round("lev", 3).alias("lev"), "criterion", F.lit(None).cast("string").alias("decision"))
        write_sheet(sheet, self.sheet_path)
        return pairs

    def decide(self, decisions: DataFrame) -> None:
        """Writes earlier decisions (id_a, id_b, decision) into the sheet."""
        write_sheet(L.merge_decisions(read_sheet(self.spark, self.sheet_path), decisions), self.sheet_path)

    def finalize(self, tables: list[DataFrame] | None = None) -> DataFrame:
        """(record_id, source, text, entity_id), written; the sheet gets its settled states and entity ids.

        With tables, texts come from them anew; they must give as many records as were classified.
        """
        for path in (self.records_path, self.sheet_path):
            if not file_exists(self.spark, path):
                raise FileNotFoundError(f"{path}: classify first")
        records = self.spark.read.parquet(self.records_path)
        if tables is not None:
            anew = self._records(tables)
            if (got := anew.count()) != (had := records.count()):
                raise ValueError(f"the tables give {got} records, {had} were classified")
            records = records.drop("text").join(anew.select("record_id", "text"), "record_id")
        sheet = read_sheet(self.spark, self.sheet_path).drop("entity_id", "entity_id_a", "entity_id_b")
        positive = sheet.filter(L.is_positive(F.col("criterion"), F.col("decision"))).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
        found = L.entities(records, positive.unionByName(L.star_edges(records)))
        dataset = records.join(found, "record_id").select("record_id", "source", "text", "entity_id")
        dataset.write.mode("overwrite").parquet(self.dataset_path)
        dataset = self.spark.read.parquet(self.dataset_path)
        ids = dataset.select("record_id", "entity_id")
        settled = L.settle(sheet).join(ids.toDF("id_a", "entity_id_a"), "id_a", "left").join(ids.toDF("id_b", "entity_id_b"), "id_b", "left")
        write_sheet(settled.select(*sheet.columns, "entity_id_a", "entity_id_b"), self.sheet_path)
        return dataset


def labelled_by_key(records: DataFrame) -> DataFrame:
    """The older way without review: records that share file number and key are one entity."""
    return L.first_seen_ids(records, ["exp", "key"])


def key_label_statistics(tagged: DataFrame) -> DataFrame:
    """One row over labelled_by_key(): records, entities, pairs inside entities, pairs of sources confirmed, and residual ones."""
    sizes = tagged.groupBy("entity_id").agg(F.count("*").alias("n"), F.countDistinct("source").alias("s"))
    got = sizes.agg(F.sum("n").alias("n_records"), F.count("*").alias("n_entities"), F.sum(pairs_of(F.col("n"))).alias("n_pairs"), F.sum(pairs_of(F.col("s"))).alias("n_confirmed"))
    return got.crossJoin(L.residual_entity_pairs(tagged))  # one row each


def linkage_report(records: DataFrame, reviewed: DataFrame, tagged: DataFrame) -> DataFrame:
    """(section, name, value): pair space by sources, its totals, outcomes, regions, and the synthesis of pairs and entities."""
    space = L.pair_space(records)
    cross = F.concat_ws("+", "source_a", "source_b")
    long = lambda df, section, name, cols: df.select(F.lit(section).alias("section"), F.explode(F.array(*[F.struct(F.concat_ws(".", name, F.lit(c)).alias("name"), F.col(c).cast("long").alias("value")) for c in cols])).alias("x")).select("section", "x.name", "x.value")
    outcome = L.cascade_by_cross(reviewed)
    sizes = tagged.groupBy("entity_id").agg(F.count("*").alias("n"), F.countDistinct("source").alias("s"))
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    entities = sizes.agg(
        F.count("*").alias("n_entities"), one(F.col("s") == 2).alias("in_two"), one(F.col("s") >= 3).alias("in_three"), one(F.col("n") == 1).alias("singletons"),
        one(F.col("n") == 2).alias("pairs"), one(F.col("n") == 3).alias("triads"), one(F.col("n") > 3).alias("larger"),
    )
    parts = [
        long(space, "space", cross, ["space", "shared_keys"]), long(L.space_totals(records, space), "totals", F.lit("all"), ["n_records", "n_pairs", "n_cross_pairs", "n_shared_keys"]),
        long(outcome, "outcomes", cross, ["n_exact", "n_metric", "n_review_match", "n_review_no_match", "n_candidates", "n_positive"]),
        L.source_regions(tagged).select(F.lit("regions").alias("section"), F.col("region").alias("name"), F.col("n_entities").alias("value")),
        long(entities, "entities", F.lit("all"), ["n_entities", "in_two", "in_three", "singletons", "pairs", "triads", "larger"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_json(report: DataFrame) -> DataFrame:
    """The report as one JSON object by section; its rows are as few as sources and sections."""
    entry = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value"))))
    sections = report.groupBy("section").agg(entry.alias("m"))
    by_name = lambda a, b: F.when(a["section"] < b["section"], -1).otherwise(1)
    return sections.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "m")), by_name))).alias("json"))
