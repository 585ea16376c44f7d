"""A corpus from documents to token files, in five stages; each one works on what its predecessor kept.

Rows are named by doc_id and a hash of the text: rows that share a doc_id but not the text are judged apart. Rows with a
null doc_id pass the near-duplicate stage. Empty tables pass every stage; extra columns of any name are carried. Each stage is written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.names import spare
from quillmesh.llm.classifier import score_documents
from quillmesh.llm.decontaminate import decontaminate
from quillmesh.llm.mixture import Mixture
from quillmesh.llm.ngram_join import NgramJoin
from quillmesh.llm.token_output import default_tokenizer, token_output
from quillmesh.storage import Stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_documents(docs, labels).filter("predicted = 1").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least doc_id, then of least hash of the text, of each component of the n-gram Jaccard join; of repeated rows, one."""
    key = spare("text_key", docs.columns)
    own = NgramJoin(docs).survivors().select("doc_id", F.col("key").alias(key))
    kept = docs.withColumn(key, F.xxhash64("text")).join(own, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark, keep_text=True).filter("not contaminated").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole documents.

    A part of a document becomes a whole one or none, by a hash of its id and text that falls below the part or not, so
    that a source's words stay near its target, up or down by the root of its number of documents.
    """
    taken = Mixture(docs).documents.filter("taken > 0")
    taken = taken.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.avg(F.col("taken") / F.col("size")).alias("part"))
    chance = F.pmod(F.xxhash64(F.col("id").cast("string"), "key", F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = taken.select("id", "key", F.floor(F.col("part") + chance).cast("int").alias("times")).filter("times > 0")
    id_, key, n = (spare(c, docs.columns) for c in ("mix_id", "mix_key", "mix_times"))
    times = times.toDF(id_, key, n)
    repeated = docs.join(times, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)))
    return repeated.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Start, length and checksum of each document's ids, read back from the token files."""
    # workers of all stages share an executor, so they keep few words
    return token_output(docs, default_tokenizer(), kept_words=100_000)


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixture", mix_sources),
    ("token_output", write_tokens),
]

#: No SQL: the classifier's score and the tokenizer can't be written in it; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    stage = Stage(spark, "corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage.put(docs, name)
            if k:
                stage.drop(STAGES[k - 1][0])
    return docs
