"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

A text's features are its words and the character (code point) 3- and 4-grams inside words and at their ends, hashed
to 2^18 buckets, and two signs with buckets of their own, one for each word that repeats the word before and one for
each 3-word run met before: n-grams alone can't tell a text that repeats itself. Each bucket has a learned vector; a
document is the mean of its features' vectors; a linear layer with softmax gives the classes. Vectors and layer are
trained together by numpy stochastic gradient descent on the driver, on labelled documents taken in the order of a
hash of doc_id, max_rows and max_bytes of text at most (both are parameters; executors turn texts to bucket counts, so
what the driver holds is bounded by some 20 bytes for each byte of text).

Scoring: the difference of the two outputs is linear in the mean vector, so each bucket's vector is folded
into one number beforehand and a document's logit is a mean of looked-up numbers: 1 MB is broadcast.

Cases: null and empty texts have no features and get the score of the bias; rows without a label, with a
null label or with contradicting labels don't train; without any usable row all scores are 0.5; repeated
rows are scored each; a null doc_id is scored and is not held out; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillmesh.llm.tokens import gram_hashes, grams_inside, mix, text_groups, word_bounds, word_hashes
from quillmesh.session import ship_package

BUCKET_BITS = 18
WIDTH = 16
MAX_ROWS = 6000
MAX_BYTES = 1 << 25
SAME, SEEN = 1 << BUCKET_BITS, (1 << BUCKET_BITS) + 1
BUCKETS = (1 << BUCKET_BITS) + 2
#: ASCII white space by code point.
BLANKS = np.array([9, 10, 11, 12, 13, 32], np.uint32)
FOLDS = 5


def features(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, features before each text's end) for words, 3-grams and 4-grams of a group."""
    starts, ends, counts = word_bounds(data, bounds)
    shift = np.uint64(64 - BUCKET_BITS)
    words, last = word_hashes(data, starts, ends), np.concatenate([[0], np.cumsum(counts)])
    yield (words >> shift).astype(np.int32), last
    yield from _again(words, counts, last)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    ends_at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    solid = ~np.isin(points, BLANKS) if len(points) else np.zeros(0, bool)
    signs = mix(np.where(solid, points, 32).astype(np.uint64) + np.uint64(1))
    cut = np.zeros(len(points) + 1, bool)
    cut[ends_at] = True
    for n, odd in ((3, 0x9E3779B97F4A7C15), (4, 0xC2B2AE3D27D4EB4F)):
        m = len(points) - n + 1
        if m <= 0:
            yield np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
            continue
        key, ok = np.zeros(m, np.uint64), np.ones(m, bool)
        for k in range(n):
            key = key * np.uint64(odd) + signs[k : k + m]
            if 0 < k < n - 1:
                ok &= solid[k : k + m]
            if k:
                ok &= ~cut[k : k + m]
        at = np.flatnonzero(ok)
        yield (key[at] >> shift).astype(np.int32), np.searchsorted(at, ends_at)


def _again(words: np.ndarray, counts: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One bucket for words equal to the word before, one for 3-word runs that the text had before."""
    same = np.concatenate([[False], words[1:] == words[:-1]]) if len(words) else np.zeros(0, bool)
    same[last[:-1][counts > 0]] = False
    cuts = np.concatenate([[0], np.cumsum(same)])[last]
    yield np.full(cuts[-1], SAME, np.int32), cuts
    index, text, _ = grams_inside(counts, 3)
    runs = gram_hashes(words, 3)[index]
    at = np.searchsorted(text, np.arange(len(counts) + 1))
    extra = [at[i + 1] - at[i] - len(np.unique(runs[at[i] : at[i + 1]])) for i in range(len(counts))]
    cuts = np.concatenate([[0], np.cumsum(extra)]).astype(np.int64)
    yield np.full(cuts[-1], SEEN, np.int32), cuts


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, buckets, counts) of labelled texts."""
    for rows, data, bounds in text_groups(batches):
        kinds = list(features(data, bounds))
        ids, ns = [], []
        for i in range(rows.num_rows):
            own, n = np.unique(np.concatenate([f[c[i] : c[i + 1]] for f, c in kinds]), return_counts=True)
            ids.append(own.tobytes()), ns.append(n.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(ids, pa.binary()), pa.array(ns, pa.binary())], names=["doc_id", "label", "ids", "ns"])


class Model:
    """Vectors of the buckets, the output layer, and its bias."""

    def __init__(self, classes: int = 2, width: int = WIDTH, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.vectors = ((rng.random((BUCKETS, width), np.float32) - 0.5) / width).astype(np.float32)
        self.output, self.bias = np.zeros((width, classes), np.float32), np.zeros(classes, np.float32)

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.5, seed: int = 2) -> Model:
        """rows: (label, buckets, counts). One step a row, with a rate that falls linearly to 0."""
        rng, total, step = np.random.default_rng(seed), max(1, epochs * len(rows)), 0
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                label, ids, ns = rows[k]
                lr = rate * (1 - step / total)
                step += 1
                share = ns / max(ns.sum(), 1)
                own = self.vectors[ids]
                mean = share @ own
                z = mean @ self.output + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[label] -= 1
                back = self.output @ p
                self.output -= lr * np.outer(mean, p)
                self.bias -= lr * 0.1 * p
                # a step in the mean moves each vector by its share; counts make up for long texts
                self.vectors[ids] = own - lr * share[:, None] * len(ids) * back / max(len(ids) ** 0.5, 1)
        return self

    def folded(self) -> tuple[np.ndarray, float]:
        """Each bucket's part in the logit of class 1, and the bias."""
        return self.vectors @ (self.output[:, 1] - self.output[:, 0]), float(self.bias[1] - self.bias[0])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, label: str = "quality") -> Model | None:
    """A model of the labelled documents; labels: (doc_id, the label column of 0 and 1)."""
    ship_package(docs.sparkSession)
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("top"))
    chosen = known.filter("label = top").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", "label")
    # at most max_rows rows from here
    chosen = F.broadcast(chosen)
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.max("size").alias("size"))
    upto = F.sum(F.coalesce("size", F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    within = sizes.withColumn("upto", upto).filter(F.col("upto") <= max_bytes).select("doc_id", "label")
    texts = docs.select("doc_id", "text").join(F.broadcast(within), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").cast("int").alias("label"))
    got = texts.mapInArrow(_count_rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, ids binary, ns binary")
    rows = sorted(got.toLocalIterator(), key=lambda r: r.doc_id)
    if not rows:
        return None
    return Model().fit([(r.label, np.frombuffer(r.ids, np.int32), np.frombuffer(r.ns, np.float32)) for r in rows])


def score(docs: DataFrame, model: Model | None, column: str = "score", keep_text: bool = True) -> DataFrame:
    """docs, with text or without, with the probability of class 1."""
    ship_package(docs.sparkSession)
    docs = docs.drop(column)
    folded = docs.sparkSession.sparkContext.broadcast(model.folded() if model else (np.zeros(BUCKETS, np.float32), 0.0))
    kept = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    schema = T.StructType([*kept, T.StructField(column, T.DoubleType())])
    target = to_arrow_schema(schema)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = folded.value
        for rows, data, bounds in text_groups(batches):
            total, n = np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int64)
            for ids, cuts in features(data, bounds):
                sums = np.concatenate([[0.0], np.cumsum(weight[ids], dtype=np.float64)])
                total += sums[cuts[1:]] - sums[cuts[:-1]]
                n += np.diff(cuts)
            p = 1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias)))
            yield pa.RecordBatch.from_arrays([*[rows.column(f.name).cast(target.field(f.name).type) for f in kept], pa.array(p)], schema=target)

    return docs.mapInArrow(scored, schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, keep_text: bool = True) -> DataFrame:
    """docs with score, held_out and predicted; held-out rows don't train."""
    model = train(docs, labels.filter(~held_out()))
    scored = score(docs, model, keep_text=keep_text)
    return scored.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_query(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_documents(docs, labels, keep_text=False).select("doc_id", "held_out", "score", "predicted")
