"""Pluggable encoders and pair scorers, in Arrow batches, and the batch loss that trains encoders."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions.similarity import dot
from quillmesh.session import ship_package

WIDTH = 64


def hashed_encoder(texts: list[str], width: int = WIDTH) -> np.ndarray:
    """A deterministic stand-in for a trained encoder: signed counts of hashed letter 3-grams, of unit length."""
    out = np.zeros((len(texts), width), np.float32)
    for row, text in zip(out, texts, strict=True):
        padded = f"  {text} ".lower()
        for i in range(len(padded) - 2):
            h = zlib.crc32(padded[i : i + 3].encode())
            row[h % width] += 1 if h & 0x40000000 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def encode(df: DataFrame, column: str, encoder: Callable[[list[str]], np.ndarray] = hashed_encoder, name: str = "embedding", batch: int = 64) -> DataFrame:
    """df with the unit vectors of a text column; a null text is encoded as ''."""
    ship_package(df.sparkSession)
    df = df.drop(name)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part[column].fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in encoder(texts[i : i + batch])]
            yield part.assign(**{name: vectors})

    return df.mapInPandas(run, schema)


def score_pairs(pairs: DataFrame, a: str, b: str, scorer: Callable[[list[str], list[str]], np.ndarray], name: str = "score", batch: int = 64) -> DataFrame:
    """pairs with a scorer's output for two text columns."""
    ship_package(pairs.sparkSession)
    pairs = pairs.drop(name)
    schema = T.StructType([*pairs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x, y = part[a].fillna("").tolist(), part[b].fillna("").tolist()
            yield part.assign(**{name: [float(s) for i in range(0, len(x), batch) for s in scorer(x[i : i + batch], y[i : i + batch])]})

    return pairs.mapInPandas(run, schema)


def batch_ranking_loss(pairs: DataFrame, temperature: float = 0.07) -> DataFrame:
    """pairs (batch, row, a, b): mean cross-entropy of each a's own b among the b of its batch.

    Batches have a fixed size, so the join inside a batch grows with the number of batches only.
    """
    left = pairs.select("batch", F.col("row").alias("ra"), "a")
    right = pairs.select("batch", F.col("row").alias("rb"), "b")
    z = left.join(right, "batch").select("batch", "ra", "rb", (dot(F.col("a"), F.col("b")) / temperature).alias("z"))
    top = z.groupBy("batch", "ra").agg(F.max("z").alias("m"), F.max(F.when(F.col("ra") == F.col("rb"), F.col("z"))).alias("own"))
    total = z.join(top, ["batch", "ra"]).groupBy("batch", "ra", "m", "own").agg(F.sum(F.exp(F.col("z") - F.col("m"))).alias("s"))
    return total.agg(F.round(F.avg(F.col("m") + F.log("s") - F.col("own")), 6).alias("loss"), F.count("*").alias("n"))
