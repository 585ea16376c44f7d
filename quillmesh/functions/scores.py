"""Probabilities, uncertainty and distances to a threshold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(z: Column, temperature: float = 1.0) -> Column:
    """1 / (1 + exp(-z / T)) without overflow at either end."""
    z = z / F.lit(float(temperature))
    small = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def bernoulli_entropy(p: Column, bits: bool = True) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    log = F.log2 if bits else F.log
    return -(p * log(p) + (1 - p) * log(1 - p))


def margin(p: Column, threshold: float = 0.12) -> Column:
    return F.abs(p - F.lit(float(threshold)))


def pairs_of(n: Column) -> Column:
    """Unordered pairs among n."""
    return (n * (n - 1) / 2).cast("long")


def softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def weighted_bce(z: Column, y: Column, positive_weight: float) -> Column:
    """Binary cross-entropy of logits with a weight on positives."""
    return positive_weight * y * softplus(-z) + (1 - y) * softplus(z)
