"""Evaluation of pair scores: binary metrics, curves, threshold sweep, calibration and uncertainty."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.scores import bernoulli_entropy, margin, sigmoid, softplus
from quillmesh.operators.numbering import running

BINS = 10


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(scored: DataFrame, threshold: Column) -> list[Column]:
    hit, y = F.col("score") >= threshold, F.col("label") == 1
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return [one(hit & y).alias("tp"), one(hit & ~y).alias("fp"), one(~hit & y).alias("fn"), one(~hit & ~y).alias("tn")]


def _ratios(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = _safe(tp, tp + fp), _safe(tp, tp + fn)
    return df.withColumns({
        "precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(_safe(2 * tp, 2 * tp + fp + fn), 6), "accuracy": F.round(_safe(tp + tn, tp + fp + fn + tn), 6)
    })


def binary_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """scored (score, label): counts and ratios at a threshold, a zero denominator giving 0."""
    return _ratios(scored.agg(*confusion(scored, F.lit(threshold)), F.count("*").alias("n")))


def threshold_sweep(scored: DataFrame, steps: int = 51) -> DataFrame:
    """Ratios at each of the thresholds from 0 to 1; scores are counted between thresholds first, then summed.

    The rows are dealt once into steps + 1 counts, so the sweep does not multiply the table.
    """
    edges = F.array(*[F.lit(k / (steps - 1)) for k in range(steps)])
    passed = F.size(F.filter(edges, lambda e: F.col("score") >= e))
    counts = scored.groupBy(passed.alias("passed")).agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.count("*").alias("all"))
    grid = scored.sparkSession.range(steps).select(F.col("id").cast("int").alias("step"), (F.col("id") / F.lit(float(steps - 1))).alias("threshold"))
    hit = F.col("passed") > F.col("step")
    one = lambda c: F.coalesce(F.sum(F.when(hit, c)), F.lit(0))
    off = lambda c: F.coalesce(F.sum(F.when(~hit, c)), F.lit(0))
    neg = F.col("all") - F.col("pos")
    return _ratios(grid.crossJoin(counts).groupBy("step", "threshold").agg(one(F.col("pos")).alias("tp"), one(neg).alias("fp"), off(F.col("pos")).alias("fn"), off(neg).alias("tn")))


def best_threshold(scored: DataFrame, steps: int = 51) -> DataFrame:
    """The lowest threshold of the best F1."""
    return threshold_sweep(scored, steps).orderBy(F.desc("f1"), "threshold").limit(1).select(F.round("threshold", 6).alias("threshold"), "f1")


def _by_score(scored: DataFrame) -> DataFrame:
    """Positives and rows at each distinct score, and cumulated over descending scores."""
    at = scored.groupBy("score").agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.count("*").alias("n"))
    return running(at, [F.desc("score")], {"cum_pos": F.col("pos"), "cum_n": F.col("n")})


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum over distinct scores of the gain in recall times the precision."""
    cum = _by_score(scored)
    return cum.agg(F.round(F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")) / F.when(F.sum("pos") > 0, F.sum("pos")), 6).alias("average_precision"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area by average ranks; null if one class is absent."""
    cum = _by_score(scored)
    won = F.sum((F.col("n") - F.col("pos")) * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2))
    pos, neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return cum.agg(F.round(F.when((pos > 0) & (neg > 0), won / (pos * neg)), 6).alias("roc_auc"))


def score_statistics(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std"))


def bin_of(confidence: Column, bins: int = BINS) -> Column:
    """Bins (lo, hi] of equal width on [0, 1], the first closed below; edges as a linear spacing gives them."""
    return F.greatest(F.lit(0), F.size(F.filter(F.array(*[F.lit(k * (1.0 / bins)) for k in range(bins)]), lambda e: confidence > e)) - 1)


def reliability(scored: DataFrame, bins: int = BINS) -> DataFrame:
    """Per non-empty bin of confidence max(p, 1 - p): rows, accuracy and mean confidence."""
    conf = F.greatest("score", 1 - F.col("score"))
    right = ((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double")
    binned = scored.select(conf.alias("c"), right.alias("r")).withColumn("bin", bin_of(F.col("c"), bins))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("accuracy"), F.round(F.avg("c"), 6).alias("confidence"))


def calibration_error(scored: DataFrame, bins: int = BINS) -> DataFrame:
    conf = F.greatest("score", 1 - F.col("score"))
    right = ((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double")
    binned = scored.select(conf.alias("c"), right.alias("r")).groupBy(bin_of(F.col("c"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("r").alias("a"), F.avg("c").alias("c"))
    return binned.agg(F.round(F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n"), 6).alias("ece"))


def uncertainty(pairs: DataFrame, temperature: float = 1.0, threshold: float = 0.12) -> DataFrame:
    """pairs (..., logit) with calibrated probability, entropy in bits and distance to the threshold."""
    p = sigmoid(F.col("logit"), temperature)
    return pairs.withColumns({"prob": F.round(p, 6), "entropy": F.round(bernoulli_entropy(p), 6), "margin": F.round(margin(p, threshold), 6)})


def negative_log_likelihood(pairs: DataFrame, temperatures: list[float]) -> list[float]:
    """Mean loss at several temperatures in one pass."""
    y = (F.col("label") == 1).cast("double")
    losses = [F.avg(y * softplus(-F.col("logit") / t) + (1 - y) * softplus(F.col("logit") / t)) for t in temperatures]
    return list(pairs.agg(*losses).first())


def fit_temperature(pairs: DataFrame, low: float = 0.05, high: float = 10.0, tolerance: float = 1e-4, points: int = 17) -> float:
    """The temperature of least loss: a grid a pass, narrowed around its best point; 1 without rows."""
    lo, hi = math.log(low), math.log(high)
    while hi - lo > tolerance:
        grid = [lo + (hi - lo) * k / (points - 1) for k in range(points)]
        loss = negative_log_likelihood(pairs, [math.exp(g) for g in grid])
        if loss[0] is None:
            return 1.0
        best = min(range(points), key=loss.__getitem__)
        lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)]
    return math.exp((lo + hi) / 2)
