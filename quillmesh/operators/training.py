"""What surrounds training, as tables: running losses, early stopping, checkpoint names; and a file's place in a layout."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.operators.numbering import running


def running_mean(steps: DataFrame, value: str, order: list[str]) -> DataFrame:
    """steps with running_mean: the mean of a value up to and with each step."""
    own = [F.col(c) for c in order]
    got = running(steps, own, {"total_so_far": F.col(value).cast("double"), "steps_so_far": F.lit(1).cast("long")})
    return got.withColumn("running_mean", F.round(F.col("total_so_far") / F.col("steps_so_far"), 6)).drop("total_so_far", "steps_so_far")


def early_stop(history: DataFrame, patience: int, run: str = "run", epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """(run, best_epoch, best_loss, stop_epoch): a run stops `patience` epochs after its last better loss; null where it doesn't.

    history has a row an epoch, as few as a run has epochs.
    """
    up = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    marked = history.withColumn("better", F.coalesce(F.col(loss) < F.min(loss).over(up), F.lit(True)))
    last = F.max(F.when(F.col("better"), F.col(epoch))).over(Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("since", F.col(epoch) - last)
    stop = marked.groupBy(run).agg(F.min(F.when(F.col("since") >= patience, F.col(epoch))).alias("stop_epoch"))
    until = marked.join(stop, run).filter(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
    return until.groupBy(run, "stop_epoch").agg(F.min(F.struct(loss, epoch)).alias("b")).select(run, F.col(f"b.{epoch}").alias("best_epoch"), F.col(f"b.{loss}").alias("best_loss"), "stop_epoch")


def learning_rate(step: Column, warm: int, total: int, peak: float) -> Column:
    """Linear warm-up to the peak, then linear decay to 0."""
    return F.when(step < warm, peak * step / max(warm, 1)).otherwise(peak * F.greatest(F.lit(0.0), (total - step) / F.lit(float(max(total - warm, 1)))))


def _names(spark: SparkSession, folder: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def checkpoint_name(epoch: int) -> str:
    return f"epoch_{epoch:02d}"


def resolve_checkpoint(spark: SparkSession, root: str, run: str, epoch: int | None = None) -> str:
    """A run's checkpoint folder: of an epoch, else `best`, else of the last epoch."""
    names = _names(spark, f"{root}/{run}")
    epochs = [n for n in names if n.startswith("epoch_")]
    wanted = checkpoint_name(epoch) if epoch is not None else "best" if "best" in names else epochs[-1] if epochs else None
    if wanted not in names:
        raise FileNotFoundError(f"{root}/{run}: no {wanted or 'checkpoint'}; there are {', '.join(epochs) or 'none'}")
    return f"{root}/{run}/{wanted}"


def runs_with_best(spark: SparkSession, root: str) -> list[str]:
    return [n for n in _names(spark, root) if "best" in _names(spark, f"{root}/{n}")]


def data_paths(profile: str, root: str | None = None, variable: str = "QUILLMESH_DATA") -> dict[str, str]:
    """Folders of a profile under a root: the argument's, else an environment variable's, else `data`."""
    top = (root or os.environ.get(variable) or "data").rstrip("/")
    return {name: f"{top}/{place}/{profile}" for name, place in (("clean", "processed"), ("interim", "interim"), ("output", "output"))} | {"raw": f"{top}/raw"}


def missing_paths(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """Those that do not exist."""
    out = {}
    for name, path in paths.items():
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            out[name] = path
    return out
