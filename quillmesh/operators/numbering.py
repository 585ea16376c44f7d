"""Row numbers and running sums in a total order, without sorting a table in one task.

Rows are dealt to range partitions of the order and written, so that both passes see the same partitions. A running
sum inside each partition and one over the partitions' totals (a row a partition) give the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.names import spare
from quillmesh.storage import Stage


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the running sums, this row included, of columns without nulls; ties in the order come in any order."""
    part = spare("part", df.columns)
    stage = Stage(df.sparkSession, "running")
    own = {spare(f"own_{k}", df.columns): c for k, c in enumerate(sums.values())}
    placed = stage.put(df.withColumns(own).repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "placed")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = placed.groupBy(F.col(part).alias("part")).agg(*[F.sum(c).alias(f"s{k}") for k, c in enumerate(own)])
    bases = totals.select("part", *[F.coalesce(F.sum(f"s{k}").over(before), F.lit(0)).alias(f"b{k}") for k in range(len(own))])
    names = [spare(f"base_{k}", placed.columns) for k in range(len(own))]
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = placed.join(bases.toDF(part, *names), part)
    return got.withColumns({n: F.sum(c).over(inside) + F.col(b) for n, c, b in zip(sums, own, names, strict=True)}).drop(part, *own, *names)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with consecutive numbers from 0 in a total order."""
    return running(df, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)
