"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.session import ship_package
from quillmesh.storage import Stage

#: Edges that one task links in memory; more are linked in rounds.
SMALL = 1 << 16


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of a task."""
    parts = [[b.column(c).to_numpy() for c in range(2)] for b in batches if b.num_rows]
    if not parts:
        return
    src, dst = (np.concatenate([p[c] for p in parts]) for c in range(2))
    nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b, label = ends[: len(src)], ends[len(src) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node with the least of the node and its neighbours."""
    both = edges.union(edges.select("dst", "src"))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    return (
        both.filter("dst > src").join(least, "src")
        .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours with the least of these."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("low"))
    linked = down.join(least, "src").filter("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return linked.union(least.select("src", F.col("low").alias("dst"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, component): every node that has an edge, with the least node reachable from it.

    Up to `small` different edges between integer nodes are linked by one task. Beyond, each round costs two aggregations and two joins of the remaining edges, is written to the shared
    folder, and the number of rounds grows with the logarithm of the number of nodes. Hot nodes are
    pre-aggregated by min(); the joins can be split by adaptive execution. Null ends and loops are left out.
    """
    spark = edges.sparkSession
    stage = Stage(spark, "components")
    cur = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src is not null and dst is not null and src <> dst")
    cur = stage.put(cur.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "r0")
    if cur.schema["src"].dataType == cur.schema["dst"].dataType == T.LongType() and cur.count() <= small:
        ship_package(spark)
        return cur.repartition(1).mapInArrow(_linked, "node long, component long")
    seen = None
    for k in range(1, max_rounds + 1):
        cur = stage.put(_small_star(_large_star(cur)), f"r{k}")
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        stage.drop(f"r{k - 1}")
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    stars = cur.groupBy("src").agg(F.min("dst").alias("dst"))
    return stars.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(
        stars.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )
