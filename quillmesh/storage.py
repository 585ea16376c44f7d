"""Stage tables: intermediate results cut from their lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Without one, a temporary folder in local mode, and an error elsewhere."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN.get(sc.applicationId) or tempfile.mkdtemp(prefix="quillmesh-stage")
        _OWN[sc.applicationId] = folder
    return folder.rstrip("/")


#: Spark's own switch that deletes a plan's shuffle files when its execution ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end_here(spark: SparkSession) -> Iterator[None]:
    """Plans executed inside leave no shuffle files; each written table is read from its files only."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Stage:
    """A set of Parquet tables in the shared folder. Executors may be lost: written tables stay readable."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write df with the writer's options, and return it as read from the written table."""
        path = f"{self.root}/{name}"
        with shuffles_end_here(self.spark):
            df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
