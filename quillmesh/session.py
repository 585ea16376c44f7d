"""Session factory and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Upper ends of an Arrow batch, which bound what a Python stage and its JVM side hold at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def build_session(app: str = "quillmesh", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow transfer; conf overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python stages run where it is not installed.

    Arrow batches of the session are kept small from then on, unless the application set their size.
    """
    sc = spark.sparkContext
    for key, most in BATCH.items():
        if sc.getConf().get(key, None) is None:
            spark.conf.set(key, str(most))
    root = os.path.dirname(os.path.abspath(__file__))
    if sc.applicationId in _SHIPPED or not os.path.isdir(root):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="quillmesh"), "quillmesh_pkg.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quillmesh", os.path.relpath(full, root)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
