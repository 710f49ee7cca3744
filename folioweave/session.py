"""Session construction and the one place that knows about shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster job should start with. AQE sizes the shuffle partitions and
# splits skewed join partitions at run time. Nothing below is needed for right
# results.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # long expression chains: beyond this size the JVM would not compile the fused
    # method at all, while split projections stay compiled
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # no call-site capture for every column expression: plans build three times faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def build_session(app: str = "folioweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh directory below the folder the cluster shares.

    The folder is `spark.checkpoint.dir`. Only a local session, where driver and
    executors are one process, may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = os.path.join(tempfile.gettempdir(), "folioweave")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def values_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A small fixed table as an inline relation, so the planner knows its size."""
    def lit(v) -> str:
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS fixed({', '.join(columns)})")
