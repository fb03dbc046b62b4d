"""Session defaults and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "terrafold", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for.

    Nothing here is required for right results: operators avoid session time
    zone dependent functions and never hint a broadcast, so AQE decides by
    measured sizes.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_path(spark: SparkSession, name: str, base: str | None = None) -> str:
    """A fresh folder below ``base``, or else the cluster's shared ``spark.checkpoint.dir``.

    It is removed when the application ends. Without a shared folder a
    temporary one is used in local mode; on a cluster, where executors would
    each write to their own disk, that is an error.
    """
    base = base or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several consumers must see the very same rows (range bounds
    from an approximate sketch, the rounds of a growing search), or would each
    recompute a long lineage. The files survive lost executors, and their known
    size lets the planner choose the join.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
