"""Session settings and shared scratch storage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "panelforge", master: str | None = None, **settings) -> SparkSession:
    """A session with adaptive execution on, UTC time and Arrow transfer."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for name, value in {**defaults, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder: on a cluster a
    machine-local folder would vanish with its executor, so the setting is required there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_root(spark.sparkContext.applicationId)


@cache
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"panelforge-{application}-")


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/panelforge/{app}/{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared scratch storage and read it back.

    The result has no lineage: it is computed exactly once, later stages agree on its
    content, and a lost executor costs only the re-read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out.pinned_at = path
    return out


def unpin(df: DataFrame) -> None:
    """Delete what ``pin`` has written for ``df``; frames built on it can no longer be read."""
    _delete(df.sparkSession, df.pinned_at)


def forget_shuffles(spark: SparkSession) -> None:
    """Let executors delete the shuffle files that no frame can need any more.

    Spark does so once the driver has collected its own garbage, which may not happen for half an hour.
    """
    gc.collect()
    spark._jvm.System.gc()


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has pinned; frames built on it can no longer be read."""
    _delete(spark, f"{scratch_root(spark)}/panelforge/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
