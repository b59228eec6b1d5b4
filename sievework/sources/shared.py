"""The folder that driver and executors share, and tables kept in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder of a local session; on a cluster that is an error, as no
    other machine would see it."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-sievework-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/sievework-{name}-{uuid.uuid4().hex}"


def once(df: DataFrame) -> DataFrame:
    """Computes a table that is read several times once, and cuts its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
