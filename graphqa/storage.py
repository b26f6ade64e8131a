"""Lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The configured checkpoint folder; a temporary one is made only in local mode, where the driver is the only machine."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="graphqa-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/graphqa-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
