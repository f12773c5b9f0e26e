"""Cutting a plan where it would be computed again and again, and folders for what is written on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; where that is unset, and Spark runs on this machine only, one of its own."""
    context = spark.sparkContext
    named = context.getConf().get(CHECKPOINT_CONF, None) or spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="gridlark-")
        spark.conf.set(CHECKPOINT_CONF, named)
    return named.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/gridlark/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder that the cluster shares and go on from there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
