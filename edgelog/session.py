"""What the library needs from the caller's session: a shared folder, nothing else."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Lets the Python workers of a session import this package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Only in a local session without such a setting a temporary folder is made; elsewhere that is an error,
    since executors could not see it. What jobs leave there belongs to their run: remove it when its results are no
    longer read.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not configured and not context.getCheckpointDir() and not re.match(r"local($|\[)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="edgelog-"))
    return configured or context.getCheckpointDir()


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier run has written."""
    return os.path.join(shared_dir(spark), "edgelog", f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once below the shared folder and read back, for results that several jobs use."""
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
