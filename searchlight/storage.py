"""The folder that the driver and all executors share, and tables written to it."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where it is unset, in one process only."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="searchlight-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return posixpath.join(shared_folder(spark), f"{kind}-{uuid.uuid4().hex}")


def written(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder, so that lost executors cost one step."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
