"""Helpers shared by the training-data operators."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode White_Space as the inside of a regex character class; the tokenizer libraries' \s.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one in local mode."""
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
    """A path in the shared folder that nobody else uses."""
    return posixpath.join(shared_dir(spark), f"{kind}-{uuid.uuid4().hex}")


def materialised(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage: computed once, and readable after executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, the text as UTF-8 bytes and null as empty."""
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias(text))


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 22):
    """Slices of a batch whose column (strings or bytes) has about ``most`` bytes each, so that long texts don't add up in memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
