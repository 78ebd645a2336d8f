"""Intermediate tables in the folder that the cluster shares, and inputs spread over its cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Inputs below this are dealt out before a Python stage: their files may hold a single row group, which is one task.
SPREAD_BYTES = 1 << 30


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and everything runs on this machine, as in tests, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="maskwell-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read from there, so that it is computed once and survives lost executors.
    The files stay until the folder is cleared, as the result is read lazily."""
    path = f"{shared_folder(df.sparkSession)}/maskwell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A small ``df`` dealt out over all cores; a large one as it is, without a shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism) if size < SPREAD_BYTES else df
