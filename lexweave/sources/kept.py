"""Intermediate tables that a query uses more than once."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="checkpoint-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one is made only on a single machine without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or _own_folder()


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def dealt(df: DataFrame, rows: int, together: int, *by: str) -> DataFrame:
    """df dealt by columns over as many tasks as spread has, or more if it has rows in all and a task is to have together of them: for steps whose memory grows with a task's rows."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-rows // together)), *by)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by columns over as many tasks as a shuffle has or the cluster runs at once: for steps whose work is large for their bytes, which adaptive execution would otherwise give to one task."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *by)
