"""Cutting the lineage of iterative jobs on storage that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Whether shuffle files go when the action that wrote them has ended, instead of when the driver's memory is collected.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; only a local session without it (tests) gets one of its own.

    Whatever reads a table or checkpoint in it does not need the shuffles of the action that wrote it: a session that does not
    say otherwise frees them with the action.
    """
    context = spark.sparkContext
    if spark.conf.get(FREED, None) is None:
        spark.conf.set(FREED, "true")
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder before running iterative operators")
            shared = tempfile.mkdtemp(prefix="attesta-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: smaller than a checkpoint where columns repeat or few of them are read again.

    Unlike a checkpoint the table is not removed with the last reference to it.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
