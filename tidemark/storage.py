"""Cutting lineage where a table is read several times: a checkpoint in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one in spark.checkpoint.dir or, where that is unset, the context's
    own; in this machine alone (tests) a new one may stand in for it."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir", ""):
        return folder
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it and the session are still there."""
    with contextlib.suppress(Exception):  # the session may have ended before
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jvm_path, True)


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """The table written as Parquet in the shared folder, in folders by a column if one is named, and read again: columns
    and folders are read as needed. It goes when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    atexit.register(drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The table, computed once and read from the folder in spark.checkpoint.dir from then on; it outlives executors.
    Where that is unset, the context's own checkpoint folder or, if all executors run in this machine, a new one."""
    folder, sc = shared_folder(df.sparkSession), df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
