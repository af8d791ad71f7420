"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, which ``spark.checkpoint.dir`` names. Only a session that runs in one JVM, as tests do,
    gets a folder of its own where that is unset; on a cluster executors wouldn't see it, so there it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="strandgraph-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of an iteration that are joined with themselves, written as Parquet to the shared folder.

    A checkpoint keeps the estimated size of the plan it was made by. Where each round joins the last one's rows with
    themselves, that estimate is multiplied by itself from round to round, into numbers of so many digits that planning stalls.
    A table that is read from files has their size.
    """

    def __init__(self) -> None:
        self._kept: list[str] = []
        self._last: str | None = None

    def step(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """``df``, written and read again. Without ``keep`` it takes the place of the last such table, which is deleted."""
        path = f"{shared_folder(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
        df.write.parquet(path)
        if keep:
            self._kept.append(path)
        else:
            if self._last is not None:
                delete(df.sparkSession, self._last)
            self._last = path
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame) -> DataFrame:
        """``df``, made of these tables, without need of them; they are deleted."""
        df = cut(df)
        for path in (*self._kept, self._last):
            if path is not None:
                delete(df.sparkSession, path)
        self._kept, self._last = [], None
        return df


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job has written and is done with, wherever Spark can reach it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
