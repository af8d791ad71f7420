"""Structured Streaming: files that are read again when they change, and graphs of events.

A watched folder is a file stream; each batch holds the new or changed files, and only their rows of the results are
replaced, a partition a file, so a change costs as much as the files that changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandgraph.functions import paths


def file_stream(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path, ext, content`` of files as they come or change under ``folder``."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).schema("value string").load(folder)
    path = F.col("_metadata.file_path")
    return rows.select(path.alias("path"), paths.extension(path).alias("ext"), F.col("value").alias("content"))


def watch(files: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keeps ``work(files)``, a table with a ``file`` column, up to date in ``out``: of each batch only the files' own partitions
    are written anew. A batch that is run again after a failure writes the same partitions again."""

    def batch(df: DataFrame, _: int) -> None:
        found = work(df)
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(out)

    stream = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def edge_counts(events: DataFrame) -> DataFrame:
    """``src, dst, n``: how often each edge came, for update or complete mode; state is a row an edge."""
    return events.groupBy("src", "dst").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """``window, event_type, n`` of tumbling windows; events later than ``late`` are left out, so state is bounded."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"))


def sequences(events: DataFrame, key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """``key, src, dst, at``: each event's type after the one before it of the same key, across batches.

    State is the last event of a key; it goes when the watermark has passed it by ``late``. Within a batch events are
    ordered by time and id; an event before the key's last one is late and left out.
    """
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last_type, last_at = state.get if state.exists else (None, None)
        out = []
        for at, what in zip(rows["ts"], rows["event_type"], strict=True):
            ms = int(at.value // 1_000_000)
            if last_at is None or ms >= last_at:
                if last_type is not None:
                    out.append((k[0], last_type, what, at))
                last_type, last_at = what, ms
        state.update((last_type, last_at))
        state.setTimeoutTimestamp(max(last_at, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["key", "src", "dst", "at"])

    picked = events.select(key, "ts", "event_id", "event_type").withWatermark("ts", late)
    return picked.groupBy(key).applyInPandasWithState(run, f"key {kind}, src string, dst string, at timestamp", "last string, at long", "append", GroupStateTimeout.EventTimeTimeout)
