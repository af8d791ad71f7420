"""Streams of events (event_id, ts, user_id, event_type): sessions by timers, windows, and events that answer each other."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandgraph.operators.lineage import shared_folder

#: State with timers needs this store; the setting is only read when a stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
END = "end"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", per_batch: int | None = None) -> DataFrame:
    """The Parquet file or folder ``name`` of a folder as a stream, ``per_batch`` files a batch."""
    # A pattern, as a stream's path may only be a single file if it is one.
    path = f"{folder}/{name[:-1]}[{name[-1]}]"
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema)
    rows = (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant; the files may have local times


def run_to_end(stream: DataFrame, out: str | None = None) -> DataFrame:
    """What an append-mode stream gives for all that is there now, read back. It is written with its checkpoint to ``out``, a
    folder that the cluster shares: run again with the same ``out``, it goes on after what has been read, and a run that
    failed writes no row twice."""
    spark = stream.sparkSession
    out = out or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    was = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        # The sink's log names the files of whole batches; readers of its folder go by it.
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(STORE[0]) if was is None else spark.conf.set(STORE[0], was)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


class Sessions(StatefulProcessor):
    """Of each key the last event's type and time, in milliseconds; a timer ends the session ``gap`` after it."""

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "event_type string, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        what, at = self.last.get() if self.last.exists() else (None, None)
        if at is not None:
            self.handle.deleteTimer(at + self.gap_ms)
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for ts, kind in zip(batch["ts"], batch["event_type"], strict=True):
            now = ts.value // 1_000_000
            if at is not None and now < at:
                continue  # later than the watermark allows for
            if at is not None:
                out.append((key[0], what, kind if now - at <= self.gap_ms else END))
            what, at = kind, now
        self.last.update((what, at))
        self.handle.registerTimer(at + self.gap_ms)
        yield pd.DataFrame(out, columns=["key", "src", "dst"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        what, _ = self.last.get()
        self.last.clear()
        yield pd.DataFrame([(key[0], what, END)], columns=["key", "src", "dst"])

    def close(self) -> None:
        pass


def session_edges(events: DataFrame, key: str = "user_id", gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """``key, src, dst``: each event's type and that of the same key's next one, or ``end`` if none comes within ``gap``.

    A key's state is one small row, and it goes when its session ends. Events of a batch are taken by time and id; one that is
    earlier than its key's last is left out. What ends after the watermark is still open when a run ends.
    """
    kind = events.schema[key].dataType.simpleString()
    picked = events.select(key, "ts", "event_id", "event_type").where(f"{key} IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return picked.groupBy(key).transformWithStateInPandas(Sessions(int(pd.Timedelta(gap).total_seconds() * 1000)), f"key {kind}, src string, dst string", "append", "eventTime")


def closed_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``start, event_type, n`` of the tumbling windows that the watermark has passed; their state goes with them."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n")


def answers(events: DataFrame, asked: str, answer: str, within: str = "6 hours", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """``asked_id, answer_id``: events of type ``asked`` with those of type ``answer`` of the same key that come no later than
    ``within`` after it. A join of two streams; both sides' state is bounded by the watermarks and that time."""
    side = lambda kind, n: events.where(F.col("event_type") == kind).select(F.col(key).alias(f"{n}_key"), F.col("ts").alias(f"{n}_ts"), F.col("event_id").alias(f"{n}_id")).withWatermark(f"{n}_ts", late)
    on = F.expr(f"asked_key = answer_key AND answer_ts >= asked_ts AND answer_ts <= asked_ts + INTERVAL {within}")
    return side(asked, "asked").join(side(answer, "answer"), on).select("asked_id", "answer_id")
