"""A watched folder, edge counts and event sequences across batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from strandgraph.sources import code
from strandgraph.streaming import watch


def test_watched_folder_replaces_only_what_changed(spark, tmp_path):
    src, out, state = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    (src / "a.js").write_text("function one() {}")
    (src / "b.js").write_text("function two() {}")
    work = lambda df: code.functions(code.parse(df)).select(F.regexp_extract("file", "[^/]*$", 0).alias("file"), "name")
    run = lambda: watch.watch(watch.file_stream(spark, str(src), "*.js"), work, out, state, available_now=True).awaitTermination(60)
    run()
    assert {(r["file"], r["name"]) for r in spark.read.parquet(out).collect()} == {("a.js", "one"), ("b.js", "two")}
    (src / "b.js").unlink()
    (src / "b2.js").write_text("function three() {} function four() {}")
    run()
    assert {r["name"] for r in spark.read.parquet(out).collect()} == {"one", "two", "three", "four"}


def batches(spark, tmp_path, rows):
    folder = tmp_path / "events"
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.mode("append").parquet(str(folder / f"{k}"))
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


@pytest.fixture
def events():
    return [[(1, at(0), 7, "view"), (2, at(1), 7, "click"), (3, at(1), 8, "view")], [(4, at(2), 7, "buy"), (5, at(3), 8, "buy")]]


def test_edge_counts(spark, tmp_path, events):
    stream = batches(spark, tmp_path, events).select(F.lit("x").alias("src"), F.col("event_type").alias("dst"))
    q = watch.edge_counts(stream).writeStream.outputMode("complete").format("memory").queryName("edge_counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["dst"], r["n"]) for r in spark.table("edge_counts").collect()} == {("view", 2), ("click", 1), ("buy", 2)}


def test_sequences_across_batches(spark, tmp_path, events):
    q = watch.sequences(batches(spark, tmp_path, events)).writeStream.format("memory").queryName("sequences").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {(r["key"], r["src"], r["dst"]) for r in spark.table("sequences").collect()} == {(7, "view", "click"), (7, "click", "buy"), (8, "view", "buy")}


def test_windowed_counts(spark, tmp_path, events):
    counted = watch.windowed_counts(batches(spark, tmp_path, events))
    q = counted.writeStream.outputMode("update").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(r["n"] for r in spark.table("windowed").groupBy("event_type").agg(F.max("n").alias("n")).collect()) == 5


def event_files(spark, folder, parts):
    for k, rows in parts:
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def hour(h, minute=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h, minutes=minute)


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    """Three runs over a growing folder give what one run over all of it gives; nothing is told twice."""
    from strandgraph.streaming import events

    parts = [
        [(1, hour(0), 7, "click"), (2, hour(1), 7, "purchase"), (3, hour(1), 8, "click"), (4, None, 8, "view"), (5, hour(2), None, "view")],
        [(6, hour(4), 7, "view"), (7, hour(9), 8, "purchase"), (8, hour(9), 7, "click")],
        [(9, hour(30), 7, "purchase"), (10, hour(31), 9, "view")],
    ]
    src, out = str(tmp_path / "in"), tmp_path / "out"
    for k in range(3):
        event_files(spark, src, [(k, parts[k])])
        found = {}
        for name, make in (("edges", events.session_edges), ("days", events.closed_windows), ("answers", lambda s: events.answers(s, "click", "purchase"))):
            found[name] = events.run_to_end(make(events.event_stream(spark, src)), str(out / name))
    rows = lambda name: sorted(map(tuple, found[name].collect()), key=repr)
    assert rows("edges") == sorted([(7, "click", "purchase"), (7, "purchase", "view"), (7, "view", "click"), (7, "click", "end"), (8, "click", "end"), (8, "purchase", "end")], key=repr)
    assert rows("answers") == [(1, 2)]
    assert {(r["start"].day, r["event_type"], r["n"]) for r in found["days"].collect()} == {(1, "click", 3), (1, "purchase", 2), (1, "view", 2)}
