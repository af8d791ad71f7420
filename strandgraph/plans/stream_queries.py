"""Queries that run a stream over the events to its end and read back what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandgraph.streaming import events

from .catalogue import query

_SESSIONS = """l AS (SELECT user_id, ts, event_type, lead(event_type) OVER w AS next_type, lead(ts) OVER w AS next_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT max(epoch_ms(ts)) - 3600000 AS mark FROM events),
s AS (SELECT user_id AS key, event_type AS src, CASE WHEN epoch_ms(next_ts) - epoch_ms(ts) <= 21600000 THEN next_type ELSE 'end' END AS dst FROM l, m WHERE next_ts IS NOT NULL OR epoch_ms(ts) + 21600000 <= mark)"""


@query(f"WITH {_SESSIONS} SELECT key, src, dst, count(*) AS n FROM s GROUP BY ALL")
def stream_session_edges(spark, sf_dir):
    """How often a user's events follow each other in a session or end one, by state and timers."""
    edges = events.run_to_end(events.session_edges(events.event_stream(spark, sf_dir)))
    return edges.groupBy("key", "src", "dst").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events) SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events, m GROUP BY ALL HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= any_value(mark)".replace("GROUP BY ALL HAVING", "GROUP BY 1, 2 HAVING"))
def stream_daily_counts(spark, sf_dir):
    """Events of each type a day, of days that the watermark has passed."""
    return events.run_to_end(events.closed_windows(events.event_stream(spark, sf_dir))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT a.event_id AS asked_id, b.event_id AS answer_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def stream_answers(spark, sf_dir):
    """Clicks with the purchases of the same user within six hours, by a join of two streams."""
    return events.run_to_end(events.answers(events.event_stream(spark, sf_dir), "click", "purchase"))
