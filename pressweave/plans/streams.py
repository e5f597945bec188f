"""Queries over the event log: closed windows of a stream, and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.adapter import News
from ..streaming.events import counts_by_window, drain, read_stream
from .registry import query


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events
GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)""", False)
def event_windows_stream(spark, sf_dir):
    """Hourly counts of a stream, of the windows that its watermark has closed."""
    # a watermark takes time stamps with a zone only
    events = read_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return drain(counts_by_window(events)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, TRUE) AS fresh, event_id FROM events),
s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""", False)
def event_sessions(spark, sf_dir):
    """X11: a reader's sessions, which half an hour without events ends."""
    events = News(spark, sf_dir).table("events")
    sessions = events.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return sessions.select("user_id", F.col("session_window.start").alias("start"), "n")
