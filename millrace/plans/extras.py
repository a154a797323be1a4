"""Event windows, as batch queries over the functions that streams use."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.register import query, table
from millrace.streaming import streams


def events(spark, d):
    return table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    return streams.tumbling(events(spark, d), "at", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts AS t, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g) SELECT user_id, min(t) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(spark, d):
    return streams.sessions(events(spark, d), "at", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
