"""Streaming queries, run over all rows that are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.session import ship
from sievework.streaming import events as S

QUERIES = {}
SQL = {}


def stream_windowed(spark, root):
    rows = S.windowed(S.stream_of(spark, f"{root}/events.parquet"), "ts", "event_type", "1 day", "400 days")
    return S.drained(rows, "windowed", "complete")


def stream_first_seen(spark, root):
    rows = S.first_seen(S.stream_of(spark, f"{root}/events.parquet"), "ts", ["user_id", "event_type"], "4000 days")
    return S.drained(rows.select("user_id", "event_type"), "first_seen", "append").groupBy("event_type").agg(F.count("*").alias("users"))


def stream_running_average(spark, root):
    rows = S.running_average(S.stream_of(ship(spark), f"{root}/events.parquet"), "event_type", "ts", "value", 0.1)
    return S.drained(rows, "running_average", "update").groupBy("event_type").agg(F.max_by(F.struct("n", "ema"), "n").alias("r")).select("event_type", "r.n", F.round("r.ema", 6).alias("ema"))


def stream_sliding(spark, root):
    return S.drained(S.sliding(S.stream_of(spark, f"{root}/events.parquet"), "ts", "event_type", "2 days", "1 day", "400 days"), "sliding", "complete")


def stream_sessions(spark, root):
    rows = S.sessions(S.stream_of(spark, f"{root}/events.parquet"), "ts", "user_id", "1 day", "400 days")
    return S.drained(rows, "sessions", "complete")


QUERIES |= {f.__name__: f for f in (stream_windowed, stream_first_seen, stream_running_average, stream_sliding, stream_sessions)}
SQL["stream_windowed"] = "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, count(*) AS n FROM events GROUP BY 1, 2"
SQL["stream_first_seen"] = "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"
SQL["stream_running_average"] = "WITH l AS (SELECT event_type, list(value ORDER BY ts, value) AS s FROM events GROUP BY 1) SELECT event_type, len(s) AS n, round(list_reduce(s, lambda e, x: e * 0.9e0 + x * 0.1e0), 6) AS ema FROM l"
SQL["stream_sliding"] = "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) - d * 86400000000 AS start_us, count(*) AS n FROM events, (VALUES (0), (1)) v(d) GROUP BY 1, 2"
SQL["stream_sessions"] = """WITH r AS (SELECT user_id, epoch_us(ts) AS t, CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 86400000000 AS INTEGER) AS n FROM events),
s AS (SELECT user_id, t, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS k FROM r) SELECT user_id, min(t) AS start_us, max(t) + 86400000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k"""
