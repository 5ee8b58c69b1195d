"""Queries on the event table by time windows; the same plans run on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import windows as W


def events_daily(spark: SparkSession, d: str) -> DataFrame:
    x = W.tumbling(table(spark, d, "events"), "ts", "1 day", "1 day", "event_type")
    return x.select(F.date_format("desde", "yyyy-MM-dd").alias("dia"), "event_type", "n")


def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users with pauses under six hours, by number of events."""
    x = W.sessions(table(spark, d, "events"), "ts", "6 hours", "1 day", "user_id")
    return x.groupBy(F.col("n").alias("eventos")).agg(F.count("*").alias("sesiones"))


QUERIES = {f.__name__: f for f in (events_daily, events_sessions)}
ORACLE = {
    "events_daily": "SELECT strftime(ts, '%Y-%m-%d') AS dia, event_type, count(*) AS n FROM events GROUP BY ALL",
    "events_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT count(*) AS n FROM s GROUP BY user_id, s) SELECT n AS eventos, count(*) AS sesiones FROM c GROUP BY 1",
}
