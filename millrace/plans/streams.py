"""Streaming queries over events, run to the end of the input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import operators, runs
from .base import register, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.source(spark, f"{sf_dir}/events.parquet")


def _closing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Callable[[], None]]:
    return runs.closing(spark, f"{sf_dir}/events.parquet", "ts")


@register("stream_filter", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 10")
def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.drained(_events(spark, sf_dir).where("event_type = 'purchase' AND value > 10").select("event_id", "user_id", "value"))


@register("stream_static_join", "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return runs.drained(_events(spark, sf_dir).select("event_id", "user_id").join(customers, "user_id").select("event_id", "c_name"))


@register("stream_tumbling", "SELECT date_trunc('hour', ts) AS begin, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, close = _closing(spark, sf_dir)
    counts = operators.windowed(operators.timed(events), ["event_type"], "1 hour")
    return runs.drained(counts, close=close).select(F.col("begin").cast("timestamp_ntz").alias("begin"), "event_type", "n")


@register("stream_sliding", "SELECT b AS begin, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS b FROM events) GROUP BY b")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, close = _closing(spark, sf_dir)
    counts = operators.windowed(operators.timed(events), [], "1 hour", "30 minutes")
    return runs.drained(counts, close=close).select(F.col("begin").cast("timestamp_ntz").alias("begin"), "n")


@register(
    "stream_sessions",
    """SELECT user_id, began AS begin, n FROM (SELECT user_id, session, count(*) AS n, min(ts) AS began FROM (
         SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
           SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
       GROUP BY user_id, session)""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, close = _closing(spark, sf_dir)
    counts = operators.session_counts(operators.timed(events), ["user_id"], "2 hours")
    return runs.drained(counts, close=close).select("user_id", F.col("begin").cast("timestamp_ntz").alias("begin"), "n")


@register("stream_distinct", "SELECT event_id, event_type FROM events")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream twice over: each event comes through once."""
    once = operators.timed(_events(spark, sf_dir).union(_events(spark, sf_dir)))
    return runs.drained(operators.first_seen(once, ["event_id"]).select("event_id", "event_type"))


@register(
    "stream_interval_join",
    "SELECT v.event_id AS view_id, b.event_id AS buy_id FROM events v JOIN events b ON v.user_id = b.user_id AND b.ts >= v.ts AND b.ts <= v.ts + INTERVAL 2 HOUR WHERE v.event_type = 'view' AND b.event_type = 'purchase'",
)
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _events(spark, sf_dir).where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("viewed_at"))
    buys = _events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").alias("user_id_right"), F.col("event_id").alias("buy_id"), F.col("ts").alias("bought_at"))
    return runs.drained(operators.interval_join(views, buys, "user_id", "viewed_at", "bought_at", "2 hours").select("view_id", "buy_id"))


@register("stream_state", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = runs.drained(operators.running_counts(_events(spark, sf_dir), "user_id"), "update")
    return counts.groupBy("user_id").agg(F.max("n").alias("n"))


@register("stream_timers", "SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id")
def timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' counts, given by a timer when a user has been idle for 500 days; their state ends with it."""
    events, close = _closing(spark, sf_dir)
    counts = operators.idle_counts(operators.timed(events).where("user_id is not null or event_id is null"), "user_id", "ts", 500)
    return runs.drained(counts, close=close, rocks=True).where("user_id is not null").select("user_id", "n", F.col("last").cast("timestamp_ntz").alias("last"))


@register("stream_map_state", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def map_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by user and type in a map for each user, whose entries end a day after their last row."""
    counts = runs.drained(operators.kind_counts(_events(spark, sf_dir), "user_id", "event_type", 24), "update", rocks=True, quiet=True)
    return counts.groupBy("user_id", "event_type").agg(F.max("n").alias("n"))
