"""Queries of the streams, each with the batch result as its twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.plans.registry import query, table
from leafmill.streaming import events


@query("t_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.drain(events.tumbling(events.read_events(spark, sf_dir)), "complete")


@query(
    "t_sliding",
    """
    SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE FOR k IN range(4)]) AS start FROM events) GROUP BY ALL
    """,
)
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.drain(events.sliding(events.read_events(spark, sf_dir)), "complete")


@query(
    "t_session",
    """
    SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
      SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800 * 1000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s
    """,
)
def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.drain(events.session_windows(events.read_events(spark, sf_dir)), "complete")


@query("t_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.drain(events.distinct_events(events.read_events(spark, sf_dir, "60 days")), "append")  # longer than the data: every pair once


@query("t_state", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.drain(events.running_totals(events.read_events(spark, sf_dir)), "update")
    last = rows.groupBy("user_id").agg(F.max(F.struct("n", "total")).alias("l"))
    return last.select("user_id", F.col("l.n").alias("n"), F.round("l.total", 2).alias("total"))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


@query(
    "t_late",
    """
    SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n FROM events
    WHERE NOT (event_id % 7 = 0 AND ts < TIMESTAMP '2024-01-04') AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1
    """,
)
def late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of eight days; the third has rows of the first days, which the watermark of two days leaves out.

    What is late in a batch is judged by the watermark with which the batch before began.
    """
    e, day = _days(spark, sf_dir), F.dayofmonth("ts")
    behind = (F.col("event_id") % 7 == 0) & (day <= 3)
    turn = F.when(behind, 2).otherwise(F.floor((day - 1) / 8))
    parts = [e.where(turn == k) for k in range(4)]
    return events.drain(events.closed_days(events.in_turns(parts, "ts", "2 days")), "append")


@query(
    "t_streaks",
    """
    WITH runs AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM events)
    SELECT user_id, sum(k)::BIGINT AS n, max(k) AS longest FROM (SELECT user_id, event_type, run, count(*) AS k FROM runs GROUP BY ALL) GROUP BY user_id
    """,
)
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own state over three batches; the state store that it needs is set for this stream alone."""
    e, day = _days(spark, sf_dir), F.dayofmonth("ts")
    parts = [e.where(day <= 10), e.where((day > 10) & (day <= 20)), e.where(day > 20)]
    rows = events.with_own_state(spark, lambda: events.drain(events.streaks(events.in_turns(parts, "ts", "0 seconds")), "update"))
    return rows.groupBy("user_id").agg(F.max("n").alias("n"), F.max("longest").alias("longest"))


def _tens(e: DataFrame) -> list[DataFrame]:
    day = F.dayofmonth("ts")
    return [e.where(day <= 10), e.where((day > 10) & (day <= 20)), e.where(day > 20)]


@query("t_dedup_days", "SELECT DISTINCT user_id, event_type, date_trunc('day', ts)::TIMESTAMP AS day FROM events")
def dedup_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delay of one day: keys of days that are over leave the state."""
    return events.drain(events.distinct_by_day(events.in_turns(_tens(_days(spark, sf_dir)), "ts", "1 day")), "append")


_FOLLOWED = """
    WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
    seen AS (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM p)) - INTERVAL 1 HOUR AS until)
    SELECT c.event_id, c.user_id, c.ts, p.event_id AS then_id FROM c LEFT JOIN p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOUR
    WHERE p.event_id IS NOT NULL OR c.ts + INTERVAL 6 HOUR < (SELECT until FROM seen)
"""


@query("t_join", _FOLLOWED)
def join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams in three batches each: clicks with the purchases of the next six hours, alone when those are over."""
    e = _days(spark, sf_dir)
    sides = [events.in_turns(_tens(e.where(F.col("event_type") == kind)), "ts", "1 hour") for kind in ("click", "purchase")]
    return events.drain(events.followed(*sides, "6 HOURS"), "append")


@query(
    "t_silence",
    """
    SELECT user_id, ts AS last FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM events)
    WHERE following - ts > INTERVAL 12 HOUR OR (following IS NULL AND ts + INTERVAL 12 HOUR < (SELECT max(ts) FROM events))
    """,
)
def silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timers of event time: users that nothing came from for twelve hours."""
    e = _days(spark, sf_dir)
    rows = events.with_own_state(spark, lambda: events.drain(events.silences(events.in_turns(_tens(e), "ts", "0 seconds")), "append"))
    return rows.select("user_id", F.timestamp_micros("last_us").cast("timestamp_ntz").alias("last"))


@query("t_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State that lives for an hour of the clock, longer than the query runs: every key once over all batches."""
    e = _days(spark, sf_dir)
    return events.with_own_state(spark, lambda: events.drain(events.first_seen(events.in_turns(_tens(e), "ts", "0 seconds"), 3_600_000), "append"), events.BY_THE_CLOCK)
