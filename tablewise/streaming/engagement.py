"""Engagement reports over an unbounded stream of events, in append mode.

A result comes out once the watermark has passed it, so the last open windows are kept back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.operators.engagement import CLICKED, ENGAGED_SECONDS, ENTERED, VISIT_GAP_SECONDS, is_click

LATENESS = "10 minutes"
_LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def windowed_clicks(events: DataFrame, width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Clicks per item and window; the clicks alone move the watermark."""
    return (
        events.where(is_click())
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("w"), "gmap_id")
        .agg(F.count(F.lit(1)).alias("n_clicks"))
        .select(F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "gmap_id", "n_clicks")
    )


def windowed_click_through(events: DataFrame, width: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Users who entered and users who clicked per window, each once.

    Two aggregations: first one row per window and user, which is the state, then their sums. A user
    with very many events is one row per task before the shuffle.
    """
    flag = lambda test: F.max(F.when(test, 1).otherwise(0))
    per_user = (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("w"), "user_id")
        .agg(flag(F.col("event_type") == ENTERED).alias("entered"), flag(is_click()).alias("clicked"))
        .select(F.window_time("w").alias("ts"), "entered", "clicked")
    )
    return (
        per_user.groupBy(F.window("ts", width).alias("w"))
        .agg(F.sum("entered").alias("users_entered"), F.sum("clicked").alias("users_clicked"))
        .select(
            F.unix_millis("w.start").alias("start_ms"),
            F.unix_millis("w.end").alias("end_ms"),
            "users_entered",
            "users_clicked",
            F.try_divide("users_clicked", "users_entered").alias("click_through"),
        )
    )


def session_visits(
    events: DataFrame, gap_seconds: int = VISIT_GAP_SECONDS, lateness: str = LATENESS
) -> DataFrame:
    """Visits of each user, closed by a gap.

    Rows of a visit are merged in the task that reads them, before the shuffle, so a very busy user
    sends one row per task and visit.
    """
    events.sparkSession.conf.set(_LOCAL_MERGE, "true")
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", f"{gap_seconds} seconds").alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n_events"), F.count_if(is_click()).alias("n_clicks"))
        .select(
            "user_id",
            F.unix_millis("w.start").alias("start_ms"),
            (F.unix_millis("w.end") - gap_seconds * 1000).alias("last_ms"),
            "n_events",
            "n_clicks",
        )
    )


def engaged_clicks(
    events: DataFrame, within_seconds: int = ENGAGED_SECONDS, lateness: str = LATENESS
) -> DataFrame:
    """Clicks at most this long after an enter of the same user, each once.

    Both sides have a watermark and the condition bounds their distance, so state is dropped with it.
    """
    enters = (
        events.where(F.col("event_type") == ENTERED)
        .select(F.col("user_id").alias("e_user"), F.col("ts").alias("e_ts"))
        .withWatermark("e_ts", lateness)
    )
    clicks = (
        events.where(F.col("event_type") == CLICKED)
        .select("user_id", "gmap_id", "ts")
        .withWatermark("ts", lateness)
    )
    fits = (
        (F.col("user_id") == F.col("e_user"))
        & (F.col("ts") >= F.col("e_ts"))
        & (F.col("ts") <= F.col("e_ts") + F.make_dt_interval(secs=F.lit(within_seconds)))
    )
    return clicks.join(enters, fits, "left_semi").select(
        "user_id", "gmap_id", F.unix_millis("ts").alias("click_ms")
    )
