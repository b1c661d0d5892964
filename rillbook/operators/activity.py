"""Activity questions: breakdowns, top users, recent activity, time series."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rillbook.functions.clock import span
from rillbook.functions.text import percent
from rillbook.operators.ingest import display_id, event_line
from rillbook.operators.state import user_state


def type_breakdown(type_counts: DataFrame) -> DataFrame:
    """Events per type and their share.

    The share is taken over one row per type, after all counting.
    """
    per_type = type_counts.groupBy("event_type").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(W.partitionBy())
    return per_type.withColumn("percentage", percent(F.col("n"), total)).orderBy(F.desc("n"), "event_type")


def user_activity(journal: DataFrame) -> DataFrame:
    """Users, active users, mean to two decimals and maximum; one aggregate instead of a count per id."""
    per_id = journal.groupBy("persistence_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.count_if(F.col("n") > 0).alias("active_users"),
        F.coalesce(F.round(F.sum("n") / F.count(F.lit(1)), 2), F.lit(0.0)).alias("avg_events_per_user"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_events_per_user"),
    )


def recent_activity(type_counts: DataFrame, limit: int = 20) -> DataFrame:
    """Newest users first, one row per user and type; ties by user and type.

    Every user has a row, so the rows asked for belong to as many users at most: those are found first.
    """
    per_user = type_counts.groupBy(F.col("user_id").alias("newest_user")).agg(F.max("last_ts").alias("last_updated"))
    newest = per_user.orderBy(F.col("last_updated").desc_nulls_last(), "newest_user").limit(limit)
    rows = type_counts.join(F.broadcast(newest), F.col("user_id").eqNullSafe(F.col("newest_user")))
    return (
        rows.orderBy(F.col("last_updated").desc_nulls_last(), "user_id", "event_type")
        .limit(limit)
        .select(
            display_id(F.col("user_id")).alias("display_id"),
            "user_id",
            "event_type",
            "n",
            "last_updated",
            event_line(F.col("event_type"), display_id(F.col("user_id"))).alias("details"),
        )
    )


def top_users(type_counts: DataFrame, limit: int = 10) -> DataFrame:
    return (
        user_state(type_counts)
        .orderBy(F.desc("total_events"), "user_id")
        .limit(limit)
        .select(display_id(F.col("user_id")).alias("display_id"), "user_id", "total_events", F.col("last_ts").alias("last_activity"))
    )


def hourly_series(events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Events and distinct users in each of the last ``hours`` clock hours, empty ones included."""
    first = F.date_trunc("hour", as_of).cast("timestamp_ntz") - span(timedelta(hours=hours - 1))
    counted = (
        events.filter((F.col("ts") >= first) & (F.col("ts") <= as_of))
        .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_start"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hour_start")
        .agg(F.sum("n").alias("events"), F.count("user_id").alias("users"))
    )
    one = events.sparkSession.range(1)
    hours_of_day = one.select(F.explode(F.sequence(first, as_of, F.expr("INTERVAL 1 HOUR"))).alias("hour_start"))
    return hours_of_day.join(counted, "hour_start", "left").select(
        "hour_start",
        F.date_format("hour_start", "HH:mm").alias("label"),
        F.coalesce("events", F.lit(0)).alias("events"),
        F.coalesce("users", F.lit(0)).alias("users"),
    )
