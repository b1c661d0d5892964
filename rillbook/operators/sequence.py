"""Is every event newer than all its user sent before?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rillbook.operators.ordered import Running, running

MAX_LATE_MS = 1000


def late_label(late_ms: Column, limit_ms: int) -> Column:
    return F.when(late_ms > limit_ms, "INVALID").otherwise(F.lit("WARNING"))


def sequence_check(events: DataFrame, max_late_ms: int = MAX_LATE_MS, ranges: int | None = None) -> DataFrame:
    """Label every event by its lateness against the newest earlier arrival of its user.

    Late rows are older than the running maximum, so they never move it. Rows without user or time
    are INVALID and take no part in the comparison.
    """
    usable = F.col("user_id").isNotNull() & F.col("ts_us").isNotNull()
    rows = events.select("seq", "event_id", "user_id", "event_type", "ts_us", "arrival_us")
    checked = running(
        rows.filter(usable), ["user_id"], [F.col("arrival_us"), F.col("seq")],
        [Running("last_us", F.col("ts_us"), "max")], ranges,
    )
    late = F.col("last_us") > F.col("ts_us")
    late_ms = F.when(late, F.floor((F.col("last_us") - F.col("ts_us")) / 1000)).cast("bigint")
    checked = checked.withColumn("late_ms", late_ms).withColumn(
        "label", F.when(F.col("late_ms").isNull(), "VALID").otherwise(late_label(F.col("late_ms"), max_late_ms))
    )
    unusable = rows.filter(~usable).select(
        *rows.columns,
        F.lit(None).cast("bigint").alias("last_us"),
        F.lit(None).cast("bigint").alias("late_ms"),
        F.lit("INVALID").alias("label"),
    )
    return checked.unionByName(unusable)


def sequence_violations(checked: DataFrame) -> DataFrame:
    """Every late event, with both times, for later analysis."""
    return checked.filter(F.col("late_ms").isNotNull()).select(
        "event_id", "user_id", "event_type", "ts_us", "last_us", "late_ms", "label"
    )


def kept_violations(violations: DataFrame, as_of_us: Column, days: int = 7) -> DataFrame:
    """Violations are kept for a week."""
    return violations.filter(F.col("last_us") >= as_of_us - F.lit(days * 86_400_000_000))
