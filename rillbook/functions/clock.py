"""The reference point of time-relative questions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F


def as_of(df: DataFrame, when: datetime | str | None = None, ts: str = "ts") -> Column:
    """The given instant, or the latest time of the table as a scalar subquery.

    The subquery is one partial ``max`` per task, and its value reaches the scan as a filter.
    """
    if when is not None:
        return F.lit(when).cast("timestamp_ntz")
    return df.agg(F.max(ts).alias("as_of")).scalar()


def span(delta: timedelta) -> Column:
    return F.lit(delta)


def micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def time_key(ts: Column, seq: Column) -> Column:
    """Time and row number as one sortable number.

    A maximum over a struct makes Spark sort all rows; over a decimal it stays a hash aggregate.
    """
    return micros(ts).cast("decimal(38,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + seq.cast("decimal(20,0)")
