"""Text expressions shared by parsers and reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def has_text(col: Column) -> Column:
    """True when at least one character is neither blank nor a control character; NULL gives false."""
    return F.coalesce(col.rlike(r"[^\x00-\x20]"), F.lit(False))


def parts(col: Column, sep: str) -> Column:
    """Split on ``sep``, dropping empty strings at the end."""
    return F.split(F.regexp_replace(col, f"{sep}+$", ""), sep)


def long_or_null(col: Column) -> Column:
    """A signed decimal integer without blanks around it, else NULL."""
    return F.when(col.rlike(r"^[+-]?[0-9]+$"), col.try_cast("bigint"))


#: First millisecond past the year 9999; later values are not event times.
MAX_EPOCH_MS = 253402300800000


def epoch_ms_time(col: Column) -> Column:
    """Keep the digits, read them as epoch milliseconds; NULL when that is impossible."""
    ms = F.regexp_replace(col, "[^0-9]", "").try_cast("bigint")
    return F.when(ms < MAX_EPOCH_MS, F.timestamp_millis(ms)).cast("timestamp_ntz")


def ladder(steps, default) -> Column:
    """First matching ``(condition, label)`` wins."""
    out = None
    for cond, label in steps:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    """``num / den`` as a double, ``empty`` when there is nothing to divide by."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(empty))


def percent(num: Column, den: Column, empty: float = 0.0) -> Column:
    return F.when(den > 0, num.cast("double") / den.cast("double") * 100.0).otherwise(F.lit(empty))
