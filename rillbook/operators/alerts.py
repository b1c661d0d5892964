"""Threshold alerts with a cooldown and a clear."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rillbook.functions.clock import micros
from rillbook.operators.ordered import Running, running
from rillbook.sources.storage import fixed

# Metric column -> alert type and threshold. A value above the threshold is a breach.
THRESHOLDS = {
    "memory_usage": ("HIGH_MEMORY_USAGE", 80.0),
    "processing_latency_ms": ("HIGH_PROCESSING_LATENCY", 30000.0),
    "active_users": ("HIGH_ACTOR_COUNT", 10000.0),
    "consumer_lag": ("HIGH_KAFKA_LAG", 1000.0),
    "users_under_pressure": ("ACTOR_BACKPRESSURE", 10.0),
}
COOLDOWN = timedelta(minutes=5)

#: Breaches of one alert type that one task folds, and ranges whose jump functions one task composes.
FOLD_ROWS, FOLDS = 50_000, 64


def readings(samples: DataFrame) -> DataFrame:
    """Long form ``(alert_type, seq, ts, value, breach)`` of the metrics a table has.

    Values that are not positive are no readings: they neither raise nor clear.
    """
    present = [(m, a, t) for m, (a, t) in THRESHOLDS.items() if m in samples.columns]
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("alert_type"), F.col(m).cast("double").alias("value"), F.lit(t).alias("threshold"))
            for m, a, t in present
        ]
    )
    return (
        samples.select("seq", "ts", F.inline(rows))
        .filter(F.col("value") > 0)
        .withColumn("breach", F.col("value") > F.col("threshold"))
    )


def alert_transitions(
    samples: DataFrame,
    cooldown: timedelta = COOLDOWN,
    fold_rows: int = FOLD_ROWS,
    ranges: int | None = None,
    folds: int = FOLDS,
) -> DataFrame:
    """``(alert_type, seq, ts, value, event)`` for every alert raised or cleared.

    A clear forgets the last alert, so each run of consecutive breaches stands alone. Its first
    breach raises and the reading after it clears: plain windows. Which later breaches raise again
    depends on the alert before, a chain. The breaches of an alert type are cut into ranges of
    ``fold_rows`` rows, however dense they are in time, and one task follows the chains inside a range.
    For runs that cross ranges every range is a jump function: the time an alert may be raised from when
    the range begins -> that time when it ends. Jump functions are composed ``folds`` at a time up a tree,
    and the entry times are handed down it again; no task sees more than one node of the tree.
    """
    r = running(
        readings(samples),
        ["alert_type"],
        [F.col("ts"), F.col("seq")],
        [
            Running("run", F.when(F.col("breach"), 0).otherwise(1).cast("bigint"), "sum", True),
            Running("nth", F.when(F.col("breach"), 1).otherwise(0).cast("bigint"), "sum", False),
            Running("after_breach", F.col("breach"), "lag"),
        ],
        ranges,
    )
    cleared = r.filter(~F.col("breach") & F.col("after_breach")).select(
        "alert_type", "seq", "ts", "value", F.lit("CLEARED").alias("event")
    )
    wait, run = _us(cooldown), ["alert_type", "run"]
    breaches = r.filter("breach").select(
        *run, "seq", "ts", "value", micros(F.col("ts")).alias("us"), F.floor(F.col("nth") / fold_rows).cast("bigint").alias("fold")
    )
    crossing = breaches.groupBy(*run).agg(F.min("fold").alias("lo"), F.max("fold").alias("hi")).filter("lo < hi")
    crossing = fixed(crossing, "crossing-runs")
    jumps = (
        breaches.select(*run, "fold", "us")
        .join(crossing.select(*run), run, "left_semi")
        .groupBy(*run, "fold")
        .applyInPandas(lambda pdf: _jumps(pdf, wait), _JUMPS)
    )
    entries = _entries(fixed(jumps, "jumps"), crossing, wait, folds)
    raised = (
        breaches.join(entries, [*run, "fold"], "left")
        .groupBy("alert_type", "fold")
        .applyInPandas(lambda pdf: _chains(pdf, wait), "alert_type string, seq long, ts timestamp_ntz, value double, event string")
    )
    return raised.unionByName(cleared)


def _entries(jumps: DataFrame, crossing: DataFrame, wait: int, folds: int) -> DataFrame:
    """``(alert_type, run, fold, from_us)``: when each range of a run may raise its first alert."""
    run = ["alert_type", "run"]
    widest = crossing.agg(F.max(F.col("hi") - F.floor(F.col("lo") / folds) * folds + 1)).first()[0] or 0
    levels = [jumps]
    while widest > folds:
        block = levels[-1].withColumn("block", F.floor(F.col("fold") / folds).cast("bigint"))
        levels.append(fixed(block.groupBy(*run, "block").applyInPandas(lambda pdf: _composed(pdf, wait), _JUMPS), "jumps"))
        widest = -(-widest // folds) + 1
    entries = levels.pop().groupBy(*run).applyInPandas(_follow, _ENTRIES)
    while levels:
        start = entries.select(*run, F.col("fold").alias("block"), "from_us")
        block = levels.pop().withColumn("block", F.floor(F.col("fold") / folds).cast("bigint"))
        entries = block.join(start, [*run, "block"]).groupBy(*run, "block").applyInPandas(_follow, _ENTRIES)
    return entries


def _us(delta: timedelta) -> int:
    return int(delta.total_seconds() * 1_000_000)


_JUMPS = "alert_type string, run long, fold long, first_us long, enter_us long, next_us long"
_ENTRIES = "alert_type string, run long, fold long, from_us long"


def _step(enter: np.ndarray, leave: np.ndarray, first: int, wait: int) -> tuple[np.ndarray, np.ndarray]:
    """A jump function in its shortest form: neighbours with the same result are one step.

    An alert before the first row blocks at most ``wait`` from it, so no entry is later than the first step after that.
    """
    n = min(len(enter), int(np.searchsorted(enter, first + wait)) + 1)
    enter, leave = enter[:n], leave[:n]
    keep = np.append(leave[1:] != leave[:-1], True)
    return enter[keep], leave[keep]


def _through(at: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Where times come out of a jump function; times after its last step pass unchanged."""
    i = np.searchsorted(enter, at)
    return np.where(i < len(enter), leave[np.minimum(i, len(enter) - 1)], at)


def _as_rows(pdf: pd.DataFrame, fold: int, first: int, enter: np.ndarray, leave: np.ndarray) -> pd.DataFrame:
    head = {"alert_type": pdf["alert_type"].iloc[0], "run": pdf["run"].iloc[0], "fold": fold, "first_us": first}
    return pd.DataFrame({**head, "enter_us": enter, "next_us": leave})


def _jumps(pdf: pd.DataFrame, wait: int) -> pd.DataFrame:
    """The jump function of one range: for each breach the chain may enter at, when it may raise again after the range."""
    us = np.sort(pdf["us"].to_numpy())
    follows = np.searchsorted(us, us + wait)
    last = np.arange(len(us))
    for i in range(len(us) - 1, -1, -1):
        if follows[i] < len(us):
            last[i] = last[follows[i]]
    first = int(us[0])
    return _as_rows(pdf, int(pdf["fold"].iloc[0]), first, *_step(us, us[last] + wait, first, wait))


def _each(pdf: pd.DataFrame):
    """(fold, first time, steps) of every jump function, in order."""
    for fold, rows in pdf.sort_values(["fold", "enter_us"]).groupby("fold", sort=True):
        yield int(fold), int(rows["first_us"].iloc[0]), rows["enter_us"].to_numpy(), rows["next_us"].to_numpy()


def _composed(pdf: pd.DataFrame, wait: int) -> pd.DataFrame:
    """The jump functions of consecutive ranges as one."""
    start, enter, leave = None, None, None
    for _, first, e, n in _each(pdf):
        if start is None:
            start, enter, leave = first, e, n
            continue
        later = np.searchsorted(e, enter[-1], "right")
        leave = np.append(_through(leave, e, n), n[later:])
        enter, leave = _step(np.append(enter, e[later:]), leave, start, wait)
    return _as_rows(pdf, int(pdf["block"].iloc[0]), start, enter, leave)


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """The earliest alert time each range of a node starts with."""
    at = int(pdf["from_us"].iloc[0]) if "from_us" in pdf else np.iinfo(np.int64).min
    out = []
    for fold, _, enter, leave in _each(pdf):
        out.append((pdf["alert_type"].iloc[0], pdf["run"].iloc[0], fold, at))
        at = int(_through(np.array([at]), enter, leave)[0])
    return pd.DataFrame(out, columns=["alert_type", "run", "fold", "from_us"])


def _chains(pdf: pd.DataFrame, wait: int) -> pd.DataFrame:
    """Alerts of all runs in one range. A run starts at its first breach unless told a later time."""
    rows = pdf.sort_values(["run", "us", "seq"], ignore_index=True)
    us, run = rows["us"].to_numpy(), rows["run"].to_numpy()
    low = np.iinfo(np.int64).min
    start = rows["from_us"].astype("Int64").fillna(low).to_numpy("int64")
    bounds = np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), len(run))
    picked: list[int] = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        mine = us[lo:hi]
        i = int(np.searchsorted(mine, start[lo]))
        while i < len(mine):
            picked.append(lo + i)
            i = int(np.searchsorted(mine, mine[i] + wait))
    return rows.loc[picked, ["alert_type", "seq", "ts", "value"]].assign(event="RAISED")


def alert_counts(transitions: DataFrame) -> DataFrame:
    """Alerts raised and cleared per type, and whether one is still open."""
    raised, cleared = F.col("event") == "RAISED", F.col("event") == "CLEARED"
    return transitions.groupBy("alert_type").agg(
        F.count_if(raised).alias("raised"),
        F.count_if(cleared).alias("cleared"),
        (F.max_by("event", F.struct("ts", "seq")) == "RAISED").alias("is_active"),
    )
