"""Keyed state functions, used only where built-in streaming aggregates cannot say it.

Each call sees the rows of one key in one micro-batch; its size is bounded by the intake limit of the
source. Rows are sorted inside the call, so arrival order within a batch does not matter.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _rows(chunks: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(chunks), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


class SequenceLabels(StatefulProcessor):
    """Label rows by lateness against the newest time seen of their user.

    With ``ttl_ms`` the remembered time expires when no newer event came for that long.
    """

    columns = "seq bigint, event_id string, user_id string, event_type string, ts_us bigint, arrival_us bigint, last_us bigint, late_ms bigint, label string"

    def __init__(self, max_late_ms: int, ttl_ms: int | None = None):
        self.max_late_ms = max_late_ms
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "us bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["arrival_us", "seq"])
        usable = (pdf["ts_us"].notna() & pdf["user_id"].notna()).to_numpy()
        low = np.iinfo(np.int64).min
        us = pdf["ts_us"].fillna(low).astype("int64").to_numpy()
        us = np.where(usable, us, low)
        state = self.newest.get()
        before = low if state is None else state[0]
        seen = np.maximum.accumulate(np.concatenate([[before], us]))
        last, newest = seen[:-1], int(seen[-1])
        late = usable & (last > us)
        late_ms = np.where(late, (last - np.where(late, us, last)) // 1000, -1)
        label = np.where(~usable | (late_ms > self.max_late_ms), "INVALID", np.where(late, "WARNING", "VALID"))
        out = pdf[["seq", "event_id", "user_id", "event_type", "ts_us", "arrival_us"]].copy()
        out["last_us"] = pd.array(last, dtype="Int64")
        out.loc[~usable | (last == low), "last_us"] = pd.NA
        out["late_ms"] = pd.array(late_ms, dtype="Int64")
        out.loc[~late, "late_ms"] = pd.NA
        out["label"] = label
        out["ts_us"] = out["ts_us"].astype("Int64")
        if newest != before:
            self.newest.update((newest,))
        yield out

    def close(self) -> None:
        pass


class RunningChannelCounts(StatefulProcessor):
    """Channel counts of a user after each of its events."""

    columns = (
        "user_id string, email_count bigint, sms_count bigint, call_count bigint, "
        "last_updated timestamp, trigger_event_type string, trigger_event_id string"
    )

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "email bigint, sms bigint, call bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["ts", "seq"])
        base = self.counts.get() or (0, 0, 0)
        out = pd.DataFrame({"user_id": pdf["user_id"]})
        totals = []
        for i, (name, prefix) in enumerate((("email_count", "EMAIL_"), ("sms_count", "SMS_"), ("call_count", "CALL_"))):
            out[name] = pdf["event_type"].str.startswith(prefix).astype("int64").cumsum() + base[i]
            totals.append(int(out[name].iloc[-1]))
        out["last_updated"] = pdf["ts"]
        out["trigger_event_type"] = pdf["event_type"]
        out["trigger_event_id"] = pdf["event_id"]
        self.counts.update(tuple(totals))
        yield out

    def close(self) -> None:
        pass


class Positions(StatefulProcessor):
    """Number the rows of a key in offset order, continuing over micro-batches."""

    columns = "user_id string, offset bigint, event_type string, position bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["offset"])
        state = self.n.get()
        base = 0 if state is None else state[0]
        self.n.update((base + len(pdf),))
        yield pdf[["user_id", "offset", "event_type"]].assign(position=np.arange(1, len(pdf) + 1) + base)

    def close(self) -> None:
        pass


class AlertState(StatefulProcessor):
    """Raise above the threshold, stay silent during the cooldown, clear below."""

    columns = "alert_type string, seq bigint, ts timestamp, value double, event string"

    def __init__(self, cooldown_us: int):
        self.cooldown_us = cooldown_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_alert", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Only the columns needed, as plain arrays: an alert type is one key, however many readings it has.
        parts = [(c["ts"].to_numpy("datetime64[us]"), c["seq"].to_numpy(), c["value"].to_numpy(), c["breach"].to_numpy(bool)) for c in rows]
        ts, seq, value, breaches = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((seq, ts))
        us = ts.astype("int64")
        state = self.last.get()
        last = None if state is None else state[0]
        picked: list[int] = []
        events: list[str] = []
        for i, at, breach in zip(order.tolist(), us[order].tolist(), breaches[order].tolist()):
            if breach:
                if last is None or at - last >= self.cooldown_us:
                    last = at
                    picked.append(i)
                    events.append("RAISED")
            elif last is not None:
                last = None
                picked.append(i)
                events.append("CLEARED")
        if last is None:
            self.last.clear()
        else:
            self.last.update((last,))
        yield pd.DataFrame({"alert_type": key[0], "seq": seq[picked], "ts": ts[picked].astype("datetime64[ns]"), "value": value[picked], "event": events})

    def close(self) -> None:
        pass


class IdleUsers(StatefulProcessor):
    """Report a user once nothing came for the timeout, then forget it. Every event restarts the wait."""

    columns = "user_id string, last_ts timestamp, events bigint"

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "last_us bigint, n bigint, timer_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        newest = int(pdf["ts"].max().value // 1000)
        state = self.state.get()
        n = len(pdf)
        if state is not None:
            newest, n = max(newest, state[0]), n + state[1]
            self.handle.deleteTimer(state[2])
        timer = newest // 1000 + self.timeout_ms
        self.handle.registerTimer(timer)
        self.state.update((newest, n, timer))
        yield pd.DataFrame({"user_id": pd.Series(dtype="str"), "last_ts": pd.Series(dtype="datetime64[ns]"), "events": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last_us, n, _ = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"user_id": [key[0]], "last_ts": [pd.Timestamp(last_us, unit="us")], "events": [n]})

    def close(self) -> None:
        pass
