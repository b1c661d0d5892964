"""The continuous pipeline: one streaming query from raw messages to five tables.

Messages are decoded by form, put in the order of their receive times per user, labelled, numbered and
folded per user, and written batch by batch: processed events, the journal, state by user and type, failed
and retried messages, and messages that came behind the watermark. One pass over the source, two keyed
operators in a row, one sink.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rillbook.operators.ingest import decode_message
from rillbook.operators.journal import persistence_id
from rillbook.sources.storage import read_batches, write_batch
from rillbook.streaming.jobs import DRAIN, start_batches

#: Topic of rows that carry no message: they only tell that time goes on, so that the last messages leave the buffer.
HEARTBEAT = "heartbeat"
#: Broken messages that may come whole when they are read again.
RETRIED = ("bad_json",)
#: Unusable messages need no state; they are spread over so many keys. Every key costs a few calls per micro-batch.
SPREAD = 256
#: Users are dealt over so many keys, as a key costs some milliseconds per micro-batch however few rows it has.
#: A checkpoint must be gone on with by the same number.
KEYS = 256

_PLACE = ["received_us", "topic", "partition", "offset"]
_TYPES = {
    "flow_key": "string", "topic": "string", "partition": "int", "offset": "bigint", "received_us": "bigint", "form": "string", "event_id": "string", "user_id": "string",
    "event_type": "string", "contact_id": "bigint", "ts_us": "bigint", "value": "string", "reason": "string",
}
_EVENT = ", ".join(f"{c} {kind}" for c, kind in _TYPES.items())
#: Between the two operators contact ids are texts: whole numbers with gaps come to pandas as floats.
_CARRIED = ", ".join(f"{c} {'string' if c == 'contact_id' else kind}" for c, kind in _TYPES.items())
_NAMES = list(_TYPES)
_WHOLE = ("partition", "offset", "received_us", "ts_us")
_HELD = pa.schema([(c, pa.int64() if c in _WHOLE else pa.string()) for c in _NAMES])
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _packed(frame: pd.DataFrame) -> bytes:
    """Rows as one value of the state store."""
    table = pa.Table.from_pandas(frame, schema=_HELD, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_all().to_pandas()


class ReceiveOrder(StatefulProcessor):
    """Hold messages of a key until the watermark has passed their receive time, then hand them on in order.

    The order is (receive time, topic, partition, offset). A key holds many users' messages, those that came
    together as one value. One timer per key stands at the earliest held message. Messages behind the watermark
    are handed on at once, marked ``behind``; unusable ones are not held.
    """

    columns = _CARRIED + ", at timestamp, behind boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.timer = handle.getValueState("timer", "ms bigint")

    def _out(self, rows: pd.DataFrame, behind: bool, passed: int) -> pd.DataFrame:
        """``at`` is when a message is handed on, always behind the watermark: the next operator trusts in that."""
        out = rows[_NAMES].astype({c: "Int64" for c in _WHOLE})
        at = pd.to_datetime(out["received_us"].fillna(passed + 1000).clip(lower=passed + 1000).astype("int64"), unit="us")
        return out.assign(at=at, behind=behind)

    def _wake(self, ms: int | None) -> None:
        """Have exactly one timer, at ``ms``."""
        state = self.timer.get()
        old = None if state is None else state[0]
        if old == ms:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if ms is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        state = self.timer.get()
        first = None if state is None else state[0]
        for pdf in rows:
            at_once = pdf["reason"].notna()
            behind = ~at_once & (pdf["received_us"] < passed)
            yield self._out(pdf[at_once], False, passed)
            if behind.any():
                yield self._out(pdf[behind], True, passed)
            wait = pdf[~at_once & ~behind]
            if len(wait):
                self.held.appendValue((_packed(wait),))
                ms = int(wait["received_us"].min()) // 1000 + 1
                first = ms if first is None else min(first, ms)
        self._wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        held = pd.concat([_unpacked(value) for (value,) in self.held.get()], ignore_index=True)
        go = held["received_us"] < passed
        stay = held[~go]
        self.held.clear()
        if len(stay):
            self.held.appendValue((_packed(stay),))
            ms = int(stay["received_us"].min()) // 1000 + 1
            self.handle.registerTimer(ms)
            self.timer.update((ms,))
        yield self._out(held[go].sort_values(_PLACE, ignore_index=True), False, passed)

    def close(self) -> None:
        pass


class UserFlow(StatefulProcessor):
    """Label, number and count the events of each user of a key in the order they are handed on.

    ``label`` compares the event time with the newest one before it; ``sequence_nr`` counts the user's events;
    ``n``, ``first_us`` and ``last_us`` are the state of (user, type) after the event. State is read and written
    once per user that has events in the micro-batch.
    """

    columns = _EVENT + ", behind boolean, label string, late_ms bigint, sequence_nr bigint, n bigint, first_us bigint, last_us bigint"
    names = [*_NAMES, "behind", "label", "late_ms", "sequence_nr", "n", "first_us", "last_us"]

    def __init__(self, max_late_ms: int):
        self.max_late_ms = max_late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        types = "types array<string>, n array<bigint>, first_us array<bigint>, last_us array<bigint>"
        self.users = handle.getMapState("users", "user_id string", f"newest_us bigint, sequence_nr bigint, {types}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        counted = pdf["reason"].isna() & ~pdf["behind"]
        if not counted.all():
            yield self._out(pdf[~counted], label=None, late_ms=pd.NA, sequence_nr=pd.NA, n=pd.NA, first_us=pd.NA, last_us=pd.NA)
        if counted.any():
            yield self._counted(pdf[counted])

    def _counted(self, pdf: pd.DataFrame) -> pd.DataFrame:
        codes, users = pd.factorize(pdf["user_id"])
        pdf = pdf.assign(user=codes).sort_values(["user", *_PLACE], ignore_index=True)
        user, us = pdf["user"].to_numpy(), pdf["ts_us"].astype("int64")
        states = [self.users.getValue((u,)) for u in users]
        newest = np.array([_LOW if s is None else s[0] for s in states], np.int64)
        number = np.array([0 if s is None else s[1] for s in states], np.int64)
        top = us.groupby(user).cummax().to_numpy()
        first = np.append(True, user[1:] != user[:-1])
        seen = np.maximum(np.where(first, _LOW, np.roll(top, 1)), newest[user])
        late = seen > us.to_numpy()
        late_ms = np.where(late, (seen - np.where(late, us, seen)) // 1000, -1)
        nr = number[user] + pdf.groupby("user").cumcount().to_numpy() + 1

        # What was counted before of each (user, type) that has events now.
        kind, kinds = pd.factorize(pdf["event_type"])
        pairs, pair = np.unique(user * np.int64(len(kinds)) + kind, return_inverse=True)
        held = [{} if s is None else {t: tuple(x) for t, *x in zip(*s[2:])} for s in states]
        was = [held[p // len(kinds)].get(kinds[p % len(kinds)], (0, _HIGH, _LOW)) for p in pairs.tolist()]
        n0, first0, last0 = np.array(was, np.int64).T
        by = us.groupby(pair)
        n = n0[pair] + by.cumcount().to_numpy() + 1
        first_us = np.minimum(first0[pair], by.cummin().to_numpy())
        last_us = np.maximum(last0[pair], by.cummax().to_numpy())

        end = np.zeros(len(pairs), np.int64)
        end[pair] = np.arange(len(pair))
        for p, i in zip(pairs.tolist(), end.tolist()):
            held[p // len(kinds)][kinds[p % len(kinds)]] = (int(n[i]), int(first_us[i]), int(last_us[i]))
        for i in np.flatnonzero(np.append(user[1:] != user[:-1], True)).tolist():
            u = user[i]
            counts = [list(x) for x in zip(*[(t, *x) for t, x in held[u].items()])]
            self.users.updateValue((users[u],), (int(max(newest[u], top[i])), int(nr[i]), *counts))
        label = np.where(late_ms > self.max_late_ms, "INVALID", np.where(late, "WARNING", "VALID"))
        return self._out(pdf, label=label, late_ms=pd.arrays.IntegerArray(late_ms, ~late), sequence_nr=nr, n=n, first_us=first_us, last_us=last_us)

    def _out(self, pdf: pd.DataFrame, **more) -> pd.DataFrame:
        contact = pd.array([pd.NA if pd.isna(x) else int(x) for x in pdf["contact_id"]], "Int64")
        out = pdf.assign(contact_id=contact, **more)
        whole = (*_WHOLE, "late_ms", "sequence_nr", "n", "first_us", "last_us")
        return out[self.names].astype({c: "Int64" for c in whole})

    def close(self) -> None:
        pass


def received_order(raw: DataFrame, delay: timedelta = timedelta(minutes=15), spread: int = SPREAD, keys: int = KEYS) -> DataFrame:
    """Decoded messages, those of a user in the order of their receive times.

    ``raw`` has the broker's columns and ``received``. A message is handed on once messages ``delay`` younger have come.
    The watermark only moves time on: it lies on a column of its own, so that no message is left out for being behind it.
    """
    rows = raw.withWatermark("received", f"{int(delay.total_seconds() * 1000)} milliseconds")
    # The second half keeps the planner from moving the filter in front of the watermark.
    rows = decode_message(rows.filter(~F.col("topic").eqNullSafe(HEARTBEAT) | F.col("received").isNull()))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("received").isNull(), "missing_receive_time")))
    other = F.concat(F.lit("\0"), F.pmod(F.hash("topic", "partition", "offset"), F.lit(spread)).cast("string"))
    mine = F.concat(F.lit("u"), F.pmod(F.hash("user_id"), F.lit(keys)).cast("string"))
    rows = rows.select(
        F.when(F.col("reason").isNull(), mine).otherwise(other).alias("flow_key"),
        "topic", "partition", "offset", F.unix_micros("received").alias("received_us"), "form", "event_id", "user_id", "event_type",
        F.col("contact_id").cast("string").alias("contact_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "value", "reason",
    )
    p = ReceiveOrder()
    return rows.groupBy("flow_key").transformWithStateInPandas(p, p.columns, "append", "EventTime", eventTimeColumnName="at")


def processed(raw: DataFrame, max_late_ms: int, delay: timedelta = timedelta(minutes=15), spread: int = SPREAD, keys: int = KEYS) -> DataFrame:
    """Every message once with ``outcome``: SUCCESS, RETRY, FAILED or BEHIND (the watermark)."""
    p = UserFlow(max_late_ms)
    rows = received_order(raw, delay, spread, keys).drop("at").groupBy("flow_key").transformWithStateInPandas(p, p.columns, "append", "None")
    outcome = (
        F.when(F.col("behind"), "BEHIND").when(F.col("reason").isNull(), "SUCCESS")
        .when(F.col("reason").isin(*RETRIED), "RETRY").otherwise("FAILED")
    )
    return rows.withColumn("outcome", outcome)


#: Tables of the pipeline below its folder.
TABLES = ("success", "journal", "state", "failed", "retry", "behind")
_TIMES = {"ts": "ts_us", "received": "received_us", "first_ts": "first_us", "last_ts": "last_us"}


def _times(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.timestamp_micros(v).cast("timestamp_ntz") for k, v in _TIMES.items()})


def table_of(batch: DataFrame, name: str) -> DataFrame:
    """The rows of one micro-batch that belong in one of :data:`TABLES`."""
    rows, ok = _times(batch), F.col("outcome") == "SUCCESS"
    message = ["topic", "partition", "offset", "received", "form", "value"]
    event = ["topic", "partition", "offset", "received", "form", "event_id", "user_id", "event_type", "contact_id", "ts"]
    if name == "success":
        return rows.filter(ok).select(*event, "label", "late_ms", "sequence_nr")
    if name == "journal":
        return rows.filter(ok).select(persistence_id(F.col("user_id")).alias("persistence_id"), "sequence_nr", "event_type", F.col("value").alias("event_data"), "ts", F.col("offset").alias("seq"))
    if name == "state":
        # Of a (user, type) changed several times in a batch, what it is in the end.
        last = rows.filter(ok).groupBy("user_id", "event_type").agg(F.max("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
        return last
    if name == "behind":
        return rows.filter(F.col("outcome") == "BEHIND").select(*event)
    return rows.filter(F.col("outcome") == name.upper()).select(*message, "reason", *([F.lit(1).alias("attempt")] if name == "retry" else []))


def write_tables(path: str) -> Callable[[DataFrame, int], None]:
    """Handler that writes all tables of a batch; a batch that is repeated replaces its own folders."""

    def handler(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name in TABLES:
                write_batch(table_of(batch, name), f"{path}/{name}", batch_id)
        finally:
            batch.unpersist()

    return handler


def start_pipeline(raw: DataFrame, path: str, checkpoint: str, max_late_ms: int, delay: timedelta = timedelta(minutes=15), trigger: dict = DRAIN, spread: int = SPREAD, keys: int = KEYS) -> StreamingQuery:
    """One query from raw messages to :data:`TABLES` below ``path``; started again it goes on where it stopped."""
    return start_batches(processed(raw, max_late_ms, delay, spread, keys), write_tables(path), checkpoint, trigger)


def pipeline_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of the pipeline with ``batch_id``."""
    kinds = UserFlow.columns + ", outcome string"
    return read_batches(spark, f"{path}/{name}", table_of(spark.createDataFrame([], kinds), name).schema)


def current_state(spark: SparkSession, path: str) -> DataFrame:
    """State by user and type. Counts only grow, times only widen, so the newest version needs no order."""
    rows = pipeline_table(spark, path, "state")
    return rows.groupBy("user_id", "event_type").agg(F.max("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
