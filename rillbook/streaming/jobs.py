"""Structured Streaming jobs. Each takes a streaming table and returns one, or starts a query.

Positions, state and output lists live in the checkpoint folder: a query started again on the same
folder goes on where the last one stopped. There is no restart loop here; a supervisor starts the job
again, Spark does the rest.
"""

from __future__ import annotations

from datetime import timedelta
from typing import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from rillbook.operators import alerts, ingest
from rillbook.operators.quality import base_valid
from rillbook.operators.state import contact_feed
from rillbook.schemas import ENGAGEMENT_COUNTERS
from rillbook.sources.sinks import addressed, kafka_sink_options, with_outcome
from rillbook.sources.storage import write_batch
from rillbook.streaming import processors as proc

#: Process what is there and stop; use ``{"processingTime": "10 seconds"}`` for an endless job.
DRAIN = {"availableNow": True}


# --------------------------------------------------------------------- lifecycle


def start_table(stream: DataFrame, path: str, checkpoint: str, trigger: dict = DRAIN, by: tuple[str, ...] = (), mode: str = "append") -> StreamingQuery:
    """Append a stream to a Parquet table; every row is there once, also after a restart."""
    writer = stream.writeStream.format("parquet").outputMode(mode).trigger(**trigger)
    if by:
        writer = writer.partitionBy(*by)
    return writer.option("path", path).option("checkpointLocation", checkpoint).start()


def start_batches(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict = DRAIN, mode: str = "append") -> StreamingQuery:
    """Give each micro-batch to ``handler``; it must overwrite what an earlier try of the batch wrote."""
    writer = stream.writeStream.foreachBatch(handler).outputMode(mode).trigger(**trigger)
    return writer.option("checkpointLocation", checkpoint).start()


def finish(query: StreamingQuery) -> StreamingQuery:
    """Wait for a draining query; an error in it is raised here."""
    query.awaitTermination()
    return query


def status(query: StreamingQuery) -> dict:
    """Is it running, what did the last micro-batch do."""
    last = query.lastProgress or {}
    return {
        "id": str(query.id),
        "is_active": query.isActive,
        "message": query.status.get("message"),
        "batch_id": last.get("batchId"),
        "input_rows": last.get("numInputRows"),
        "rows_per_second": last.get("processedRowsPerSecond"),
    }


# ------------------------------------------------------------------------ ingest


def decoded(raw: DataFrame) -> DataFrame:
    """Typed rows and set-aside rows in one stream, told apart by ``outcome``.

    One pass over the source, one output: written with ``by=("outcome",)`` the good rows and the
    quarantine are two folders of one table that cannot disagree.
    """
    outcome = F.when(F.col("reason").isNull(), "accepted").otherwise("quarantined")
    return ingest.parse_user_messages(raw).withColumn("outcome", outcome)


def decoded_json(raw: DataFrame) -> DataFrame:
    outcome = F.when(F.col("reason").isNull(), "accepted").otherwise("quarantined")
    return ingest.parse_json(raw).withColumn("outcome", outcome)


# ------------------------------------------------------------------- state folds


def user_type_fold(events: DataFrame) -> DataFrame:
    """Counts per user and type; in update mode every batch carries the rows it changed."""
    return (
        events.filter(F.col("user_id").isNotNull() & F.col("event_type").isNotNull())
        .groupBy("user_id", "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )


def latest_update(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each key among all written batches."""
    rest = [c for c in updates.columns if c not in keys and c != "batch_id"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("u")).select(*keys, "u.*")


#: How long an endless job remembers a user's newest time.
SEQUENCE_TTL = timedelta(hours=24)


def sequence_labels(events: DataFrame, max_late_ms: int, ttl: timedelta | None = None) -> DataFrame:
    """Lateness label of every event, with the newest time per user kept as state.

    Rows without a user need no state; they are spread over many keys. ``ttl`` is for endless jobs
    (:data:`SEQUENCE_TTL`): state that expires by the clock makes a query run batches for ever, so a
    draining job must leave it out.
    """
    key = F.coalesce("user_id", F.concat(F.lit("\0"), F.pmod(F.col("seq"), F.lit(256)).cast("string")))
    rows = events.select("seq", "event_id", "user_id", "event_type", "ts_us", "arrival_us", key.alias("state_key"))
    p = proc.SequenceLabels(max_late_ms, None if ttl is None else int(ttl.total_seconds() * 1000))
    mode = "None" if ttl is None else "ProcessingTime"
    return rows.groupBy("state_key").transformWithStateInPandas(p, p.columns, "append", mode)


def channel_updates(events: DataFrame) -> DataFrame:
    """One aggregation update per engagement event."""
    rows = events.filter(base_valid() & F.col("event_type").isin(list(ENGAGEMENT_COUNTERS))).select(
        "seq", "event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")
    )
    p = proc.RunningChannelCounts()
    return rows.groupBy("user_id").transformWithStateInPandas(p, p.columns, "append", "None")


def write_feeds(path: str) -> Callable[[DataFrame, int], None]:
    """Handler that sends each update to both feeds."""

    def handler(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            write_batch(batch, f"{path}/aggregation-updates", batch_id)
            write_batch(contact_feed(batch), f"{path}/contact-notifications", batch_id)
        finally:
            batch.unpersist()

    return handler


def write_by(path: str, label: str) -> Callable[[DataFrame, int], None]:
    """Handler that writes a batch below one folder per value of ``label``."""

    def handler(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(label).parquet(f"{path}/batch_id={batch_id}")

    return handler


def write_results(path: str) -> Callable[[DataFrame, int], None]:
    """Handler that stores processed rows in one table, failed and retried ones in another."""

    def handler(batch: DataFrame, batch_id: int) -> None:
        results = with_outcome(batch).persist()
        ok = F.col("status") == "SUCCESS"
        try:
            write_batch(results.filter(ok), f"{path}/processed", batch_id)
            write_batch(results.filter(~ok), f"{path}/failed", batch_id)
        finally:
            results.unpersist()

    return handler


def start_topics(records: DataFrame, servers: str, checkpoint: str, trigger: dict = DRAIN) -> StreamingQuery:
    """Send ``(topic, key, value)`` rows to a broker. Rows without a topic go to the one for unrouted rows."""
    rows = addressed(records).select("topic", "key", "value")
    writer = rows.writeStream.format("kafka").options(**kafka_sink_options(servers)).trigger(**trigger)
    return writer.option("checkpointLocation", checkpoint).start()


def write_updates(path: str) -> Callable[[DataFrame, int], None]:
    def handler(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return handler


def user_positions(events: DataFrame) -> DataFrame:
    """Events of a user numbered in source order."""
    rows = events.select("user_id", "offset", "event_type")
    p = proc.Positions()
    return rows.groupBy("user_id").transformWithStateInPandas(p, p.columns, "append", "None")


def alert_stream(samples: DataFrame, cooldown: timedelta = alerts.COOLDOWN) -> DataFrame:
    rows = alerts.readings(samples).select("alert_type", "seq", F.col("ts").cast("timestamp").alias("ts"), "value", "breach")
    p = proc.AlertState(int(cooldown.total_seconds() * 1_000_000))
    return rows.groupBy("alert_type").transformWithStateInPandas(p, p.columns, "append", "None")


def idle_users(events: DataFrame, timeout: timedelta = timedelta(minutes=30), delay: str = "0 seconds") -> DataFrame:
    rows = events.filter(base_valid()).select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    p = proc.IdleUsers(int(timeout.total_seconds() * 1000))
    return rows.groupBy("user_id").transformWithStateInPandas(p, p.columns, "append", "EventTime")


# ----------------------------------------------------------------------- windows


def windowed_counts(events: DataFrame, size: str, delay: str = "10 minutes") -> DataFrame:
    """Events per tumbling window; in append mode a window appears once it can no longer change."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", size))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("window_start"),
            F.col("window.end").cast("timestamp_ntz").alias("window_end"),
            "events",
        )
    )


def recent_minutes(events: DataFrame) -> DataFrame:
    """Events per minute; minutes older than an hour leave the state."""
    return windowed_counts(events, "1 minute", "1 hour")
