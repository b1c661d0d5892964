"""Outgoing records: topic, key and value, and tables split by outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rillbook.operators.ingest import natural_key
from rillbook.operators.monitoring import retry_plan
from rillbook.operators.quality import base_valid

#: Where rows go that no topic takes; nothing is dropped on the way out.
UNROUTED = "unrouted-events"
TOPICS = {"EMAIL": "email-events", "SMS": "sms-events", "CALL": "call-events"}
ROUTES = {
    "EMAIL_OPEN": "EMAIL", "EMAIL_CLICK": "EMAIL",
    "SMS_REPLY": "SMS", "SMS_DELIVERY": "SMS",
    "CALL_COMPLETED": "CALL", "CALL_MISSED": "CALL",
}


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def as_json(**fields: Column) -> Column:
    """A JSON object with the given fields, empty ones written as null."""
    return F.to_json(F.struct(*[col.alias(name) for name, col in fields.items()]), {"ignoreNullFields": "false"})


def routed(events: DataFrame, topics: dict[str, str] | None = None) -> DataFrame:
    """Topic by event type, key by user, JSON value. Rows no topic takes carry a reason instead."""
    topics = topics or TOPICS
    topic = F.lit(None).cast("string")
    for event_type, channel in ROUTES.items():
        topic = F.when(F.col("event_type") == event_type, F.lit(topics[channel])).otherwise(topic)
    value = as_json(
        userId=F.col("user_id"), eventId=F.col("event_id"), eventType=F.col("event_type"), timestamp=iso_time(F.col("ts"))
    )
    valid = base_valid()
    return events.select(
        F.when(valid, topic).alias("topic"),
        F.col("user_id").alias("key"),
        value.alias("value"),
        F.when(~valid, "invalid_event").when(topic.isNull(), "no_topic").alias("reason"),
    )


def keyed_text(events: DataFrame, topic: str) -> DataFrame:
    """Key ``user:type:contact`` and the flat event as JSON."""
    value = as_json(
        userId=F.col("user_id"), eventType=F.col("event_type"), contactId=F.col("contact_id"), timestamp=iso_time(F.col("ts"))
    )
    key = natural_key(F.col("user_id"), F.col("event_type"), F.col("contact_id"))
    return events.select(F.lit(topic).alias("topic"), key.alias("key"), value.alias("value"))


def addressed(records: DataFrame) -> DataFrame:
    """Every row with a topic; those without one get :data:`UNROUTED`."""
    return records.withColumn("topic", F.coalesce("topic", F.lit(UNROUTED)))


def write_topics(records: DataFrame, path: str) -> None:
    """File form of the topic sink: one folder per topic, also for rows that none takes."""
    addressed(records).write.mode("overwrite").partitionBy("topic").parquet(path)


def kafka_sink_options(servers: str) -> dict[str, str]:
    """Options of ``df.write.format("kafka")``; key and value carry user affinity to the partition."""
    return {"kafka.bootstrap.servers": servers, "kafka.acks": "all"}


def write_topics_kafka(records: DataFrame, servers: str) -> None:
    rows = addressed(records).select("topic", "key", "value")
    rows.write.format("kafka").options(**kafka_sink_options(servers)).save()


def with_outcome(log: DataFrame) -> DataFrame:
    """SUCCESS, RETRY (a failure with attempts left that may pass next time) or FAILED."""
    planned = retry_plan(log)
    again = F.col("is_retryable") & (F.col("attempt") < 3)
    return planned.withColumn("status", F.when(F.col("ok"), "SUCCESS").when(again, "RETRY").otherwise("FAILED"))


def split_results(results: DataFrame, path: str) -> None:
    """Processed rows to one table, failed and retried ones to another."""
    ok = F.col("status") == "SUCCESS"
    results.filter(ok).write.mode("overwrite").parquet(f"{path}/processed")
    results.filter(~ok).write.mode("overwrite").parquet(f"{path}/failed")
