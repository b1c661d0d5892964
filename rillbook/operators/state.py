"""Per-user state: counts by type, engagement counters, rates, flags and feeds of changes."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from rillbook.functions.clock import as_of as clock, span
from rillbook.functions.text import ratio
from rillbook.operators.ordered import Running, running
from rillbook.operators.quality import base_valid
from rillbook.schemas import CONTACTABLE_STATUSES, DEFAULT_CONTACTABLE, ENGAGEMENT_COUNTERS


def countable(events: DataFrame) -> DataFrame:
    """Rows with a user and a type; others never change a user's state."""
    return events.filter(F.col("user_id").isNotNull() & F.col("event_type").isNotNull())


def user_type_counts(events: DataFrame) -> DataFrame:
    """``(user_id, event_type, n, first_ts, last_ts)``: the long form of every user's state.

    This is also the partial that :func:`merge_states` adds up. A missing time is counted but does
    not move first or last.
    """
    return countable(events).groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def user_state(type_counts: DataFrame) -> DataFrame:
    """One row per user from the long form."""
    return type_counts.groupBy("user_id").agg(
        F.sum("n").alias("total_events"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )


def merge_states(*partials: DataFrame) -> DataFrame:
    """Add up long-form states of disjoint sets of events."""
    both = partials[0]
    for p in partials[1:]:
        both = both.unionByName(p)
    return both.groupBy("user_id", "event_type").agg(
        F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )


def join_history(history: DataFrame, current: DataFrame) -> DataFrame:
    """History and current totals side by side per user, users of either side included.

    Both inputs are one row per user, so the join has no hot key.
    """
    h = history.select("user_id", F.col("total_events").alias("history_events"), F.col("last_ts").alias("history_last"))
    c = current.select("user_id", F.col("total_events").alias("current_events"), F.col("last_ts").alias("current_last"))
    return h.join(c, "user_id", "full_outer").select(
        "user_id",
        F.coalesce("history_events", F.lit(0)).alias("history_events"),
        F.coalesce("current_events", F.lit(0)).alias("current_events"),
        (F.coalesce("history_events", F.lit(0)) + F.coalesce("current_events", F.lit(0))).alias("total_events"),
        F.greatest("history_last", "current_last").alias("last_ts"),
    )


# ------------------------------------------------------------------- engagement


def user_engagement(events: DataFrame) -> DataFrame:
    """Six counters and the last engagement per user with at least one valid event."""
    counters = [F.count_if(F.col("event_type") == t).alias(c) for t, c in ENGAGEMENT_COUNTERS.items()]
    engaged = F.when(F.col("event_type").isin(list(ENGAGEMENT_COUNTERS)), F.col("ts"))
    return events.filter(base_valid()).groupBy("user_id").agg(*counters, F.max(engaged).alias("last_activity"))


def with_rates(engagement: DataFrame) -> DataFrame:
    """Rates and channel totals.

    ``email_open_rate`` divides opens by SMS deliveries, as its definition says, and may exceed 1.
    """
    c = F.col
    return engagement.withColumns(
        {
            "email_open_rate": ratio(c("email_opens"), c("sms_deliveries")),
            "sms_response_rate": ratio(c("sms_replies"), c("sms_deliveries")),
            "call_completion_rate": ratio(c("calls_completed"), c("calls_completed") + c("calls_missed")),
            "email_count": c("email_opens") + c("email_clicks"),
            "sms_count": c("sms_replies") + c("sms_deliveries"),
            "call_count": c("calls_completed") + c("calls_missed"),
        }
    ).withColumn("total_events", c("email_count") + c("sms_count") + c("call_count"))


def open_rate_by_delivery(events: DataFrame) -> DataFrame:
    """Opens divided by e-mail deliveries, next to the rate by its original definition."""
    opens = F.count_if(F.col("event_type") == "EMAIL_OPEN")
    delivered = F.count_if(F.col("event_type") == "EMAIL_DELIVERY")
    return events.filter(base_valid()).groupBy("user_id").agg(ratio(opens, delivered).alias("email_open_rate_by_delivery"))


def with_flags(rates: DataFrame, as_of: Column) -> DataFrame:
    c = F.col
    return rates.withColumns(
        {
            "recently_active": F.coalesce(c("last_activity") > as_of - span(timedelta(days=7)), F.lit(False)),
            "high_engagement": (c("email_open_rate") > 0.7) | (c("sms_response_rate") > 0.5) | (c("call_completion_rate") > 0.8),
            "hot_user": c("total_events") > 10,
        }
    )


def engagement_report(events: DataFrame, as_of=None) -> DataFrame:
    """Counters, rates and flags of every user: the read model of the engagement questions."""
    return with_flags(with_rates(user_engagement(events)), clock(events, as_of))


def read_model(engagement: DataFrame) -> DataFrame:
    """Storage form: rates as DECIMAL(5,4), NULL where a rate does not fit."""
    dec = {r: F.round(F.col(r), 4).try_cast("decimal(5,4)") for r in ("email_open_rate", "sms_response_rate", "call_completion_rate")}
    return with_rates(engagement).withColumns(dec).select(
        "user_id", *ENGAGEMENT_COUNTERS.values(), "last_activity", *dec,
        F.lit(DEFAULT_CONTACTABLE).alias("contactable_status"),
        F.lit(None).cast("string").alias("current_graph_node"),
        F.lit(None).cast("timestamp_ntz").alias("last_processing"),
        F.lit(0).cast("bigint").alias("processing_count"),
    )


# -------------------------------------------------------------------- statistics


def totals(type_counts: DataFrame) -> DataFrame:
    """Users, events and events per user over everything."""
    users = F.count(F.lit(1))
    events = F.coalesce(F.sum("total_events"), F.lit(0))
    return user_state(type_counts).agg(
        users.alias("total_users"), events.alias("total_events"), ratio(events, users).alias("avg_events_per_user")
    )


def recent_stats(events: DataFrame, as_of: Column, latest: int = 100) -> DataFrame:
    """Total, last activity and events of the last hour among the newest ``latest``.

    The newest events are those with the greatest times, so the events of the last hour among them
    are all events of the last hour, at most ``latest``: a plain aggregate, no per-user sort.
    """
    recent = F.count_if(F.col("ts") > as_of - span(timedelta(hours=1)))
    return events.filter(base_valid()).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.max("ts").alias("last_activity"),
        F.least(recent, F.lit(latest).cast("bigint")).alias("recent_events"),
    )


def count_changes(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """Previous and new count per user and type, one row per event; events without a time come first."""
    rows = countable(events).select("seq", "user_id", "event_type", "ts")
    out = running(
        rows, ["user_id", "event_type"], [F.col("ts"), F.col("seq")],
        [Running("previous_count", F.lit(1).cast("bigint"), "sum")], ranges,
    )
    return out.withColumn("new_count", F.col("previous_count") + 1)


def update_feed(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """One aggregation update per engagement event: channel counts after it."""
    t = F.col("event_type")
    rows = events.filter(base_valid() & t.isin(list(ENGAGEMENT_COUNTERS))).select("seq", "event_id", "user_id", "event_type", "ts")
    def one(prefix: str) -> Column:
        return t.startswith(prefix).cast("bigint")
    out = running(
        rows, ["user_id"], [F.col("ts"), F.col("seq")],
        [
            Running("email_count", one("EMAIL_"), "sum", True),
            Running("sms_count", one("SMS_"), "sum", True),
            Running("call_count", one("CALL_"), "sum", True),
        ],
        ranges,
    )
    return out.select(
        "user_id", "email_count", "sms_count", "call_count",
        F.col("ts").alias("last_updated"), t.alias("trigger_event_type"), F.col("event_id").alias("trigger_event_id"),
    )


def contact_feed(updates: DataFrame) -> DataFrame:
    """The notification form of :func:`update_feed`."""
    return updates.select(
        "user_id", "email_count", "sms_count", "call_count",
        F.col("last_updated").alias("ts"), F.col("trigger_event_type").alias("event_type"),
    )


def batch_updates(rates: DataFrame, trigger: str, batch_id: str) -> DataFrame:
    """One update per user, sent together."""
    return rates.select(
        "user_id", "email_count", "sms_count", "call_count", F.col("last_activity").alias("last_updated"),
        F.lit(trigger).alias("trigger_event_type"), F.concat(F.lit("batch-"), F.lit(batch_id)).alias("trigger_event_id"),
    )


# ------------------------------------------------------------------ contactable


def contactable_rejects(updates: DataFrame) -> DataFrame:
    s = F.col("contactable_status")
    reason = F.when(s.isNull(), "missing_status").when(~s.isin(CONTACTABLE_STATUSES), "unknown_status")
    return updates.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def apply_contactable(users: DataFrame, updates: DataFrame) -> DataFrame:
    """Newest accepted update per user, and how many there were, on top of the read model."""
    latest = (
        updates.filter(F.col("contactable_status").isin(CONTACTABLE_STATUSES))
        .groupBy("user_id")
        .agg(
            F.max_by(F.struct("contactable_status", "graph_node", "processing_ts"), F.struct("processing_ts", "seq")).alias("u"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return users.join(latest, "user_id", "left").select(
        *users.columns,
        F.coalesce("u.contactable_status", F.lit(DEFAULT_CONTACTABLE)).alias("contactable_status"),
        F.col("u.graph_node").alias("current_graph_node"),
        F.col("u.processing_ts").alias("last_processing"),
        F.coalesce("n", F.lit(0)).alias("processing_count"),
    )


# ------------------------------------------------------------------- key balance


def java_hash(text: Column) -> Column:
    """32-bit string hash of the JVM, for texts of the basic plane."""
    h = F.aggregate(
        F.filter(F.split(text, ""), lambda ch: F.length(ch) > 0),
        F.lit(0).cast("bigint"),
        lambda acc, ch: (acc * 31 + F.ascii(ch)) % F.lit(4294967296),
    )
    return F.when(h >= 2147483648, h - 4294967296).otherwise(h)


def shard_of(user: Column, shards: int) -> Column:
    h = java_hash(user)
    # The 32-bit absolute value of the smallest integer is that integer itself.
    return F.when(h == -2147483648, h).otherwise(F.abs(h)) % F.lit(shards)


def shard_balance(type_counts: DataFrame, shards: int = 100) -> DataFrame:
    """Users and events per shard and how far the fullest is above the mean of the used ones.

    The hash is computed once per user, after the events are counted.
    """
    per_shard = (
        user_state(type_counts)
        .groupBy(shard_of(F.col("user_id"), shards).alias("shard"))
        .agg(F.count(F.lit(1)).alias("users"), F.sum("total_events").alias("events"))
    )
    stats = per_shard.agg(F.max("events").alias("m"), F.sum("events").alias("s"), F.count(F.lit(1)).alias("k"))
    skew = stats.select(F.col("m") * F.col("k") / F.col("s").cast("double")).scalar()
    return per_shard.withColumn("skew", skew)
