"""Event validity and rule-based data quality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rillbook.functions.barrier import evaluated_once
from rillbook.functions.text import has_text
from rillbook.operators.ingest import channel_of
from rillbook.schemas import ENGAGEMENT_COUNTERS, EVENT_TYPES


def base_valid() -> Column:
    """User, id, time and a known type are there."""
    return (
        has_text(F.col("user_id"))
        & has_text(F.col("event_id"))
        & F.col("ts").isNotNull()
        & F.coalesce(F.col("event_type").isin(EVENT_TYPES), F.lit(False))
    )


def engagement_valid() -> Column:
    """Valid for its channel: opens and clicks, replies and deliveries, completed and missed calls."""
    return base_valid() & F.coalesce(F.col("event_type").isin(list(ENGAGEMENT_COUNTERS)), F.lit(False))


def flat_valid() -> Column:
    return has_text(F.col("user_id")) & has_text(F.col("event_type")) & (F.coalesce(F.col("contact_id"), F.lit(0)) > 0)


def invalid_reason() -> Column:
    """First failing rule, NULL for a valid engagement event."""
    return (
        F.when(~has_text(F.col("user_id")), "missing_user")
        .when(F.col("event_type").isNull(), "missing_type")
        .when(F.col("ts").isNull(), "missing_timestamp")
        .when(~has_text(F.col("event_id")), "missing_event_id")
        .when(~F.col("event_type").isin(EVENT_TYPES), "unknown_type")
        .when(~F.col("event_type").isin(list(ENGAGEMENT_COUNTERS)), "not_an_engagement_type")
    )


def validity(events: DataFrame) -> DataFrame:
    return events.withColumns(
        {
            "channel": channel_of(F.col("event_type")),
            "is_base_valid": base_valid(),
            "is_engagement_valid": engagement_valid(),
            "is_flat_valid": flat_valid(),
            "reason": invalid_reason(),
        }
    )


def owner_mismatch(owner: Column, user: Column) -> Column:
    """An event must belong to the user whose state it changes."""
    return F.coalesce(owner != user, F.lit(True))


# ------------------------------------------------------------------ rule checks

# Fixed values of the channel rules.
CHANNEL_TYPES = {
    "EMAIL": ["EMAIL_OPEN", "EMAIL_CLICK", "EMAIL_BOUNCE", "EMAIL_DELIVERY"],
    "SMS": ["SMS_REPLY", "SMS_DELIVERY", "SMS_BOUNCE", "SMS_CLICK"],
    "CALL": ["CALL_COMPLETED", "CALL_MISSED", "CALL_ANSWERED", "CALL_BUSY"],
}
PHONE = r"^\+?[1-9][0-9]{1,14}$"
SHORT_CODE = r"^[0-9]{3,8}$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
URI = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]*$"
DELIVERY_STATUSES = ["DELIVERED", "FAILED", "PENDING", "UNKNOWN"]
CALL_DIRECTIONS = ["INBOUND", "OUTBOUND"]
DISCONNECT_REASONS = ["NORMAL", "BUSY", "NO_ANSWER", "FAILED", "CANCELLED", "NETWORK_ERROR"]
CALL_QUALITIES = ["EXCELLENT", "GOOD", "FAIR", "POOR"]
#: Channel of events without a type.
NO_CHANNEL = "NONE"
MAX_TEXT = 1600
MAX_CALL_SECONDS = 86400


@dataclass(frozen=True)
class Rule:
    channel: str
    field: str
    code: str
    violated: Column

    @property
    def name(self) -> str:
        return f"{self.field}.{self.code}"


def channel_rules(columns: list[str]) -> list[Rule]:
    """The rules of all channels. A field the table lacks counts as absent from every row."""
    types = {"duration_seconds": "bigint"}

    def c(field: str) -> Column:
        return F.col(field) if field in columns else F.lit(None).cast(types.get(field, "string"))

    def is_type(event_type: str) -> Column:
        return F.col("event_type") == event_type

    out: list[Rule] = []
    for channel, allowed in CHANNEL_TYPES.items():
        address = "email_address" if channel == "EMAIL" else "phone_number"

        def rule(field: str, code: str, violated: Column, channel: str = channel) -> None:
            out.append(Rule(channel, field, code, F.coalesce(violated, F.lit(False))))

        def is_in(field: str, values: list[str]) -> None:
            rule(field, "enum", ~c(field).isin(values))

        for field in ("user_id", "event_id", "ts", "event_type", address):
            rule(field, "required", c(field).isNull())
        for field in ("user_id", "event_id"):
            rule(field, "min_length", F.length(c(field)) < 1)
        is_in("event_type", allowed)

        if channel == "EMAIL":
            rule("email_address", "format", ~c("email_address").rlike(EMAIL))
            rule("link_url", "format", ~c("link_url").rlike(URI))
            rule("link_url", "required_when", is_type("EMAIL_CLICK") & c("link_url").isNull())
            rule("bounce_reason", "required_when", is_type("EMAIL_BOUNCE") & (F.coalesce(F.length(c("bounce_reason")), F.lit(0)) < 1))
        else:
            rule("phone_number", "pattern", ~c("phone_number").rlike(PHONE))
        if channel == "SMS":
            rule("message_content", "max_length", F.length(c("message_content")) > MAX_TEXT)
            rule("reply_content", "max_length", F.length(c("reply_content")) > MAX_TEXT)
            rule("short_code", "pattern", ~c("short_code").rlike(SHORT_CODE))
            is_in("delivery_status", DELIVERY_STATUSES)
            rule("reply_content", "required_when", is_type("SMS_REPLY") & (F.coalesce(F.length(c("reply_content")), F.lit(0)) < 1))
            rule("delivery_status", "required_when", is_type("SMS_DELIVERY") & c("delivery_status").isNull())
        if channel == "CALL":
            rule("duration_seconds", "range", ~c("duration_seconds").between(0, MAX_CALL_SECONDS))
            is_in("call_direction", CALL_DIRECTIONS)
            is_in("disconnect_reason", DISCONNECT_REASONS)
            is_in("call_quality", CALL_QUALITIES)
            rule("recording_url", "format", ~c("recording_url").rlike(URI))
            rule("duration_seconds", "required_when", is_type("CALL_COMPLETED") & c("duration_seconds").isNull())
            rule("duration_seconds", "range_when", is_type("CALL_COMPLETED") & (c("duration_seconds") < 1))
    # A missing type, or one nobody knows, is a finding of its own.
    out.append(Rule(NO_CHANNEL, "event_type", "required", F.col("event_type").isNull()))
    out.append(Rule("OTHER", "event_type", "enum", ~F.coalesce(F.col("event_type").isin(EVENT_TYPES), F.lit(True))))
    return out


def _rule_channel() -> Column:
    return F.coalesce(channel_of(F.col("event_type")), F.lit(NO_CHANNEL))


def _with_violations(events: DataFrame) -> DataFrame:
    """One pass over the table; ``broken`` lists the rules a row breaks as ``field.code,field.code``.

    A joined text instead of an array of structs keeps all rules inside generated code.
    """
    ch = F.col("channel")
    checks = [F.when((ch == r.channel) & r.violated, F.lit(r.name)) for r in channel_rules(events.columns)]
    rows = events.withColumn("channel", _rule_channel())
    return rows.select("event_id", "channel", F.concat_ws(",", *checks).alias("broken"))


def dq_violations(events: DataFrame) -> DataFrame:
    """``(event_id, channel, field, code)``, one row per broken rule."""
    # The outer form leaves the filter above the rules; the plain one would evaluate them twice.
    each = _with_violations(events).select(
        "event_id", "channel", F.explode_outer(F.split(F.nullif(F.col("broken"), F.lit("")), ",")).alias("rule")
    )
    return each.filter(F.col("rule").isNotNull()).select(
        "event_id", "channel",
        F.substring_index("rule", ".", 1).alias("field"),
        F.substring_index("rule", ".", -1).alias("code"),
    )


def dq_messages(events: DataFrame) -> DataFrame:
    """One message per event that breaks a rule."""
    text = F.replace(F.replace(F.col("broken"), F.lit("."), F.lit(": ")), F.lit(","), F.lit(", "))
    rows = _with_violations(events).select("event_id", F.concat(F.lit("Validation failed: "), text).alias("message"), "broken")
    return evaluated_once(rows).filter(F.col("broken") != "").drop("broken")


def dq_report(events: DataFrame) -> DataFrame:
    """``(rule, channel, checked, violations)``: every rule, also those nobody breaks.

    All counts come from one aggregate without a key, so tasks send one row each.
    """
    rules = channel_rules(events.columns)
    ch = _rule_channel()
    counts = [F.count_if(ch == r.channel).alias(f"c{i}") for i, r in enumerate(rules)]
    counts += [F.count_if((ch == r.channel) & r.violated).alias(f"v{i}") for i, r in enumerate(rules)]
    row = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(r.channel).alias("channel"),
                F.col(f"c{i}").alias("checked"),
                F.col(f"v{i}").alias("violations"),
            )
            for i, r in enumerate(rules)
        ]
    )
    return events.agg(*counts).select(F.inline(row))
