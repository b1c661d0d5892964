"""Raw messages in, typed events and a quarantine out.

Every parser returns one table with a ``reason`` column: NULL for a good row, else why it was set
aside. :func:`accepted` and :func:`quarantined` are its two halves, so no row is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rillbook.functions.barrier import evaluated_once
from rillbook.functions.text import epoch_ms_time, has_text, ladder, long_or_null, parts
from rillbook.schemas import (
    ACTION_TYPES,
    EVENT_TYPES,
    JSON_EVENT,
    PERSISTENCE_PREFIX,
    SOURCE_DELIMITED,
    SOURCE_TOPIC_PREFIX,
)


def accepted(parsed: DataFrame) -> DataFrame:
    return evaluated_once(parsed).filter(F.col("reason").isNull()).drop("reason")


def quarantined(parsed: DataFrame) -> DataFrame:
    return evaluated_once(parsed).filter(F.col("reason").isNotNull())


# ------------------------------------------------------------------ vocabulary


def channel_of(event_type: Column) -> Column:
    """EMAIL, SMS, CALL or OTHER by the prefix of the event type."""
    return (
        F.when(event_type.startswith("EMAIL_"), "EMAIL")
        .when(event_type.startswith("SMS_"), "SMS")
        .when(event_type.startswith("CALL_"), "CALL")
        .when(event_type.isNotNull(), "OTHER")
    )


def action_type(action: Column) -> Column:
    """Action word -> event type; unknown words mean DROP."""
    word = F.upper(action)
    return ladder([(word == k, v) for k, v in ACTION_TYPES.items()], "DROP")


def known_type(event_type: Column) -> Column:
    """Upper-cased type if it is in the vocabulary, else EMAIL_DELIVERY."""
    return F.when(F.upper(event_type).isin(EVENT_TYPES), F.upper(event_type)).otherwise(F.lit("EMAIL_DELIVERY"))


def user_from_hash(hash_: Column) -> Column:
    return F.when(F.length(hash_) > 0, F.concat(F.lit("user_"), F.substring(hash_, 1, 10))).otherwise(F.lit("unknown"))


def event_from_hash(hash_: Column) -> Column:
    return F.substring(hash_, 1, 20)


# --------------------------------------------------------------------- parsers


def is_json(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[\x00-\x20]*\{"), F.lit(False))


def parse_json(raw: DataFrame) -> DataFrame:
    """JSON messages into the wide event."""
    doc = F.from_json("value", JSON_EVENT, {"mode": "PERMISSIVE"})
    rows = raw.filter(is_json(F.col("value"))).withColumn("doc", doc)
    when = F.try_to_timestamp(F.col("doc.timestamp")).cast("timestamp_ntz")
    return rows.select(
        "topic",
        "partition",
        "offset",
        F.col("doc.eventId").alias("event_id"),
        F.col("doc.userId").alias("user_id"),
        F.col("doc.eventType").alias("event_type"),
        channel_of(F.col("doc.eventType")).alias("channel"),
        when.alias("ts"),
        F.col("doc.source").alias("source"),
        F.col("doc.contactId").alias("contact_id"),
        F.col("doc.eventData").alias("event_data"),
        F.col("doc.emailAddress").alias("email_address"),
        F.col("doc.subject").alias("subject"),
        F.col("doc.campaignId").alias("campaign_id"),
        F.col("doc.linkUrl").alias("link_url"),
        F.col("doc.bounceReason").alias("bounce_reason"),
        F.col("doc.phoneNumber").alias("phone_number"),
        F.col("doc.messageContent").alias("message_content"),
        F.col("doc.shortCode").alias("short_code"),
        F.col("doc.carrierId").alias("carrier_id"),
        F.col("doc.deliveryStatus").alias("delivery_status"),
        F.col("doc.replyContent").alias("reply_content"),
        F.col("doc.durationSeconds").alias("duration_seconds"),
        F.col("doc.callDirection").alias("call_direction"),
        F.col("doc.callerId").alias("caller_id"),
        F.col("doc.calleeId").alias("callee_id"),
        F.col("doc.callResult").alias("call_result"),
        F.col("doc.disconnectReason").alias("disconnect_reason"),
        F.col("doc.recordingUrl").alias("recording_url"),
        F.col("doc.callQuality").alias("call_quality"),
        F.col("doc.metadata").alias("metadata"),
        "value",
        F.when(F.col("doc._corrupt_record").isNotNull(), "bad_json")
        .when(F.col("doc.timestamp").isNotNull() & when.isNull(), "bad_timestamp")
        .alias("reason"),
    )


def parse_hash_messages(raw: DataFrame) -> DataFrame:
    """``time@hash:action:…`` messages: ids come from the hash, call result from the action."""
    p = F.col("p")
    rows = (
        raw.filter(~is_json(F.col("value")))
        .withColumn("p", parts(F.col("value"), ":"))
        .withColumn("h", parts(F.get(p, F.lit(0)), "@"))
        .withColumn("hash", F.coalesce(F.get(F.col("h"), F.lit(1)), F.lit("")))
        .withColumn("action", F.coalesce(F.get(p, F.lit(1)), F.lit("")))
        .withColumn("ts", epoch_ms_time(F.get(F.col("h"), F.lit(0))))
    )
    word = F.upper("action")
    return rows.select(
        "topic",
        "partition",
        "offset",
        event_from_hash(F.col("hash")).alias("event_id"),
        user_from_hash(F.col("hash")).alias("user_id"),
        action_type(F.col("action")).alias("event_type"),
        "ts",
        F.when(word == "DROP", "MISSED").when(word == "ANSWER", "COMPLETED").alias("call_result"),
        F.lit(SOURCE_DELIMITED).alias("source"),
        F.create_map(
            F.lit("rawData"), F.col("value"), F.lit("hash"), F.col("hash"), F.lit("action"), F.col("action")
        ).alias("metadata"),
        "value",
        F.when(F.col("value").isNull() | (F.size(p) < 2), "too_few_parts")
        .when(F.col("ts").isNull(), "bad_timestamp")
        .alias("reason"),
    )


def _structured(col: Column) -> Column:
    """``…@…:…:…``: at least three parts, the first holding the user."""
    p = parts(col, ":")
    return F.when((F.size(p) >= 3) & F.contains(F.get(p, F.lit(0)), F.lit("@")), col)


def parse_user_messages(raw: DataFrame) -> DataFrame:
    """``TS<ms>@user:action:contact[:extra]`` messages, taken from the key if it has that form, else
    from the value."""
    p, head = F.col("p"), F.col("head")
    rows = (
        raw.withColumn("from_key", _structured(F.col("key")))
        .withColumn("text", F.coalesce(F.col("from_key"), _structured(F.col("value"))))
        .withColumn("p", parts(F.col("text"), ":"))
        .withColumn("head", parts(F.get(p, F.lit(0)), "@"))
        .withColumn("contact_id", long_or_null(F.get(p, F.lit(2))))
        .withColumn("ts", epoch_ms_time(F.get(head, F.lit(0))))
    )
    return rows.select(
        "topic",
        "partition",
        "offset",
        position_id(F.col("topic"), F.col("partition"), F.col("offset")).alias("event_id"),
        F.get(head, F.lit(1)).alias("user_id"),
        F.get(p, F.lit(1)).alias("event_type"),
        "contact_id",
        "ts",
        F.when(F.col("from_key").isNotNull(), F.coalesce("value", F.lit(""))).otherwise(F.col("text")).alias("event_data"),
        F.concat(F.lit(SOURCE_TOPIC_PREFIX), F.col("topic")).alias("source"),
        "key",
        "value",
        F.when(F.col("text").isNull(), "no_structured_data")
        .when(F.size(head) != 2, "bad_time_user")
        .when(F.col("contact_id").isNull(), "bad_contact_id")
        .when(F.col("ts").isNull(), "bad_timestamp")
        .alias("reason"),
    )


def decode_message(raw: DataFrame) -> DataFrame:
    """Every message by its form, in one projection: ``json``, ``user`` (time, user, action, contact) or ``hash``.

    A structured key decides before the value does. No row is left out; all columns of ``raw`` stay.
    ``reason`` is NULL for a usable event, else what is wrong with the message or the event in it.
    """
    value, no = F.col("value"), F.lit(None)
    doc = F.when(F.col("form") == "json", F.from_json("value", JSON_EVENT, {"mode": "PERMISSIVE"}))
    rows = (
        raw.withColumn("text", F.coalesce(_structured(F.col("key")), F.when(~is_json(value), _structured(value))))
        .withColumn("form", F.when(F.col("text").isNotNull(), "user").when(is_json(value), "json").otherwise("hash"))
        .withColumn("doc", doc)
        .withColumn("p", parts(F.coalesce("text", "value"), ":"))
        .withColumn("head", parts(F.get("p", F.lit(0)), "@"))
    )
    form, hash_ = F.col("form"), F.coalesce(F.get("head", F.lit(1)), F.lit(""))
    json_ts = F.try_to_timestamp(F.col("doc.timestamp")).cast("timestamp_ntz")

    def by_form(json, user, hashed):
        return F.when(form == "json", json).when(form == "user", user).otherwise(hashed)

    found = rows.withColumns(
        {
            "event_id": by_form(F.col("doc.eventId"), position_id(F.col("topic"), F.col("partition"), F.col("offset")), event_from_hash(hash_)),
            "user_id": by_form(F.col("doc.userId"), F.get("head", F.lit(1)), user_from_hash(hash_)),
            "event_type": by_form(F.col("doc.eventType"), F.get("p", F.lit(1)), action_type(F.coalesce(F.get("p", F.lit(1)), F.lit("")))),
            "contact_id": by_form(F.col("doc.contactId"), long_or_null(F.get("p", F.lit(2))), no.cast("bigint")),
            "ts": by_form(json_ts, *[epoch_ms_time(F.get("head", F.lit(0)))] * 2),
        }
    )
    broken = by_form(
        F.when(F.col("doc._corrupt_record").isNotNull(), "bad_json").when(F.col("doc.timestamp").isNotNull() & json_ts.isNull(), "bad_timestamp"),
        F.when(F.size("head") != 2, "bad_time_user").when(F.col("contact_id").isNull(), "bad_contact_id").when(F.col("ts").isNull(), "bad_timestamp"),
        F.when(value.isNull() | (F.size("p") < 2), "too_few_parts").when(F.col("ts").isNull(), "bad_timestamp"),
    )
    unusable = (
        F.when(~has_text(F.col("user_id")), "missing_user").when(~has_text(F.col("event_id")), "missing_event_id")
        .when(F.col("ts").isNull(), "missing_timestamp").when(~F.coalesce(F.col("event_type").isin(EVENT_TYPES), F.lit(False)), "unknown_type")
    )
    return found.withColumn("reason", F.coalesce(broken, unusable)).drop("text", "doc", "p", "head")


def position_id(topic: Column, partition: Column, offset: Column) -> Column:
    """A repeatable event id: the hash of the place the message was read from."""
    return F.sha2(F.concat_ws(":", topic, partition.cast("string"), offset.cast("string")), 256)


def receive_probe(raw: DataFrame) -> DataFrame:
    """Type and user read loosely, for the receive log."""
    typed = F.when(F.contains(F.col("key"), F.lit(":")), F.col("key")).otherwise(F.col("value"))
    owned = F.when(F.contains(F.col("key"), F.lit("@")), F.col("key")).otherwise(F.col("value"))
    user_part = F.get(parts(owned, "@"), F.lit(1))
    return raw.select(
        "topic",
        "partition",
        "offset",
        F.coalesce(F.get(parts(typed, ":"), F.lit(1)), F.lit("UNKNOWN")).alias("event_type"),
        F.coalesce(F.get(F.split(user_part, ":"), F.lit(0)), F.lit("unknown-user")).alias("user_id"),
    )


# ----------------------------------------------------------------- projections


def fill_defaults(events: DataFrame, source: str, as_of: Column) -> DataFrame:
    """Fill a missing id (hash of the natural key), time and source."""
    cols = set(events.columns)
    given = F.col("source") if "source" in cols else F.lit(None).cast("string")
    nat = F.sha2(F.concat_ws(":", "user_id", "event_type", F.col("contact_id").cast("string"), F.col("ts").cast("string")), 256)
    return events.withColumns(
        {
            "event_id": F.coalesce("event_id", nat),
            "ts": F.coalesce("ts", as_of),
            "source": F.coalesce(given, F.lit(source)),
        }
    )


def to_flat(events: DataFrame) -> DataFrame:
    """The flat user-event form of communication events; no column is lost on the way."""
    return events.select("user_id", "event_type", "contact_id", "ts", "event_data", "event_id")


def natural_key(user: Column, event_type: Column, contact: Column) -> Column:
    """``user:type:contact``; a missing part is written as ``null``."""
    null = F.lit("null")
    return F.concat_ws(":", F.coalesce(user, null), F.coalesce(event_type, null), F.coalesce(contact.cast("string"), null))


def distinct_events(events: DataFrame) -> DataFrame:
    """One row per user, type, contact and time."""
    return (
        events.select("user_id", "event_type", "contact_id", "ts")
        .dropDuplicates()
        .withColumn("natural_key", natural_key(F.col("user_id"), F.col("event_type"), F.col("contact_id")))
    )


# Renamed types, and the words searched for when no type field is there, in this order.
RENAMED_TYPES = {"EMAIL_DELIVERY": "EMAIL", "SMS_DELIVERY": "SMS", "CALL_DELIVERY": "CALL", "DROP_EVENT": "DROP"}
TYPE_WORDS = ["DROP", "EMAIL", "SMS", "CALL", "PICKUP", "DELIVERY"]
TYPE_FIELD = r'"eventType"\s*:\s*"([^"]+)"'


def payload_type(data: Column) -> Column:
    """Event type named in a payload text, NULL when there is none."""
    field = F.nullif(F.regexp_extract(data, TYPE_FIELD, 1), F.lit(""))
    field = F.when(F.contains(data, F.lit('"eventType":')), field)
    renamed = F.lit(None).cast("string")
    for old, new in RENAMED_TYPES.items():
        renamed = F.when(field == old, F.lit(new)).otherwise(renamed)
    word = F.lit(None).cast("string")
    for w in reversed(TYPE_WORDS):
        word = F.when(F.contains(data, F.lit(w)), F.lit(w)).otherwise(word)
    return F.coalesce(renamed, field, word)


# Sentences of the activity feed.
EVENT_SENTENCES = {
    "UserEventProcessed": "processed an event",
    "DROP": "dropped an item",
    "EMAIL": "sent an email",
    "SMS": "sent an SMS",
    "CALL": "made a call",
    "PICKUP": "picked up an item",
    "DELIVERY": "completed delivery",
}


def event_line(event_type: Column, user: Column) -> Column:
    said = F.concat(F.lit("performed "), event_type)
    for key, text in EVENT_SENTENCES.items():
        said = F.when(event_type == key, F.lit(text)).otherwise(said)
    return F.concat(F.lit("User "), user, F.lit(" "), said)


def display_id(persistence_id: Column) -> Column:
    """Short form of a user id for reports."""
    clean = F.replace(persistence_id, F.lit(PERSISTENCE_PREFIX), F.lit(""))
    short = F.concat(F.substring(clean, 1, 8), F.lit("..."), F.right(clean, F.lit(4)))
    return (
        F.when(persistence_id.isNull(), "Unknown")
        .when(clean.rlike(r"^user\w+$"), clean)
        .when(F.length(clean) > 20, short)
        .otherwise(clean)
    )


def user_of(persistence_id: Column) -> Column:
    """What follows the last ``|``."""
    return F.substring_index(persistence_id, "|", -1)


def user_journal(journal: DataFrame) -> DataFrame:
    """Rows of user entities only, with the user id taken from the key."""
    return journal.filter(F.col("persistence_id").startswith(PERSISTENCE_PREFIX)).withColumn(
        "user_id", user_of(F.col("persistence_id"))
    )


def fan_out(events: DataFrame, topics: list[str]) -> DataFrame:
    """One derived event per topic."""
    return (
        events.withColumn("topic", F.explode(F.array(*[F.lit(t) for t in topics])))
        .withColumn("event_id", F.concat_ws("-", "event_id", "topic"))
        .withColumn("source", F.concat(F.lit(SOURCE_TOPIC_PREFIX), F.col("topic")))
    )


def union_topics(*sources: DataFrame) -> DataFrame:
    """Several topics as one table."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other)
    return out


