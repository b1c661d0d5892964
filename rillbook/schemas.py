"""Record shapes and value domains. Schemas are always explicit, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# The names below are part of the data format; they must not be changed.

#: Event type vocabulary.
EVENT_TYPES = [
    "EMAIL_OPEN", "EMAIL_CLICK", "EMAIL_BOUNCE", "EMAIL_DELIVERY",
    "SMS_REPLY", "SMS_DELIVERY", "SMS_BOUNCE", "SMS_CLICK",
    "CALL_COMPLETED", "CALL_MISSED", "CALL_ANSWERED", "CALL_BUSY",
    "LOGIN", "LOGOUT", "VIEW_PRODUCT", "ADD_TO_CART", "PURCHASE",
    "DROP", "PICKUP", "DELIVERY",
    "HEALTH_CHECK", "PEKKO_KAFKA_TEST",
]

#: Types that move an engagement counter, and the counter each one moves.
ENGAGEMENT_COUNTERS = {
    "EMAIL_OPEN": "email_opens",
    "EMAIL_CLICK": "email_clicks",
    "SMS_REPLY": "sms_replies",
    "SMS_DELIVERY": "sms_deliveries",
    "CALL_COMPLETED": "calls_completed",
    "CALL_MISSED": "calls_missed",
}

#: Action word of a delimited message -> event type. Every other word means DROP.
ACTION_TYPES = {
    "DROP": "DROP",
    "ANSWER": "CALL_ANSWERED",
    "PICKUP": "PICKUP",
    "DELIVERY": "DELIVERY",
    "SEND": "SMS_DELIVERY",
    "RECEIVE": "SMS_REPLY",
}

CONTACTABLE_STATUSES = ["CONTACTABLE", "NOT_CONTACTABLE", "PENDING_REVIEW", "SUPPRESSED", "OPTED_OUT"]
DEFAULT_CONTACTABLE = "PENDING_REVIEW"

#: Journal ids are this prefix followed by the user id.
PERSISTENCE_PREFIX = "PersistentUserActor|"

#: Source labels written on parsed and derived events.
SOURCE_DELIMITED = "kafka-colon-delimited"
SOURCE_TOPIC_PREFIX = "pekko-kafka-"

SNAPSHOT_EVERY = 50
SNAPSHOTS_KEPT = 5
# ---------------------------------------------------------- end of fixed values

#: Stages a message passes, in order.
STAGES = ["source", "process", "store"]

#: What a broker hands over; the file source carries the same columns.
BROKER = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

#: The same with the time the broker took a message in.
RECEIVED = T.StructType([*BROKER.fields, T.StructField("received", T.TimestampType())])

#: JSON form of an event. Subtype fields are nullable columns of one wide record.
JSON_EVENT = T.StructType(
    [
        T.StructField("eventId", T.StringType()),
        T.StructField("userId", T.StringType()),
        T.StructField("eventType", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("contactId", T.LongType()),
        T.StructField("eventData", T.StringType()),
        T.StructField("emailAddress", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("campaignId", T.StringType()),
        T.StructField("linkUrl", T.StringType()),
        T.StructField("bounceReason", T.StringType()),
        T.StructField("phoneNumber", T.StringType()),
        T.StructField("messageContent", T.StringType()),
        T.StructField("shortCode", T.StringType()),
        T.StructField("carrierId", T.StringType()),
        T.StructField("deliveryStatus", T.StringType()),
        T.StructField("replyContent", T.StringType()),
        T.StructField("durationSeconds", T.LongType()),
        T.StructField("callDirection", T.StringType()),
        T.StructField("callerId", T.StringType()),
        T.StructField("calleeId", T.StringType()),
        T.StructField("callResult", T.StringType()),
        T.StructField("disconnectReason", T.StringType()),
        T.StructField("recordingUrl", T.StringType()),
        T.StructField("callQuality", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

#: Append-only log of processed events, unique on the first two columns.
JOURNAL = T.StructType(
    [
        T.StructField("persistence_id", T.StringType()),
        T.StructField("sequence_nr", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_data", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("seq", T.LongType()),
    ]
)
