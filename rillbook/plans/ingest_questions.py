"""Questions about sources, sinks, parsing and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rillbook.functions.clock import as_of
from rillbook.functions.text import epoch_ms_time, parts
from rillbook.operators import ingest, journal as j, journal_store as store, migration as m, monitoring as mon, quality as q, state as s
from rillbook.plans.registry import question
from rillbook.plans.sqltext import BASE_VALID, CHANNEL, DISPLAY_ID, DOMAIN, ENGAGED, ENGAGEMENT, EVENT_LINE, RATES
from rillbook.sources import sinks
from rillbook.sources.storage import replace_table, scratch

# --------------------------------------------------------------- sources, sinks


@question(
    "a03_journal_counts",
    "journal",
    """SELECT split_part(persistence_id, '|', -1) AS user_id, event_type, count(*) AS n, max(ts) AS last_updated
    FROM journal WHERE persistence_id LIKE 'PersistentUserActor|%' GROUP BY ALL""",
)
def journal_counts(t):
    return j.history_counts(t.journal)


INSERTABLE_SQL = """WITH fresh AS (
  SELECT persistence_id, sequence_nr, min(seq) AS seq FROM migrated_events GROUP BY ALL),
  added AS (SELECT f.persistence_id, f.sequence_nr, m.event_type, m.seq FROM fresh f JOIN migrated_events m
    ON m.seq = f.seq AND m.persistence_id = f.persistence_id
    WHERE NOT EXISTS (SELECT 1 FROM journal x WHERE x.persistence_id = f.persistence_id AND x.sequence_nr = f.sequence_nr))
"""


def _incoming(t) -> DataFrame:
    """The migrated rows in journal form; some of their keys are taken."""
    return t.migrated_events.select(
        "persistence_id", "sequence_nr", "event_type", F.lit(None).cast("string").alias("event_data"), F.col("created").alias("ts"), "seq"
    )


@question(
    "a04_journal_append",
    "journal migrated_events",
    INSERTABLE_SQL + "SELECT persistence_id, sequence_nr, event_type, seq FROM journal UNION ALL SELECT * FROM added",
)
def journal_append(t):
    path = scratch(t.spark, "a04")
    store.append_journal(t.journal, path)
    store.append_journal(_incoming(t), path)
    return store.stored_journal(t.spark, path).select("persistence_id", "sequence_nr", "event_type", "seq")


ROUTED_SQL = f"""WITH r AS (
  SELECT *, CASE WHEN event_type IN ('EMAIL_OPEN', 'EMAIL_CLICK') THEN 'email-events' WHEN event_type IN ('SMS_REPLY', 'SMS_DELIVERY') THEN 'sms-events'
    WHEN event_type IN ('CALL_COMPLETED', 'CALL_MISSED') THEN 'call-events' END AS t, {BASE_VALID} AS valid FROM comm_events),
  routed AS (SELECT CASE WHEN valid THEN t END AS topic, user_id AS key,
    json_object('userId', user_id, 'eventId', event_id, 'eventType', event_type, 'timestamp', strftime(ts, '%Y-%m-%dT%H:%M:%S'))::VARCHAR AS value,
    CASE WHEN NOT valid THEN 'invalid_event' WHEN t IS NULL THEN 'no_topic' END AS reason FROM r)
"""


@question("a05_routed_events", "comm_events", ROUTED_SQL + "SELECT topic, key, value, reason FROM routed")
def routed_events(t):
    return sinks.routed(t.comm_events)


@question(
    "a06_batch_publish",
    "comm_events",
    ROUTED_SQL + "SELECT coalesce(topic, 'unrouted-events') AS topic, count(*) AS messages, count(DISTINCT key) AS users FROM routed GROUP BY 1",
)
def batch_publish(t):
    path = scratch(t.spark, "a06")
    sinks.write_topics(sinks.routed(t.comm_events), path)
    sent = t.spark.read.schema("key STRING, value STRING, reason STRING, topic STRING").parquet(path)
    return sent.groupBy("topic", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("topic").agg(
        F.sum("n").alias("messages"), F.count("key").alias("users")
    )


UPDATES_SQL = f"""WITH e AS (
  SELECT seq, event_id, user_id, event_type, ts FROM comm_events WHERE {BASE_VALID} AND event_type IN {ENGAGED}),
  updates AS (SELECT user_id,
    count(*) FILTER (event_type LIKE 'EMAIL%') OVER w AS email_count, count(*) FILTER (event_type LIKE 'SMS%') OVER w AS sms_count,
    count(*) FILTER (event_type LIKE 'CALL%') OVER w AS call_count,
    ts AS last_updated, event_type AS trigger_event_type, event_id AS trigger_event_id
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))
"""


@question("a07_aggregation_updates", "comm_events", UPDATES_SQL + "SELECT * FROM updates")
def aggregation_updates(t):
    return s.update_feed(t.comm_events)


@question(
    "a07_contact_notifications",
    "comm_events",
    UPDATES_SQL + "SELECT user_id, email_count, sms_count, call_count, last_updated AS ts, trigger_event_type AS event_type FROM updates",
)
def contact_notifications(t):
    return s.contact_feed(s.update_feed(t.comm_events))


@question(
    "a07_batch_updates",
    "comm_events",
    "WITH " + ENGAGEMENT + "," + RATES + """SELECT user_id, email_count, sms_count, call_count, last_activity AS last_updated,
    'BATCH' AS trigger_event_type, 'batch-0' AS trigger_event_id FROM rates""",
)
def batch_update_feed(t):
    return s.batch_updates(s.with_rates(s.user_engagement(t.comm_events)), "BATCH", "0")


@question(
    "a08_keyed_text",
    "comm_events",
    """SELECT 'user-events' AS topic, coalesce(user_id, 'null') || ':' || coalesce(event_type, 'null') || ':' || contact_id AS key,
    json_object('userId', user_id, 'eventType', event_type, 'contactId', contact_id, 'timestamp', strftime(ts, '%Y-%m-%dT%H:%M:%S'))::VARCHAR AS value
    FROM comm_events""",
)
def keyed_text(t):
    return sinks.keyed_text(t.comm_events, "user-events")


ACTION_SQL = """CASE WHEN error_code = 1040 THEN 'RETRY_WITH_BACKOFF' WHEN error_code = 1205 THEN 'RETRY' WHEN error_code = 1213 THEN 'RETRY_WITH_RANDOM_DELAY'
    WHEN error_code = 1062 THEN 'STOP' WHEN error_code = 1146 THEN 'ESCALATE' WHEN sql_state LIKE '08%' THEN 'RESTART' WHEN sql_state LIKE '40%' THEN 'RETRY'
    ELSE 'RESTART' END"""


@question(
    "a09_result_split",
    "stage_log",
    f"""WITH r AS (SELECT *, {ACTION_SQL} AS action FROM stage_log),
    o AS (SELECT CASE WHEN ok THEN 'SUCCESS' WHEN action LIKE 'RETRY%' AND attempt < 3 THEN 'RETRY' ELSE 'FAILED' END AS status, seq FROM r)
    SELECT CASE WHEN status = 'SUCCESS' THEN 'processed' ELSE 'failed' END AS stored_in, status, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum
    FROM o GROUP BY ALL""",
)
def result_split(t):
    path = scratch(t.spark, "a09")
    results = sinks.with_outcome(t.stage_log)
    sinks.split_results(results, path)
    both = [
        t.spark.read.schema(results.schema).parquet(f"{path}/{name}").withColumn("stored_in", F.lit(name)) for name in ("processed", "failed")
    ]
    return both[0].unionByName(both[1]).groupBy("stored_in", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))


@question("a10_legacy_scan", "legacy_events", "SELECT id, user_id, event_type, ts, channel FROM legacy_events")
def legacy_scan(t):
    return m.legacy_scan(t.legacy_events)


RESULTS = f"""results AS (
  SELECT l.*, CASE WHEN coalesce(l.event_type IN {DOMAIN}, FALSE) IS FALSE THEN 'SKIPPED' WHEN g.seq IS NOT NULL THEN 'SUCCESS' ELSE 'FAILED' END AS status
  FROM legacy_events l LEFT JOIN migrated_events g ON l.id = g.seq),
errors AS (SELECT id, user_id, ts, CASE WHEN status = 'SKIPPED' THEN 'TRANSFORMATION_ERROR' ELSE 'DATABASE_ERROR' END AS error_type,
  CASE WHEN status = 'SKIPPED' THEN 'Unknown event type: ' || coalesce(event_type, 'null') ELSE 'Row missing in target' END AS message,
  'Channel: ' || channel AS context FROM results WHERE status <> 'SUCCESS')
"""


@question(
    "a11_error_export",
    "legacy_events migrated_events",
    "WITH " + RESULTS + """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || ' ' || error_type || ' id=' || id || ' user=' || user_id
    || ': ' || message || ' [' || context || ']' AS value FROM errors""",
)
def error_export(t):
    path = scratch(t.spark, "a11")
    m.export_report(m.migration_errors(m.migration_results(t.legacy_events, t.migrated_events)), path)
    return t.spark.read.text(path)


@question(
    "a12_read_model",
    "comm_events",
    "WITH " + ENGAGEMENT + "," + RATES + """SELECT user_id, email_opens, email_clicks, sms_replies, sms_deliveries, calls_completed, calls_missed, last_activity,
    TRY_CAST(TRY_CAST(round(email_open_rate, 4) AS DECIMAL(5,4)) AS DOUBLE) AS email_open_rate,
    TRY_CAST(TRY_CAST(round(sms_response_rate, 4) AS DECIMAL(5,4)) AS DOUBLE) AS sms_response_rate,
    TRY_CAST(TRY_CAST(round(call_completion_rate, 4) AS DECIMAL(5,4)) AS DOUBLE) AS call_completion_rate,
    'PENDING_REVIEW' AS contactable_status, 0::BIGINT AS processing_count FROM rates""",
)
def read_model(t):
    stored = replace_table(s.read_model(s.user_engagement(t.comm_events)), scratch(t.spark, "a12"))
    rates = {r: F.col(r).cast("double") for r in ("email_open_rate", "sms_response_rate", "call_completion_rate")}
    return stored.withColumns(rates).drop("current_graph_node", "last_processing")


METRICS = """metrics AS (SELECT seq, user_id, event_type, stage, processing_ms AS processing_time_ms, ts AS processed_at,
  CASE WHEN ok THEN 'PROCESSED' ELSE 'FAILED' END AS status,
  CASE WHEN error_message IS NULL THEN NULL WHEN lower(error_message) LIKE '%timeout%' THEN 'timeout' WHEN lower(error_message) LIKE '%format%' THEN 'decode'
    WHEN lower(error_message) LIKE '%sequence%' THEN 'sequence' WHEN lower(error_message) LIKE '%temporary%' THEN 'temporary' ELSE 'other' END AS reason, attempt
  FROM stage_log)
"""


@question("a13_processing_metrics", "stage_log", "WITH " + METRICS + "SELECT * FROM metrics")
def processing_metrics(t):
    return replace_table(mon.processing_metrics(t.stage_log), scratch(t.spark, "a13"))


TOPS = """tops AS (SELECT persistence_id, max(sequence_nr) AS top, (max(sequence_nr) // 50) * 50 AS last_snapshot FROM journal GROUP BY 1),
points AS (SELECT persistence_id, unnest(generate_series(greatest(50, last_snapshot - 200), last_snapshot, 50)) AS snapshot_nr FROM tops WHERE last_snapshot > 0)
"""


@question(
    "a14_snapshots",
    "journal",
    "WITH " + TOPS + """SELECT p.persistence_id, p.snapshot_nr, x.event_type, count(*) AS n, min(x.ts) AS first_ts, max(x.ts) AS last_ts
    FROM points p JOIN journal x ON x.persistence_id = p.persistence_id AND x.sequence_nr <= p.snapshot_nr GROUP BY ALL""",
)
def snapshots(t):
    return j.snapshots(t.journal)


@question(
    "a14_truncated_state",
    "journal",
    """SELECT split_part(persistence_id, '|', -1) AS user_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
    FROM journal WHERE persistence_id LIKE 'PersistentUserActor|%' GROUP BY ALL""",
)
def truncated_state(t):
    """The journal is appended and truncated in two parts: state comes from the snapshots and the rows left."""
    path = scratch(t.spark, "a14")
    for part in ("sequence_nr <= 75", "sequence_nr > 75"):
        store.append_journal(t.journal.filter(part), path)
        store.truncate_journal(t.spark, path)
    return store.restored_state(t.spark, path)


@question(
    "a14_live_journal",
    "journal",
    "WITH " + TOPS + "SELECT x.persistence_id, x.sequence_nr, x.event_type, x.ts, x.seq FROM journal x JOIN tops p USING (persistence_id) WHERE x.sequence_nr > p.last_snapshot",
)
def live_journal(t):
    return j.live_journal(t.journal).drop("event_data")


# ----------------------------------------------------------------------- parsing


@question(
    "b01_json_accepted",
    "raw_messages",
    """SELECT topic, "offset", json_extract_string(value, '$.eventId') AS event_id, json_extract_string(value, '$.userId') AS user_id,
    json_extract_string(value, '$.eventType') AS event_type, 'EMAIL' AS channel FROM raw_messages WHERE value LIKE '{%' AND json_valid(value)""",
)
def json_accepted(t):
    return ingest.accepted(ingest.parse_json(t.raw_messages)).select("topic", "offset", "event_id", "user_id", "event_type", "channel")


@question(
    "b01_json_quarantine",
    "raw_messages",
    """SELECT topic, "offset", value, 'bad_json' AS reason FROM raw_messages WHERE value LIKE '{%' AND NOT json_valid(value)""",
)
def json_quarantine(t):
    return ingest.quarantined(ingest.parse_json(t.raw_messages)).select("topic", "offset", "value", "reason")


FORM1 = """p AS (SELECT *, string_split(regexp_replace(value, ':+$', ''), ':') AS p FROM raw_messages WHERE NOT value LIKE '{%'),
h AS (SELECT *, string_split(regexp_replace(p[1], '@+$', ''), '@') AS h FROM p),
f AS (SELECT topic, "offset", value, coalesce(h[2], '') AS hash, coalesce(p[2], '') AS action, len(p) AS parts,
  make_timestamp(try_cast(regexp_replace(h[1], '[^0-9]', '', 'g') AS BIGINT) * 1000) AS ts FROM h),
form1 AS (SELECT topic, "offset", left(hash, 20) AS event_id, CASE WHEN hash = '' THEN 'unknown' ELSE 'user_' || left(hash, 10) END AS user_id,
  CASE upper(action) WHEN 'ANSWER' THEN 'CALL_ANSWERED' WHEN 'PICKUP' THEN 'PICKUP' WHEN 'DELIVERY' THEN 'DELIVERY' WHEN 'SEND' THEN 'SMS_DELIVERY'
    WHEN 'RECEIVE' THEN 'SMS_REPLY' ELSE 'DROP' END AS event_type, ts,
  CASE upper(action) WHEN 'DROP' THEN 'MISSED' WHEN 'ANSWER' THEN 'COMPLETED' END AS call_result, 'kafka-colon-delimited' AS source, action, hash, value,
  CASE WHEN parts < 2 THEN 'too_few_parts' WHEN ts IS NULL THEN 'bad_timestamp' END AS reason FROM f)
"""


def _form1(t) -> DataFrame:
    md = F.col("metadata")
    return ingest.parse_hash_messages(t.raw_messages).withColumns({"action": md["action"], "hash": md["hash"]}).drop("metadata", "partition")


@question("b02_hash_messages_accepted", "raw_messages", "WITH " + FORM1 + "SELECT * EXCLUDE (reason) FROM form1 WHERE reason IS NULL")
def hash_accepted(t):
    return ingest.accepted(_form1(t))


@question("b02_hash_messages_quarantine", "raw_messages", "WITH " + FORM1 + """SELECT topic, "offset", value, reason FROM form1 WHERE reason IS NOT NULL""")
def hash_quarantine(t):
    return ingest.quarantined(_form1(t)).select("topic", "offset", "value", "reason")


FORM2 = """t AS (SELECT *, CASE WHEN len(string_split(regexp_replace(key, ':+$', ''), ':')) >= 3 AND string_split(key, ':')[1] LIKE '%@%' THEN key END AS from_key,
  CASE WHEN len(string_split(regexp_replace(value, ':+$', ''), ':')) >= 3 AND string_split(value, ':')[1] LIKE '%@%' THEN value END AS from_value FROM raw_messages),
u AS (SELECT *, coalesce(from_key, from_value) AS txt FROM t),
v AS (SELECT *, string_split(regexp_replace(txt, ':+$', ''), ':') AS p FROM u),
w AS (SELECT *, string_split(regexp_replace(p[1], '@+$', ''), '@') AS h,
  CASE WHEN regexp_full_match(p[3], '[+-]?[0-9]+') THEN try_cast(p[3] AS BIGINT) END AS contact_id FROM v),
x AS (SELECT *, make_timestamp(try_cast(regexp_replace(h[1], '[^0-9]', '', 'g') AS BIGINT) * 1000) AS ts FROM w),
form2 AS (SELECT topic, partition, "offset", sha256(topic || ':' || partition || ':' || "offset") AS event_id, h[2] AS user_id, p[2] AS event_type, contact_id, ts,
  CASE WHEN from_key IS NOT NULL THEN coalesce(value, '') ELSE txt END AS event_data, 'pekko-kafka-' || topic AS source, key, value,
  CASE WHEN txt IS NULL THEN 'no_structured_data' WHEN len(h) <> 2 THEN 'bad_time_user' WHEN contact_id IS NULL THEN 'bad_contact_id'
    WHEN ts IS NULL THEN 'bad_timestamp' END AS reason FROM x)
"""


@question(
    "b03_user_messages_accepted",
    "raw_messages",
    "WITH " + FORM2 + "SELECT * EXCLUDE (reason, key, value) FROM form2 WHERE reason IS NULL",
)
def user_accepted(t):
    return ingest.accepted(ingest.parse_user_messages(t.raw_messages)).drop("key", "value")


@question("b03_user_messages_quarantine", "raw_messages", "WITH " + FORM2 + """SELECT topic, "offset", key, value, reason FROM form2 WHERE reason IS NOT NULL""")
def user_quarantine(t):
    return ingest.quarantined(ingest.parse_user_messages(t.raw_messages)).select("topic", "offset", "key", "value", "reason")


@question("b04_action_types", "raw_messages", "WITH " + FORM1 + "SELECT action, event_type, count(*) AS n FROM form1 WHERE reason IS NULL GROUP BY ALL")
def action_types(t):
    return ingest.accepted(_form1(t)).groupBy("action", "event_type").agg(F.count(F.lit(1)).alias("n"))


@question("b05_derived_ids", "raw_messages", "WITH " + FORM1 + """SELECT "offset", hash, user_id, event_id FROM form1""")
def derived_ids(t):
    return _form1(t).select("offset", "hash", "user_id", "event_id")


@question(
    "b06_text_times",
    "raw_messages",
    """WITH d AS (SELECT "offset", try_cast(regexp_replace(string_split(string_split(value, ':')[1], '@')[1], '[^0-9]', '', 'g') AS BIGINT) AS ms FROM raw_messages)
    SELECT "offset", make_timestamp(ms * 1000) AS ts, CASE WHEN ms IS NULL THEN 'bad_timestamp' END AS reason FROM d""",
)
def text_times(t):
    head = F.get(parts(F.col("value"), ":"), F.lit(0))
    rows = t.raw_messages.select("offset", epoch_ms_time(F.get(parts(head, "@"), F.lit(0))).alias("ts"))
    return rows.withColumn("reason", F.when(F.col("ts").isNull(), "bad_timestamp"))


@question(
    "b07_receive_probe",
    "raw_messages",
    """WITH s AS (SELECT topic, CASE WHEN key LIKE '%:%' THEN key ELSE value END AS a, CASE WHEN key LIKE '%@%' THEN key ELSE value END AS b FROM raw_messages)
    SELECT topic, coalesce(string_split(regexp_replace(a, ':+$', ''), ':')[2], 'UNKNOWN') AS event_type,
      coalesce(string_split(string_split(regexp_replace(b, '@+$', ''), '@')[2], ':')[1], 'unknown-user') AS user_id, count(*) AS n FROM s GROUP BY ALL""",
)
def receive_probe(t):
    return ingest.receive_probe(t.raw_messages).groupBy("topic", "event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@question(
    "b08_drop_unparsable",
    "raw_messages",
    "WITH " + FORM2 + "SELECT topic, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS dropped, count(*) AS received FROM form2 GROUP BY topic",
)
def drop_unparsable(t):
    bad = F.col("reason").isNotNull()
    return ingest.parse_user_messages(t.raw_messages).groupBy("topic").agg(
        F.count_if(~bad).alias("kept"), F.count_if(bad).alias("dropped"), F.count(F.lit(1)).alias("received")
    )


# ---------------------------------------------------------------------- validity

REASON = f"""CASE WHEN coalesce(regexp_matches(user_id, '[^\\x00-\\x20]'), FALSE) IS FALSE THEN 'missing_user' WHEN event_type IS NULL THEN 'missing_type'
  WHEN ts IS NULL THEN 'missing_timestamp' WHEN event_id IS NULL THEN 'missing_event_id' WHEN event_type NOT IN {DOMAIN} THEN 'unknown_type'
  WHEN event_type NOT IN {ENGAGED} THEN 'not_an_engagement_type' END"""


@question(
    "b09_event_validity",
    "comm_events",
    f"""SELECT event_id, user_id, event_type, {CHANNEL} AS channel, {BASE_VALID} AS is_base_valid,
    {BASE_VALID} AND coalesce(event_type IN {ENGAGED}, FALSE) AS is_engagement_valid,
    coalesce(regexp_matches(user_id, '[^\\x00-\\x20]') AND trim(event_type) <> '' AND contact_id > 0, FALSE) AS is_flat_valid, {REASON} AS reason FROM comm_events""",
)
def event_validity(t):
    return q.validity(t.comm_events).select(
        "event_id", "user_id", "event_type", "channel", "is_base_valid", "is_engagement_valid", "is_flat_valid", "reason"
    )


@question("b09_reason_counts", "comm_events", f"SELECT coalesce({REASON}, 'valid') AS reason, count(*) AS n FROM comm_events GROUP BY 1")
def reason_counts(t):
    return t.comm_events.groupBy(F.coalesce(q.invalid_reason(), F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@question(
    "b09_ownership",
    "raw_messages",
    "WITH " + FORM2 + "SELECT coalesce(key <> user_id, TRUE) AS is_mismatch, count(*) AS n FROM form2 WHERE reason IS NULL GROUP BY ALL",
)
def ownership(t):
    rows = ingest.accepted(ingest.parse_user_messages(t.raw_messages))
    return rows.groupBy(q.owner_mismatch(F.col("key"), F.col("user_id")).alias("is_mismatch")).agg(F.count(F.lit(1)).alias("n"))


_URI = "^[A-Za-z][A-Za-z0-9+.-]*:[^\\s]*$"
_MAIL = "^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"
_PHONE = "^\\+?[1-9][0-9]{1,14}$"
_CHECKS = [
    # (order, channel, field, code, condition); fields the table lacks are absent from every row
    *[(c, f, "required", f"{f} IS NULL") for c in ("EMAIL", "SMS", "CALL") for f in ("user_id", "event_id", "ts", "event_type")],
    ("NONE", "event_type", "required", "event_type IS NULL"),
    ("OTHER", "event_type", "enum", f"event_type NOT IN {DOMAIN}"),
    ("EMAIL", "email_address", "required", "email_address IS NULL"),
    ("SMS", "phone_number", "required", "phone_number IS NULL"),
    ("CALL", "phone_number", "required", "phone_number IS NULL"),
    *[(c, f, "min_length", f"length({f}) < 1") for c in ("EMAIL", "SMS", "CALL") for f in ("user_id", "event_id")],
    ("EMAIL", "event_type", "enum", "event_type NOT IN ('EMAIL_OPEN', 'EMAIL_CLICK', 'EMAIL_BOUNCE', 'EMAIL_DELIVERY')"),
    ("SMS", "event_type", "enum", "event_type NOT IN ('SMS_REPLY', 'SMS_DELIVERY', 'SMS_BOUNCE', 'SMS_CLICK')"),
    ("CALL", "event_type", "enum", "event_type NOT IN ('CALL_COMPLETED', 'CALL_MISSED', 'CALL_ANSWERED', 'CALL_BUSY')"),
    ("EMAIL", "email_address", "format", f"NOT regexp_matches(email_address, '{_MAIL}')"),
    ("EMAIL", "link_url", "format", f"NOT regexp_matches(link_url, '{_URI}')"),
    ("EMAIL", "link_url", "required_when", "event_type = 'EMAIL_CLICK' AND link_url IS NULL"),
    ("EMAIL", "bounce_reason", "required_when", "event_type = 'EMAIL_BOUNCE'"),
    ("SMS", "phone_number", "pattern", f"NOT regexp_matches(phone_number, '{_PHONE}')"),
    ("CALL", "phone_number", "pattern", f"NOT regexp_matches(phone_number, '{_PHONE}')"),
    ("SMS", "message_content", "max_length", "FALSE"),
    ("SMS", "reply_content", "max_length", "FALSE"),
    ("SMS", "short_code", "pattern", "FALSE"),
    ("SMS", "delivery_status", "enum", "FALSE"),
    ("SMS", "reply_content", "required_when", "event_type = 'SMS_REPLY'"),
    ("SMS", "delivery_status", "required_when", "event_type = 'SMS_DELIVERY'"),
    ("CALL", "duration_seconds", "range", "duration_seconds NOT BETWEEN 0 AND 86400"),
    ("CALL", "call_direction", "enum", "FALSE"),
    ("CALL", "disconnect_reason", "enum", "FALSE"),
    ("CALL", "call_quality", "enum", "FALSE"),
    ("CALL", "recording_url", "format", "FALSE"),
    ("CALL", "duration_seconds", "required_when", "event_type = 'CALL_COMPLETED' AND duration_seconds IS NULL"),
    ("CALL", "duration_seconds", "range_when", "event_type = 'CALL_COMPLETED' AND duration_seconds < 1"),
]
_TAGGED = f"tagged AS (SELECT *, coalesce({CHANNEL}, 'NONE') AS ch FROM comm_events)"
_VIOLATIONS = "violations AS (" + "\n UNION ALL ".join(
    f"SELECT event_id, ch AS channel, '{f}' AS field, '{c}' AS code FROM tagged WHERE ch = '{ch}' AND ({cond})" for ch, f, c, cond in _CHECKS
) + ")"
_REPORT = "\n UNION ALL ".join(
    f"SELECT '{f}.{c}' AS rule, '{ch}' AS channel, count(*) FILTER (ch = '{ch}') AS checked, count(*) FILTER (ch = '{ch}' AND ({cond})) AS violations FROM tagged"
    for ch, f, c, cond in _CHECKS
)


@question("b10_dq_report", "comm_events", f"WITH {_TAGGED} {_REPORT}")
def dq_report(t):
    return q.dq_report(t.comm_events)


@question("b10_dq_violations", "comm_events", f"WITH {_TAGGED}, {_VIOLATIONS} SELECT event_id, channel, field, code FROM violations")
def dq_violations(t):
    return q.dq_violations(t.comm_events)


@question(
    "b10_dq_messages",
    "comm_events",
    f"""WITH {_TAGGED}, {_VIOLATIONS}, parts AS (SELECT event_id, string_split(message, ', ') AS p FROM
      (SELECT event_id, string_agg(field || ': ' || code, ', ' ORDER BY field, code) AS message FROM violations GROUP BY event_id))
    SELECT event_id, 'Validation failed: ' || array_to_string(p, ', ') AS message FROM parts""",
)
def dq_messages(t):
    # The check sorts the parts of a message; their order here is the order of the rules.
    rows = q.dq_messages(t.comm_events)
    body = F.split(F.substring_index("message", "Validation failed: ", -1), ", ")
    return rows.select("event_id", F.concat(F.lit("Validation failed: "), F.array_join(F.array_sort(body), ", ")).alias("message"))


@question(
    "b11_known_types",
    "comm_events",
    f"""SELECT event_type AS given_type, CASE WHEN upper(event_type) IN {DOMAIN} THEN upper(event_type) ELSE 'EMAIL_DELIVERY' END AS event_type, count(*) AS n
    FROM comm_events GROUP BY ALL""",
)
def known_types(t):
    return t.comm_events.groupBy(
        F.col("event_type").alias("given_type"), ingest.known_type(F.col("event_type")).alias("known")
    ).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("known", "event_type")


@question(
    "b12_defaults",
    "comm_events",
    """SELECT event_id, coalesce(ts, (SELECT max(ts) FROM comm_events)) AS ts, 'http' AS source, user_id, event_type FROM comm_events""",
)
def defaults(t):
    ev = t.comm_events
    return ingest.fill_defaults(ev, "http", as_of(ev)).select("event_id", "ts", "source", "user_id", "event_type")


@question("b13_flat_events", "comm_events", "SELECT user_id, event_type, contact_id, ts, event_data, event_id FROM comm_events")
def flat_events(t):
    return ingest.to_flat(t.comm_events)


@question(
    "b14_distinct_events",
    "comm_events",
    """SELECT DISTINCT user_id, event_type, contact_id, ts, coalesce(user_id, 'null') || ':' || coalesce(event_type, 'null') || ':' || contact_id AS natural_key
    FROM comm_events""",
)
def distinct_events(t):
    return ingest.distinct_events(t.comm_events)


@question(
    "b15_payload_types",
    "raw_messages",
    """WITH f AS (SELECT "offset", value, CASE WHEN value LIKE '%"eventType":%' THEN nullif(regexp_extract(value, '"eventType"\\s*:\\s*"([^"]+)"', 1), '') END AS f FROM raw_messages)
    SELECT "offset", coalesce(CASE f WHEN 'EMAIL_DELIVERY' THEN 'EMAIL' WHEN 'SMS_DELIVERY' THEN 'SMS' WHEN 'CALL_DELIVERY' THEN 'CALL' WHEN 'DROP_EVENT' THEN 'DROP' END, f,
      CASE WHEN value LIKE '%DROP%' THEN 'DROP' WHEN value LIKE '%EMAIL%' THEN 'EMAIL' WHEN value LIKE '%SMS%' THEN 'SMS' WHEN value LIKE '%CALL%' THEN 'CALL'
        WHEN value LIKE '%PICKUP%' THEN 'PICKUP' WHEN value LIKE '%DELIVERY%' THEN 'DELIVERY' END) AS payload_type FROM f""",
)
def payload_types(t):
    return t.raw_messages.select("offset", ingest.payload_type(F.col("value")).alias("payload_type"))


@question(
    "b16_event_lines",
    "journal",
    f"""WITH k AS (SELECT DISTINCT persistence_id, event_type FROM journal)
    SELECT persistence_id, event_type, {EVENT_LINE.format(user='(' + DISPLAY_ID.format(id='persistence_id') + ')', type='event_type')} AS line FROM k""",
)
def event_lines(t):
    rows = t.journal.select("persistence_id", "event_type").distinct()
    return rows.withColumn("line", ingest.event_line(F.col("event_type"), ingest.display_id(F.col("persistence_id"))))


@question(
    "b17_display_ids",
    "raw_messages journal",
    "WITH " + FORM2 + f""", ids AS (SELECT DISTINCT persistence_id AS id FROM journal UNION SELECT event_id FROM form2)
    SELECT id, {DISPLAY_ID.format(id='id')} AS display_id FROM ids""",
)
def display_ids(t):
    ids = t.journal.select(F.col("persistence_id").alias("id")).unionByName(
        ingest.parse_user_messages(t.raw_messages).select(F.col("event_id").alias("id"))
    )
    return ids.distinct().withColumn("display_id", ingest.display_id(F.col("id")))


@question(
    "b18_journal_users",
    "journal",
    """SELECT persistence_id, split_part(persistence_id, '|', -1) AS user_id, count(*) AS n FROM journal
    WHERE starts_with(persistence_id, 'PersistentUserActor|') GROUP BY ALL""",
)
def journal_users(t):
    return ingest.user_journal(t.journal).groupBy("persistence_id", "user_id").agg(F.count(F.lit(1)).alias("n"))


@question(
    "b19_topic_fanout",
    "comm_events",
    """SELECT event_id || '-' || topic AS event_id, topic, 'pekko-kafka-' || topic AS source, user_id, event_type
    FROM comm_events, (SELECT unnest(['call-queue', 'digital-queue']) AS topic) AS x""",
)
def topic_fanout(t):
    return ingest.fan_out(t.comm_events, ["call-queue", "digital-queue"]).select("event_id", "topic", "source", "user_id", "event_type")
