"""Questions answered by streams: each drains its input and returns the final table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from rillbook.functions.clock import as_of, span
from rillbook.operators import state as s
from rillbook.plans.ingest_questions import ACTION_SQL, FORM1, FORM2, ROUTED_SQL, UPDATES_SQL
from rillbook.plans.monitor_questions import ALERTS, SEQUENCE, SIX_HOURS_MS
from rillbook.plans.registry import question
from rillbook.plans.sqltext import BASE_VALID, DOMAIN, TYPE_COUNTS
from rillbook.sources import sinks
from rillbook.sources.messages import file_stream
from rillbook.sources.storage import read_batches, scratch
from rillbook.streaming import flow, jobs


def _staged(t, df: DataFrame, name: str, files: int | None = None) -> tuple[str, str]:
    """Write a derived table as the files a stream will read; returns ``(input, base folder)``."""
    base = scratch(t.spark, name)
    (df.repartition(files) if files else df).write.parquet(f"{base}/in")
    return f"{base}/in", base


def _stream(t, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path, base = _staged(t, df, name)
    return t.spark.readStream.schema(df.schema).parquet(path), base


def _table(t, stream: DataFrame, base: str, **kw) -> DataFrame:
    """Drain a stream into a table and read it."""
    jobs.finish(jobs.start_table(stream, f"{base}/out", f"{base}/checkpoint", **kw))
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


# --------------------------------------------------------------- sources and ingest


@question(
    "a01_json_topic_stream",
    "comm_events",
    ROUTED_SQL + """SELECT r.topic, c.event_id, c.user_id, c.event_type, date_trunc('second', c.ts) AS ts
    FROM routed r JOIN comm_events c ON json_extract_string(r.value, '$.eventId') = c.event_id WHERE r.topic IS NOT NULL""",
)
def json_topic_stream(t):
    out = sinks.routed(t.comm_events).filter(F.col("topic").isNotNull())
    messages = out.select(
        "topic", F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"), "key", "value"
    )
    path, base = _staged(t, messages, "a01")
    raw = file_stream(t.spark, path, list(sinks.TOPICS.values()))
    rows = jobs.decoded_json(raw).filter(F.col("outcome") == "accepted").select("topic", "event_id", "user_id", "event_type", "ts")
    return _table(t, rows, base)


@question("a02_queue_stream", "raw_messages", """SELECT topic, partition, "offset", key, value FROM raw_messages""")
def queue_stream(t):
    path, base = _staged(t, t.raw_messages, "a02")
    return _table(t, file_stream(t.spark, path, ["call-queue", "digital-queue"]), base)


def _decoded(t, name: str) -> DataFrame:
    path, base = _staged(t, t.raw_messages, name)
    return _table(t, jobs.decoded(file_stream(t.spark, path)), base, by=("outcome",))


@question(
    "i01_continuous_ingest",
    "raw_messages",
    "WITH " + FORM2 + """SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM form2 WHERE reason IS NULL GROUP BY 1, 2""",
)
def continuous_ingest(t):
    rows = _decoded(t, "i01").filter(F.col("outcome") == "accepted")
    return s.user_type_counts(rows)


@question(
    "i09_bad_record_quarantine",
    "raw_messages",
    "WITH " + FORM2 + "SELECT topic, reason, count(*) AS n FROM form2 WHERE reason IS NOT NULL GROUP BY 1, 2",
)
def bad_record_quarantine(t):
    rows = _decoded(t, "i09").filter(F.col("outcome") == "quarantined")
    return rows.groupBy("topic", "reason").agg(F.count(F.lit(1)).alias("n"))


@question("i07_bounded_intake", "raw_messages", "SELECT CAST(4 AS BIGINT) AS batches, count(*) AS messages FROM raw_messages")
def bounded_intake(t):
    path, base = _staged(t, t.raw_messages, "i07", files=8)
    stream = file_stream(t.spark, path, max_files=2)
    jobs.finish(jobs.start_batches(stream, jobs.write_updates(f"{base}/out"), f"{base}/checkpoint"))
    done = read_batches(t.spark, f"{base}/out", stream.schema)
    return done.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("batches"), F.sum("n").alias("messages")
    )


@question(
    "i12_restart",
    "raw_messages",
    "WITH " + FORM2 + "SELECT reason IS NULL AS is_accepted, count(*) AS n FROM form2 GROUP BY 1",
)
def restart(t):
    """The job stops after part of the input and goes on from its checkpoint when more has come."""
    base = scratch(t.spark, "i12")
    raw = t.raw_messages
    first = F.col("topic") == "call-queue"
    for part in (raw.filter(first), raw.filter(~first)):
        part.write.mode("append").parquet(f"{base}/in")
        out = _table(t, jobs.decoded(file_stream(t.spark, f"{base}/in")), base, by=("outcome",))
    return out.groupBy((F.col("outcome") == "accepted").alias("is_accepted")).agg(F.count(F.lit(1)).alias("n"))


@question(
    "a09_result_stream",
    "stage_log",
    f"""WITH r AS (SELECT *, {ACTION_SQL} AS action FROM stage_log)
    SELECT seq, CASE WHEN ok THEN 'processed' ELSE 'failed' END AS stored_in,
      CASE WHEN ok THEN 'SUCCESS' WHEN action LIKE 'RETRY%' AND attempt < 3 THEN 'RETRY' ELSE 'FAILED' END AS status FROM r""",
)
def result_stream(t):
    stream, base = _stream(t, t.stage_log, "a09s")
    jobs.finish(jobs.start_batches(stream, jobs.write_results(f"{base}/out"), f"{base}/checkpoint"))
    schema = sinks.with_outcome(t.stage_log).schema
    both = [read_batches(t.spark, f"{base}/out/{name}", schema).withColumn("stored_in", F.lit(name)) for name in ("processed", "failed")]
    return both[0].unionByName(both[1]).select("seq", "stored_in", "status")


# ----------------------------------------------------------------------- user state


@question("i02_stream_user_state", "comm_events", "WITH " + TYPE_COUNTS + "SELECT * FROM type_counts")
def stream_user_state(t):
    stream, base = _stream(t, t.comm_events, "i02")
    folded = jobs.user_type_fold(stream)
    jobs.finish(jobs.start_batches(folded, jobs.write_updates(f"{base}/out"), f"{base}/checkpoint", mode="update"))
    return jobs.latest_update(read_batches(t.spark, f"{base}/out", folded.schema), ["user_id", "event_type"])


@question("i03_stream_sequence_labels", "comm_events", "WITH " + SEQUENCE + "SELECT * FROM checked")
def stream_sequence_labels(t):
    stream, base = _stream(t, t.comm_events, "i03")
    return _table(t, jobs.sequence_labels(stream, SIX_HOURS_MS), base)


@question(
    "i04_late_labels",
    "comm_events",
    "WITH " + SEQUENCE + "SELECT label, count(*) AS n, max(late_ms) AS max_late_ms FROM checked GROUP BY 1",
)
def late_labels(t):
    stream, base = _stream(t, t.comm_events, "i04")
    labelled = jobs.sequence_labels(stream, SIX_HOURS_MS)
    jobs.finish(jobs.start_batches(labelled, jobs.write_by(f"{base}/out", "label"), f"{base}/checkpoint"))
    rows = t.spark.read.schema("seq BIGINT, late_ms BIGINT, label STRING").parquet(f"{base}/out")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("late_ms").alias("max_late_ms"))


@question(
    "i05_user_order",
    "raw_messages",
    "WITH " + FORM2 + """SELECT user_id, "offset", event_type, row_number() OVER (PARTITION BY user_id ORDER BY "offset") AS position FROM form2 WHERE reason IS NULL""",
)
def user_order(t):
    path, base = _staged(t, t.raw_messages, "i05")
    rows = jobs.decoded(file_stream(t.spark, path)).filter(F.col("outcome") == "accepted")
    return _table(t, jobs.user_positions(rows), base)


# ------------------------------------------------------------ the whole pipeline

#: How late an event may be, how long messages wait for earlier ones, and micro-batches of the input.
FLOW_LATE, FLOW_DELAY, FLOW_BATCHES = timedelta(hours=2), timedelta(minutes=15), 3
#: Messages of one file of a micro-batch.
FLOW_FILE_ROWS = 100_000
#: A message is taken in every ten seconds, up to ten minutes late.
RECEIVED_US = '(1704067200 + "offset" * 10 + ("offset" * 7919) % 600) * 1000000'

FLOW_SQL = "WITH " + FORM2 + ", " + FORM1 + f""", j AS (SELECT topic, partition, "offset", value, json_valid(value) AS ok FROM raw_messages WHERE value LIKE '{{%'),
    all_forms AS (
      SELECT topic, partition, "offset", value, 'user' AS form, event_id, user_id, event_type, contact_id, ts, reason FROM form2 WHERE reason IS DISTINCT FROM 'no_structured_data'
      UNION ALL SELECT topic, partition, "offset", value, 'json', CASE WHEN ok THEN value->>'$.eventId' END, CASE WHEN ok THEN value->>'$.userId' END, CASE WHEN ok THEN value->>'$.eventType' END,
        NULL, CASE WHEN ok THEN try_cast(value->>'$.timestamp' AS TIMESTAMP) END, CASE WHEN NOT ok THEN 'bad_json' END FROM j
      UNION ALL SELECT g.topic, g.partition, g."offset", g.value, 'hash', f.event_id, f.user_id, f.event_type, NULL, f.ts, f.reason
        FROM form1 f JOIN form2 g ON f.topic = g.topic AND f."offset" = g."offset" WHERE g.reason = 'no_structured_data'),
    checked AS (SELECT * EXCLUDE (reason), {RECEIVED_US} AS received_us,
      coalesce(reason, CASE WHEN NOT coalesce(regexp_matches(user_id, '[^\x00-\x20]'), FALSE) THEN 'missing_user' WHEN NOT coalesce(regexp_matches(event_id, '[^\x00-\x20]'), FALSE) THEN 'missing_event_id'
        WHEN ts IS NULL THEN 'missing_timestamp' WHEN NOT coalesce(event_type IN {DOMAIN}, FALSE) THEN 'unknown_type' END) AS reason FROM all_forms),
    placed AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER w END AS sequence_nr,
      CASE WHEN reason IS NULL THEN max(ts) OVER (PARTITION BY user_id, reason IS NULL ORDER BY received_us, topic, partition, "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS newest
      FROM checked WINDOW w AS (PARTITION BY user_id, reason IS NULL ORDER BY received_us, topic, partition, "offset")),
    labelled AS (SELECT *, CASE WHEN newest > ts THEN (epoch_us(newest) - epoch_us(ts)) // 1000 END AS late_ms FROM placed)
    """


def _flow(t, name: str) -> tuple[DataFrame, str]:
    """Messages with receive times as files in turn, the last one a heartbeat, and the folder of the pipeline."""
    base = scratch(t.spark, name)
    seconds = 1704067200 + F.col("offset") * 10 + F.pmod(F.col("offset") * 7919, F.lit(600))
    rows = t.raw_messages.withColumn("received", F.timestamp_seconds(seconds))
    last = rows.agg(F.max("offset").alias("last")).select(F.coalesce("last", F.lit(0)).alias("last"))
    placed = rows.crossJoin(F.broadcast(last)).withColumn("part", F.least(F.floor(F.col("offset") * FLOW_BATCHES / (F.col("last") + 1)), F.lit(FLOW_BATCHES - 1))).drop("last")
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    # Every micro-batch has this number of files; no part has so few rows that one of them would be left out.
    files = max(1, min(sizes.get(i, 0) for i in range(FLOW_BATCHES)) // FLOW_FILE_ROWS)
    for i in range(FLOW_BATCHES):
        part = placed.filter(F.col("part") == i).drop("part")
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(f"{base}/in")
    beat = last.select(
        F.lit(flow.HEARTBEAT).alias("topic"), F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"), F.lit(None).cast("string").alias("key"),
        F.lit(None).cast("string").alias("value"), F.timestamp_seconds(F.col("last") * 10 + 1704067200 + 86400).alias("received"),
    )
    beat.write.mode("append").parquet(f"{base}/in")
    return file_stream(t.spark, f"{base}/in", max_files=files, with_time=True), base


def _pipeline(t, name: str) -> str:
    raw, base = _flow(t, name)
    jobs.finish(flow.start_pipeline(raw, f"{base}/out", f"{base}/checkpoint", int(FLOW_LATE.total_seconds() * 1000), FLOW_DELAY, spread=8))
    return f"{base}/out"


@question(
    "i01_pipeline_results",
    "raw_messages",
    FLOW_SQL + f"""SELECT CASE WHEN reason IS NULL THEN 'success' WHEN reason = 'bad_json' THEN 'retry' ELSE 'failed' END AS stored_in, topic, partition, "offset",
      make_timestamp(received_us) AS received, form, reason, CASE WHEN reason IS NULL THEN user_id END AS user_id, CASE WHEN reason IS NULL THEN event_type END AS event_type,
      CASE WHEN reason IS NOT NULL THEN NULL WHEN late_ms > {int(FLOW_LATE.total_seconds() * 1000)} THEN 'INVALID' WHEN late_ms IS NOT NULL THEN 'WARNING' ELSE 'VALID' END AS label,
      CASE WHEN reason IS NULL THEN late_ms END AS late_ms, sequence_nr FROM labelled""",
)
def pipeline_results(t):
    """Every message in exactly one table of the pipeline."""
    path = _pipeline(t, "i01-results")
    names = ["topic", "partition", "offset", "received", "form", "reason", "user_id", "event_type", "label", "late_ms", "sequence_nr"]
    kinds = dict(flow.pipeline_table(t.spark, path, "success").dtypes) | {"reason": "string"}
    out = None
    for name in ("success", "failed", "retry", "behind"):
        rows = flow.pipeline_table(t.spark, path, name)
        rows = rows.select(F.lit(name).alias("stored_in"), *[F.col(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names])
        out = rows if out is None else out.unionByName(rows)
    return out


@question(
    "i01_pipeline_state",
    "raw_messages",
    FLOW_SQL + "SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM labelled WHERE reason IS NULL GROUP BY 1, 2",
)
def pipeline_state(t):
    return flow.current_state(t.spark, _pipeline(t, "i01-state"))


@question(
    "i05_receive_order",
    "raw_messages",
    FLOW_SQL + """SELECT user_id, topic, partition, "offset", event_type, sequence_nr AS position FROM labelled WHERE reason IS NULL""",
)
def receive_order(t):
    """Positions of a user's events over all topics, in the order of their receive times."""
    path = _pipeline(t, "i05-order")
    return flow.pipeline_table(t.spark, path, "success").select("user_id", "topic", "partition", "offset", "event_type", F.col("sequence_nr").alias("position"))


@question(
    "i06_idle_users",
    "comm_events",
    f"""SELECT user_id, max(ts) AS last_ts, count(*) AS events FROM comm_events WHERE {BASE_VALID} GROUP BY 1
    HAVING date_trunc('millisecond', max(ts)) + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM comm_events WHERE {BASE_VALID})""",
)
def idle_users(t):
    stream, base = _stream(t, t.comm_events, "i06")
    idle = _table(t, jobs.idle_users(stream), base)
    return idle.withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@question("i13_update_notifications", "comm_events", UPDATES_SQL + "SELECT * FROM updates")
def update_notifications(t):
    stream, base = _stream(t, t.comm_events, "i13")
    updates = jobs.channel_updates(stream)
    jobs.finish(jobs.start_batches(updates, jobs.write_feeds(f"{base}/out"), f"{base}/checkpoint"))
    sent = read_batches(t.spark, f"{base}/out/aggregation-updates", updates.schema).drop("batch_id")
    return sent.withColumn("last_updated", F.col("last_updated").cast("timestamp_ntz"))


# -------------------------------------------------------------------------- windows


def _window_sql(size: str) -> str:
    return f"""WITH k AS (SELECT time_bucket(INTERVAL '{size}', ts) AS window_start, count(*) AS events FROM comm_events WHERE ts IS NOT NULL GROUP BY 1)
    SELECT window_start, window_start + INTERVAL '{size}' AS window_end, events FROM k
    WHERE window_start + INTERVAL '{size}' <= (SELECT date_trunc('millisecond', max(ts)) FROM comm_events) - INTERVAL 10 MINUTE"""


def _window_question(name: str, size: str):
    @question(name, "comm_events", _window_sql(size))
    def job(t):
        stream, base = _stream(t, t.comm_events, name[:3])
        return _table(t, jobs.windowed_counts(stream, size), base)

    return job


minute_windows = _window_question("i08_minute_windows", "1 minute")
five_minute_windows = _window_question("i08_five_minute_windows", "5 minutes")
hour_windows = _window_question("i08_hour_windows", "1 hour")


@question(
    "i11_rolling_hour",
    "comm_events",
    """WITH k AS (SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, count(*) AS events FROM comm_events WHERE ts IS NOT NULL GROUP BY 1)
    SELECT window_start, window_start + INTERVAL 1 MINUTE AS window_end, events FROM k
    WHERE window_start + INTERVAL 1 MINUTE > (SELECT max(ts) FROM comm_events) - INTERVAL 1 HOUR""",
)
def rolling_hour(t):
    stream, base = _stream(t, t.comm_events, "i11")
    minutes = jobs.recent_minutes(stream)
    jobs.finish(jobs.start_batches(minutes, jobs.write_updates(f"{base}/out"), f"{base}/checkpoint", mode="update"))
    kept = jobs.latest_update(read_batches(t.spark, f"{base}/out", minutes.schema), ["window_start", "window_end"])
    return kept.filter(F.col("window_end") > as_of(t.comm_events) - span(timedelta(hours=1)))


#: Samples of a micro-batch: an alert type's readings in one are one task, so this bounds its memory.
ALERT_ROWS = 2_000_000


@question(
    "i10_stream_alerts",
    "samples",
    ALERTS + """SELECT alert_type, seq, ts, value, 'RAISED' AS event FROM raised
    UNION ALL SELECT alert_type, seq, ts, value, 'CLEARED' FROM r WHERE NOT breach AND after_breach""",
)
def stream_alerts(t):
    rows, base = t.samples, scratch(t.spark, "i10")
    _in_time_order(rows, base, -(-rows.count() // ALERT_ROWS))
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return _table(t, jobs.alert_stream(stream), base).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _in_time_order(rows: DataFrame, base: str, parts: int) -> None:
    """Stage samples as they come in: files one after the other, each of about equally many rows and later than the last."""
    if parts <= 1:
        rows.coalesce(1).write.parquet(f"{base}/in")
        return
    dealt = rows.repartitionByRange(parts, F.asc_nulls_last("ts"), "seq").withColumn("part", F.spark_partition_id())
    dealt.write.partitionBy("part").parquet(f"{base}/dealt")
    dealt = rows.sparkSession.read.schema(dealt.schema).parquet(f"{base}/dealt")
    for i in range(parts):
        dealt.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{base}/in")
