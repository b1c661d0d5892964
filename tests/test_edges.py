"""Edge cases on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rillbook.operators import activity, alerts, ingest, journal, journal_store, migration, monitoring, profiles, quality, sequence, state
from rillbook.sources import messages, sinks, storage
from rillbook.sources.storage import scratch

T0 = dt.datetime(2024, 1, 1)
EVENT = "seq long, event_id string, user_id string, event_type string, ts timestamp_ntz, contact_id long"
LOG = (
    "seq long, ts timestamp_ntz, user_id string, event_type string, stage string, ok boolean, processing_ms long, "
    "error_message string, error_code int, sql_state string, attempt int"
)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def events(spark, rows):
    """rows: (user, type, second or None)"""
    data = [(i, f"e{i}", u, t, None if s is None else at(s), 1) for i, (u, t, s) in enumerate(rows)]
    return spark.createDataFrame(data, EVENT)


def log(spark, rows):
    """rows: (stage, ok, message)"""
    data = [(i, at(i), "u", "x", s, ok, 100, m, 0, None, 0) for i, (s, ok, m) in enumerate(rows)]
    return spark.createDataFrame(data, LOG)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# ----------------------------------------------------------------- user state


def test_empty_input(spark):
    none = events(spark, [])
    counts = state.user_type_counts(none)
    assert counts.collect() == []
    assert tuple(one(state.totals(counts))) == (0, 0, 0.0)
    assert state.engagement_report(none).collect() == []
    assert activity.type_breakdown(counts).collect() == []


def test_open_rate_divides_by_sms_deliveries(spark):
    r = one(state.with_rates(state.user_engagement(events(spark, [("a", "EMAIL_OPEN", i) for i in range(3)] + [("a", "SMS_DELIVERY", 9)]))))
    assert r.email_open_rate == 3.0 and r.total_events == 4
    r = one(state.with_rates(state.user_engagement(events(spark, [("a", "EMAIL_OPEN", 1)]))))
    assert r.email_open_rate == 0.0


def test_read_model_drops_a_rate_that_does_not_fit(spark):
    ev = events(spark, [("a", "EMAIL_OPEN", i) for i in range(10)] + [("a", "SMS_DELIVERY", 99)])
    assert one(state.read_model(state.user_engagement(ev))).email_open_rate is None


def test_missing_time_is_counted_but_moves_nothing(spark):
    r = one(state.user_type_counts(events(spark, [("a", "DROP", None), ("a", "DROP", 5), (None, "DROP", 1), ("b", None, 1)])))
    assert (r.n, r.first_ts, r.last_ts) == (2, at(5), at(5))


def test_other_types_leave_engagement_unchanged(spark):
    r = one(state.user_engagement(events(spark, [("a", "LOGIN", 1)])))
    assert r.email_opens == 0 and r.last_activity is None


def test_flags(spark):
    ev = events(spark, [("a", "CALL_COMPLETED", 0)] * 11 + [("b", "CALL_MISSED", 8 * 86400)])
    rows = {r.user_id: r for r in state.engagement_report(ev).collect()}
    assert (rows["a"].recently_active, rows["a"].high_engagement, rows["a"].hot_user) == (False, True, True)
    assert (rows["b"].recently_active, rows["b"].high_engagement, rows["b"].hot_user) == (True, False, False)
    assert state.engagement_report(ev, as_of=at(1)).filter("recently_active").count() == 2


def test_recent_events_are_capped_at_the_newest_hundred(spark):
    ev = events(spark, [("a", "DROP", i) for i in range(130)])
    assert one(state.recent_stats(ev, F.lit(at(129)).cast("timestamp_ntz"))).recent_events == 100


def test_contactable_updates(spark):
    users = spark.createDataFrame([("a",), ("b",)], "user_id string")
    ups = spark.createDataFrame(
        [(1, "a", "SUPPRESSED", "n1", at(1)), (2, "a", "OPTED_OUT", "n2", at(1)), (3, "a", None, "n3", at(9)), (4, "b", "BOGUS", "n", at(1))],
        "seq long, user_id string, contactable_status string, graph_node string, processing_ts timestamp_ntz",
    )
    rows = {r.user_id: r for r in state.apply_contactable(users, ups).collect()}
    assert (rows["a"].contactable_status, rows["a"].current_graph_node, rows["a"].processing_count) == ("OPTED_OUT", "n2", 2)
    assert (rows["b"].contactable_status, rows["b"].processing_count) == ("PENDING_REVIEW", 0)
    assert sorted(r.reason for r in state.contactable_rejects(ups).collect()) == ["missing_status", "unknown_status"]


def test_string_hash_is_that_of_the_jvm(spark):
    texts = ["user1", "a longer user id with spaces", "", "polygenelubricants"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = {r.t: (r.h, r.s) for r in df.select("t", state.java_hash(F.col("t")).alias("h"), state.shard_of(F.col("t"), 100).alias("s")).collect()}
    for x in texts:
        h = 0
        for ch in x:
            h = (31 * h + ord(ch)) & 0xFFFFFFFF
        assert got[x][0] == (h - (1 << 32) if h >= 1 << 31 else h)
    # Known values: the hash of "user1" is 111578566, and one text has the smallest integer.
    assert got["user1"][0] == 111578566
    assert got["polygenelubricants"] == (-2147483648, -48)


# --------------------------------------------------------------------- journal


def journal_rows(spark, n, user="a"):
    return spark.createDataFrame(
        [(f"PersistentUserActor|{user}", i, ["X", "Y"][i % 2], None, at(i), i) for i in range(1, n + 1)],
        "persistence_id string, sequence_nr long, event_type string, event_data string, ts timestamp_ntz, seq long",
    )


@pytest.mark.parametrize("n,points,tail", [(49, [], 49), (50, [50], 0), (51, [50], 1), (420, [200, 250, 300, 350, 400], 20)])
def test_snapshot_points(spark, n, points, tail):
    jr = journal_rows(spark, n)
    snap = journal.snapshots(jr)
    assert [r[0] for r in snap.select("snapshot_nr").distinct().orderBy("snapshot_nr").collect()] == points
    live = journal.live_journal(jr)
    assert live.count() == tail
    a = sorted(map(tuple, journal.restore(snap, live).collect()))
    assert a == sorted(map(tuple, journal.replay(jr).collect()))


def test_append_keeps_keys_unique(spark):
    path = scratch(spark, "append")
    assert journal_store.stored_journal(spark, path) is None
    journal_store.append_journal(journal_rows(spark, 3), path)
    twice = journal_rows(spark, 5).unionByName(journal_rows(spark, 5).withColumn("seq", F.col("seq") + 100))
    journal_store.append_journal(twice, path)
    stored = journal_store.stored_journal(spark, path)
    assert sorted((r.sequence_nr, r.seq) for r in stored.collect()) == [(i, i) for i in range(1, 6)]
    refused = spark.read.parquet(journal_store.conflicts_path(path))
    assert sorted(r.seq for r in refused.collect()) == [1, 2, 3, *range(101, 106)]


def test_append_reads_only_days_that_may_hold_its_keys(spark):
    path = scratch(spark, "days")
    per_day = journal_rows(spark, 6).withColumn("ts", F.expr("timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(sequence_nr - 1)"))
    journal_store.append_journal(per_day, path)
    onward = per_day.withColumn("sequence_nr", F.col("sequence_nr") + 6)
    assert journal_store.touched_days(onward, path) == []
    assert journal_store.taken_keys(onward, path).count() == 0
    again = per_day.filter("sequence_nr between 3 and 4")
    days = journal_store.touched_days(again, path)
    assert sorted(d.day for d in days) == [3, 4]
    plan = journal_store.taken_keys(again, path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [day" in plan
    assert journal_store.taken_keys(again, path).select(F.input_file_name()).distinct().count() == 2
    journal_store.append_journal(onward, path)
    journal_store.append_journal(per_day.filter("sequence_nr = 1").withColumn("sequence_nr", F.lit(13).cast("long")), path)
    journal_store.append_journal(per_day.filter("sequence_nr = 1").withColumn("sequence_nr", F.lit(14).cast("long")), path)
    assert journal_store.stored_spans(spark, path).count() == 14
    journal_store.compact_spans(spark, path)
    assert journal_store.stored_spans(spark, path).count() == 13
    assert sorted(d.day for d in journal_store.touched_days(per_day.filter("sequence_nr = 3"), path)) == [3]
    journal_store.append_journal(again.withColumn("seq", F.lit(99).cast("long")), path)
    assert journal_store.stored_journal(spark, path).count() == 14


def test_batch_given_again_adds_and_reports_the_same(spark):
    path = scratch(spark, "batches")
    first = journal_rows(spark, 3)
    clash = journal_rows(spark, 4).withColumn("seq", F.col("seq") + 10)
    none = first.limit(1).withColumn("sequence_nr", F.lit(None).cast("long"))
    second = clash.unionByName(none)
    journal_store.append_batch(first, 0, path)
    for _ in range(2):
        journal_store.append_batch(second, 1, path)
        assert sorted((r.sequence_nr, r.seq) for r in journal_store.stored_journal(spark, path).collect()) == [(1, 1), (2, 2), (3, 3), (4, 14)]
        refused = spark.read.parquet(journal_store.stream_conflicts_path(path))
        assert sorted((r.sequence_nr or 0, r.seq) for r in refused.collect()) == [(0, none.first().seq), (1, 11), (2, 12), (3, 13)]


def test_truncated_rows_are_gone_and_state_stays(spark):
    path = scratch(spark, "truncate")
    whole = journal_rows(spark, 420).unionByName(journal_rows(spark, 49, "b")).withColumn("ts", F.expr("timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(0, sequence_nr)"))
    for low, high in ((0, 120), (120, 130), (130, 420)):
        journal_store.append_journal(whole.filter(f"sequence_nr > {low} and sequence_nr <= {high}"), path)
        journal_store.truncate_journal(spark, path)
        so_far = whole.filter(f"sequence_nr <= {high}")
        rows = journal_store.stored_journal(spark, path)
        assert sorted(rows.select("persistence_id", "sequence_nr").collect()) == sorted(journal.live_journal(so_far).select("persistence_id", "sequence_nr").collect())
        assert sorted(journal_store.restored_state(spark, path).collect()) == sorted(journal.replay(so_far).collect())
        snapshots = journal.snapshots(so_far)
        assert sorted(journal_store.stored_snapshots(spark, path).select(*snapshots.columns).collect()) == sorted(snapshots.collect())
    # Keys of deleted rows stay taken.
    journal_store.append_journal(whole.filter("sequence_nr = 7 and persistence_id like '%a'"), path)
    assert journal_store.stored_journal(spark, path).count() == 69
    assert spark.read.parquet(journal_store.conflicts_path(path)).filter("sequence_nr = 7").count() == 1


def test_a_writer_that_dies_leaves_the_last_version(spark):
    path = scratch(spark, "versions")
    assert storage.read_version(spark, path, "n int").count() == 0
    for n in (1, 2, 3):
        storage.replace_table(spark.createDataFrame([(n,)], "n int"), path)
    assert storage.versions(spark, path) == [1, 2]
    with pytest.raises(Exception):
        storage.replace_table(spark.range(1).select(F.raise_error(F.lit("dies")).cast("int").alias("n")), path)
    spark.range(5).write.mode("overwrite").parquet(f"{path}/version=7")
    assert storage.read_version(spark, path, "n int").collect() == [(3,)]
    storage.replace_table(spark.createDataFrame([(4,)], "n int"), path)
    assert storage.read_version(spark, path, "n int").collect() == [(4,)]


def test_next_sequence_follows_the_highest_also_after_a_gap(spark):
    have = journal_rows(spark, 2).withColumn("sequence_nr", F.col("sequence_nr") * 10)
    new = spark.createDataFrame([(7, "a", at(2)), (8, "a", at(1)), (9, "b", at(1))], "seq long, user_id string, ts timestamp_ntz")
    got = {r.seq: r.sequence_nr for r in journal.assign_sequence(new, have).collect()}
    assert got == {8: 21, 7: 22, 9: 1}


# --------------------------------------------------------------------- parsing

RAW = "topic string, partition int, offset long, key string, value string"


def raw(spark, *pairs):
    return spark.createDataFrame([("t", 0, i, k, v) for i, (k, v) in enumerate(pairs)], RAW)


def test_user_message_in_the_key_keeps_the_value_as_data(spark):
    rows = ingest.accepted(ingest.parse_user_messages(raw(spark, ("TS1761078201761@u1:DROP:84214", "payload"), ("TS1761078201761@u1:DROP:84214", None))))
    assert [(r.user_id, r.contact_id, r.event_data) for r in rows.orderBy("offset").collect()] == [("u1", 84214, "payload"), ("u1", 84214, "")]
    assert rows.first().ts == dt.datetime(2025, 10, 21, 20, 23, 21, 761000)


def test_user_message_reasons(spark):
    parsed = ingest.parse_user_messages(
        raw(spark, (None, None), (None, "TS1@u:DROP"), (None, "TS1@@u:DROP:1"), (None, "TS1@u:DROP: 5"), (None, "TS@u:DROP:5"), (None, "TS1@u:DROP:5:::"),
            (None, "TS99999999999999999@u:DROP:5"))
    )
    got = [r.reason for r in parsed.orderBy("offset").collect()]
    assert got == ["no_structured_data", "no_structured_data", "bad_time_user", "bad_contact_id", "bad_timestamp", None, "bad_timestamp"]
    assert ingest.accepted(parsed).count() + ingest.quarantined(parsed).count() == parsed.count()


def test_hash_message(spark):
    rows = ingest.parse_hash_messages(raw(spark, (None, "1000@" + "abcdefghij" * 3 + ":answer:1"), (None, "1000@:SEND"), (None, "1000"), (None, "x@h:DROP")))
    got = rows.orderBy("offset").collect()
    assert (got[0].event_id, got[0].user_id, got[0].event_type, got[0].call_result) == ("abcdefghij" * 2, "user_abcdefghij", "CALL_ANSWERED", "COMPLETED")
    assert (got[1].user_id, got[1].event_id, got[1].event_type) == ("unknown", "", "SMS_DELIVERY")
    assert [r.reason for r in got] == [None, None, "too_few_parts", "bad_timestamp"]


def test_json_message(spark):
    good = '  {"eventId":"e","userId":"u","eventType":"CALL_BUSY","timestamp":"2024-01-01T10:00:00Z","durationSeconds":5,"metadata":{"a":"b"},"unknown":1}'
    rows = ingest.parse_json(raw(spark, (None, good), (None, "{broken"), (None, "text"), (None, '{"timestamp":"never"}'))).orderBy("offset").collect()
    assert (rows[0].channel, rows[0].ts, rows[0].duration_seconds, rows[0].metadata) == ("CALL", dt.datetime(2024, 1, 1, 10), 5, {"a": "b"})
    assert [r.reason for r in rows] == [None, "bad_json", "bad_timestamp"]


def test_display_ids_and_payload_types(spark):
    ids = {None: "Unknown", "PersistentUserActor|user12": "user12", "a" * 8 + "b" * 20 + "wxyz": "aaaaaaaa...wxyz", "short-id": "short-id", "user-1": "user-1"}
    df = spark.createDataFrame([(k,) for k in ids], "i string")
    assert {r[0]: r[1] for r in df.select("i", ingest.display_id(F.col("i"))).collect()} == ids
    texts = {'{"eventType" : "X"}': None, '{"eventType": "SMS_DELIVERY"}': "SMS", '{"eventType":"LOGIN"}': "LOGIN", "PICKUP after DROP": "DROP", "nothing": None}
    df = spark.createDataFrame([(k,) for k in texts], "i string")
    assert {r[0]: r[1] for r in df.select("i", ingest.payload_type(F.col("i"))).collect()} == texts


def test_default_ids_repeat(spark):
    ev = events(spark, [("a", "DROP", None)]).withColumn("event_id", F.lit(None).cast("string"))
    fill = lambda: one(ingest.fill_defaults(ev, "http", F.lit(at(3)).cast("timestamp_ntz")))
    assert fill() == fill() and fill().ts == at(3) and len(fill().event_id) == 64


# -------------------------------------------------------------------- validity


def test_rules_of_all_channels(spark):
    cols = "event_id string, user_id string, ts timestamp_ntz, event_type string, email_address string, phone_number string, link_url string, bounce_reason string, message_content string, reply_content string, short_code string, delivery_status string, duration_seconds long, call_direction string, call_quality string"
    rows = [
        ("e1", "u", T0, "EMAIL_CLICK", "not mail", None, None, None, None, None, None, None, None, None, None),
        ("e2", "", T0, "EMAIL_BOUNCE", "a@b.co", None, "no uri", "", None, None, None, None, None, None, None),
        ("e3", "u", None, "SMS_REPLY", None, "+0", None, None, "x" * 1601, None, "12", None, None, None, None),
        ("e4", "u", T0, "SMS_DELIVERY", None, "15551234", None, None, None, None, "12345", "LOST", None, None, None),
        ("e5", "u", T0, "CALL_COMPLETED", None, None, None, None, None, None, None, None, 0, "SIDEWAYS", "GOOD"),
        ("e6", "u", T0, "CALL_UNKNOWN", None, "15551234", None, None, None, None, None, None, 90000, None, None),
        ("e7", "u", T0, "LOGIN", None, None, None, None, None, None, None, None, None, None, None),
        ("e8", "u", T0, None, None, None, None, None, None, None, None, None, None, None, None),
        ("e9", "u", T0, "NO_SUCH_TYPE", None, None, None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, cols)
    got = sorted((r.event_id, f"{r.field}.{r.code}") for r in quality.dq_violations(df).collect())
    assert got == [
        ("e1", "email_address.format"), ("e1", "link_url.required_when"),
        ("e2", "bounce_reason.required_when"), ("e2", "link_url.format"), ("e2", "user_id.min_length"),
        ("e3", "message_content.max_length"), ("e3", "phone_number.pattern"), ("e3", "reply_content.required_when"),
        ("e3", "short_code.pattern"), ("e3", "ts.required"),
        ("e4", "delivery_status.enum"),
        ("e5", "call_direction.enum"), ("e5", "duration_seconds.range_when"), ("e5", "phone_number.required"),
        ("e6", "duration_seconds.range"), ("e6", "event_type.enum"),
        ("e8", "event_type.required"), ("e9", "event_type.enum"),
    ]
    report = {(r.channel, r.rule): (r.checked, r.violations) for r in quality.dq_report(df).collect()}
    assert report["SMS", "ts.required"] == (2, 1) and report["EMAIL", "ts.required"] == (2, 0)
    msg = {r.event_id: r.message for r in quality.dq_messages(df).collect()}
    assert msg["e1"] == "Validation failed: email_address: format, link_url: required_when" and "e7" not in msg


def test_invalid_reason_order(spark):
    df = events(spark, [(" \t", None, None), ("u", None, None), ("u", "DROP", None), ("u", "NOPE", 1), ("u", "DROP", 1), ("u", "EMAIL_OPEN", 1)])
    got = [r.reason for r in quality.validity(df).orderBy("seq").collect()]
    assert got == ["missing_user", "missing_type", "missing_timestamp", "unknown_type", "not_an_engagement_type", None]


# -------------------------------------------------------------------- sequence


def test_lateness(spark):
    us = 1_000_000
    rows = [("e0", "u", 10 * us, 1), ("e1", "u", 10 * us, 2), ("e2", "u", 9 * us, 3), ("e3", "u", 8 * us + 999_000, 4), ("e4", "u", 11 * us, 5), ("e5", "u", None, 6), ("e6", None, 1, 7)]
    df = spark.createDataFrame([(i, e, u, "DROP", t, a) for i, (e, u, t, a) in enumerate(rows)], "seq long, event_id string, user_id string, event_type string, ts_us long, arrival_us long")
    got = {r.event_id: (r.label, r.late_ms) for r in sequence.sequence_check(df).collect()}
    assert got == {
        "e0": ("VALID", None), "e1": ("VALID", None), "e2": ("WARNING", 1000), "e3": ("INVALID", 1001), "e4": ("VALID", None),
        "e5": ("INVALID", None), "e6": ("INVALID", None),
    }


# ------------------------------------------------------------------- monitoring


@pytest.mark.parametrize(
    "fails,state_,score,healthy", [(0, "Healthy", 100.0, True), (4, "Healthy", 100.0, True), (5, "Degraded", 50.0, False), (10, "Critical", 10.0, False)]
)
def test_consecutive_failures(spark, fails, state_, score, healthy):
    r = one(monitoring.stage_health(log(spark, [("store", False, "x"), ("store", True, None)] + [("store", False, "x")] * fails)))
    assert (r.consecutive_failures, r.health_status, r.health_score, r.is_healthy) == (fails, state_, score, healthy)


def test_stage_that_never_succeeded(spark):
    assert one(monitoring.stage_health(log(spark, [("process", False, "x")] * 6))).consecutive_failures == 6


def test_warning_needs_an_unhealthy_stage_with_few_failures(spark):
    df = spark.createDataFrame([(False, 3), (False, 5), (False, 10), (True, 99)], "h boolean, n int")
    assert [r[0] for r in df.select(monitoring.health_state(F.col("h"), F.col("n"))).collect()] == ["Warning", "Degraded", "Critical", "Healthy"]


def test_nothing_received(spark):
    none = log(spark, [])
    r = one(monitoring.stage_funnel(none, F.lit(T0).cast("timestamp_ntz")))
    assert (r.success_rate, r.efficiency, r.error_rate, r.health_status) == (100.0, 100.0, 0.0, "Healthy")
    r = one(monitoring.throughput(none, F.lit(T0).cast("timestamp_ntz")))
    assert (r.events_per_second, r.peak_throughput, r.efficiency, r.is_healthy) == (0.0, 0.0, 0.0, False)
    r = one(monitoring.outcome_summary(monitoring.processing_metrics(none)))
    assert (r.success_rate, r.error_rate) == (0.0, 0.0)
    assert one(monitoring.latency(monitoring.processing_metrics(none))).average_ms == 0.0


def test_severity_and_short_text(spark):
    texts = {"Read TIMEOUT": "High", "validation failed": "Medium", "please retry": "Low", "else": "Medium", "retry the connection": "High"}
    df = spark.createDataFrame([(k,) for k in texts], "m string")
    assert {r[0]: r[1] for r in df.select("m", monitoring.severity(F.col("m"))).collect()} == texts
    df = spark.createDataFrame([("x" * 50,), ("y" * 51,)], "m string")
    assert [r[0] for r in df.select(monitoring.short_message(F.col("m"))).collect()] == ["x" * 50, "y" * 47 + "..."]


def test_approximate_percentile_agrees_on_few_values(spark, tables):
    m = monitoring.processing_metrics(tables.stage_log)
    a, b = one(monitoring.latency(m)), one(monitoring.latency(m, approximate=True))
    assert abs(a.p95_ms - b.p95_ms) <= 5 and a.level == b.level


def test_memory_percent_of_unknown_total(spark):
    df = spark.createDataFrame([(5, 0), (5, 20)], "u long, t long")
    assert [r[0] for r in df.select(monitoring.memory_percent(F.col("u"), F.col("t"))).collect()] == [0.0, 25.0]


def test_rebreach_after_clear_raises_at_once(spark):
    seq = [(0, 90.0), (60, 90.0), (120, 50.0), (150, 90.0), (449, 90.0), (450, 90.0)]
    df = spark.createDataFrame([(i, at(s), v) for i, (s, v) in enumerate(seq)], "seq long, ts timestamp_ntz, memory_usage double")
    got = sorted((r.seq, r.event) for r in alerts.alert_transitions(df).collect())
    assert got == [(0, "RAISED"), (2, "CLEARED"), (3, "RAISED"), (5, "RAISED")]
    r = one(alerts.alert_counts(alerts.alert_transitions(df)))
    assert (r.raised, r.cleared, r.is_active) == (3, 1, True)


# --------------------------------------------------------------------- profiles


def test_profile_attribute_rules(spark):
    users = spark.createDataFrame([(u, None) for u in "abcdef"], "user_id string, last_activity timestamp_ntz")
    attrs = spark.createDataFrame(
        [("a", "Automobile", None, 9, None, None), ("b", "AUTOMOBILE", None, 2, False, at(0)), ("c", None, "Art", 3, False, None), ("d", None, None, 0, True, None), ("e", None, None, 0, False, at(-40 * 86400))],
        "user_id string, inquiry_vertical string, area_of_interest string, disqualified_count long, do_not_email boolean, last_signup_ts timestamp_ntz",
    )
    rows = {r.user_id: r for r in profiles.attach_attributes(users, attrs, F.lit(at(86400)).cast("timestamp_ntz")).collect()}
    assert {u: (r.is_mailable, r.segment, r.active_in_either, r.has_attributes) for u, r in rows.items()} == {
        "a": (True, "Auto", False, True), "b": (True, "General", True, True), "c": (False, "Education", False, True),
        "d": (False, "General", False, True), "e": (True, "General", False, True), "f": (True, "General", False, False),
    }


def test_profile_of_a_user_without_events(spark):
    users = spark.createDataFrame([("x",)], "user_id string")
    r = one(profiles.enriched_profiles(users, events(spark, []), F.lit(T0).cast("timestamp_ntz")))
    assert (r.engagement_tier, r.overall_score, r.days_since_last_activity, r.fatigue_risk, r.last_activity) == ("INACTIVE", 20.0, 999, 70.0, dt.datetime(1970, 1, 1))


def test_lookup_limits(spark, tables):
    model = state.with_rates(state.user_engagement(tables.comm_events))
    with pytest.raises(ValueError):
        profiles.lookup(model, [])
    with pytest.raises(ValueError):
        profiles.lookup(model, [f"u{i}" for i in range(101)])


def test_cached_copy_ages(spark):
    model = spark.createDataFrame([("u",)], "user_id string")
    now = F.lit(T0).cast("timestamp_ntz")
    copy = profiles.cached_copy(model, now)
    assert profiles.fresh_copy(copy, now + F.expr("INTERVAL 30 MINUTES")).count() == 1
    assert profiles.fresh_copy(copy, now + F.expr("INTERVAL 31 MINUTES")).count() == 0
    assert profiles.stale(copy, now + F.expr("INTERVAL 2 DAYS"), dt.timedelta(days=1)).count() == 1


# -------------------------------------------------------------------- migration


def test_null_ids_cannot_empty_the_missing_users(spark):
    legacy = spark.createDataFrame([("a",), ("b",), (None,)], "user_id string")
    target = spark.createDataFrame([("P|a",), (None,)], "persistence_id string")
    assert [r[0] for r in migration.missing_users(legacy, target).collect()] == ["b"]


def test_progress_of_nothing(spark):
    none = spark.createDataFrame([], "id long, user_id string, event_type string, ts timestamp_ntz, channel string, status string")
    r = one(migration.progress(none))
    assert (r.progress_pct, r.records_per_second) == (0.0, 0) and r.status_line.startswith("0 of 0 copied (0.00%)")
    assert one(migration.may_continue(none, 0.0)).may_continue is True


def test_report_is_cut_and_says_so(spark):
    errors = spark.range(12).withColumn("user_id", F.lit("u"))
    rows = migration.error_report(errors, 5).collect()
    assert [r.id for r in rows] == [0, 1, 2, 3, 4] and all(r.truncated for r in rows)
    assert not any(r.truncated for r in migration.error_report(errors, 12).collect())


# ---------------------------------------------------------------- sources, sinks


def test_broker_options():
    o = messages.kafka_options("h:9092", ["a", "b"])
    assert o["subscribe"] == "a,b" and o["startingOffsets"] == "earliest" and "maxOffsetsPerTrigger" not in o
    assert messages.kafka_options("h:9092", ["q"], max_per_batch=10**6)["maxOffsetsPerTrigger"] == "1000000"
    assert messages.kafka_options("h:9092", ["q"], "latest")["startingOffsets"] == "latest"
    with pytest.raises(ValueError):
        messages.kafka_options("h:9092", ["q"], "middle")
    assert sinks.kafka_sink_options("h:9092")["kafka.bootstrap.servers"] == "h:9092"


def test_unroutable_events_carry_a_reason(spark):
    df = events(spark, [("u", "EMAIL_OPEN", 1), ("u", "LOGIN", 1), (" ", "EMAIL_OPEN", 1)])
    got = [(r.topic, r.reason) for r in sinks.routed(df).collect()]
    assert got == [("email-events", None), (None, "no_topic"), (None, "invalid_event")]
    path = scratch(spark, "topics")
    sinks.write_topics(sinks.routed(df), path)
    sent = {r.topic: r["count"] for r in spark.read.parquet(path).groupBy("topic").count().collect()}
    assert sent == {"email-events": 1, sinks.UNROUTED: 2}


def test_dashboard_sections(spark, tables):
    from rillbook.plans.dashboard import dashboard

    parts = dashboard(tables.comm_events, tables.stage_log, tables.samples, tables.journal)
    assert {n: len(df.take(30)) > 0 for n, df in parts.items()} == {n: True for n in parts}
    stored = dashboard(tables.comm_events, tables.stage_log, tables.samples, tables.journal, state.user_type_counts(tables.comm_events))
    assert stored["overview"].collect() == parts["overview"].collect()
