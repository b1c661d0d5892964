"""Streams over several micro-batches end where the batch job does."""

import datetime as dt
import os
import time
from urllib.parse import unquote

from pyspark.sql import functions as F

from rillbook.operators import alerts, ingest, quality, sequence, state
from rillbook.plans import stream_questions
from rillbook.sources.messages import file_stream
from rillbook.sources.storage import read_batches, scratch
from rillbook.streaming import jobs
from tools.oracle_check import compare, spark_frame


def same(a, b):
    assert compare(spark_frame(a), spark_frame(b)) == ""


def in_parts(spark, df, by, parts, name, run):
    """Feed a table in consecutive parts of ``by``; each part is its own start of the stream."""
    base = scratch(spark, name)
    cuts = df.selectExpr(f"percentile({by}, array({','.join(str(i / parts) for i in range(1, parts))}))").first()[0]
    lo = None
    for hi in [*cuts, None]:
        c = F.col(by)
        part = df.filter((F.lit(True) if lo is None else c > lo) & (F.lit(True) if hi is None else c <= hi))
        if lo is None:
            part = df.filter(c.isNull() | (c <= hi))
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        out = run(spark.readStream.schema(df.schema).parquet(f"{base}/in"), base)
        lo = hi
    return out


def to_table(spark):
    def run(stream, base):
        jobs.finish(jobs.start_table(stream, f"{base}/out", f"{base}/cp"))
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    return run


def test_sequence_labels_in_three_parts(spark, tables):
    ev = tables.comm_events
    to = to_table(spark)
    got = in_parts(spark, ev, "arrival_us", 3, "t-seq", lambda s, b: to(jobs.sequence_labels(s, 21_600_000), b))
    same(got, sequence.sequence_check(ev, 21_600_000))


def test_alerts_in_three_parts(spark, tables):
    to = to_table(spark)
    got = in_parts(spark, tables.samples, "seq", 3, "t-alerts", lambda s, b: to(jobs.alert_stream(s), b))
    same(got.withColumn("ts", F.col("ts").cast("timestamp_ntz")), alerts.alert_transitions(tables.samples))


def test_alerts_take_bounded_batches(spark, tables, monkeypatch):
    """Many micro-batches in time order give the alerts of one; none has more than its share of the samples."""
    samples = tables.samples.orderBy(F.rand(5))
    n = samples.count()
    monkeypatch.setattr(stream_questions, "ALERT_ROWS", n // 4 + 1)
    base = scratch(spark, "t-alerts-staged")
    stream_questions._in_time_order(samples, base, 4)
    files = spark.read.parquet(f"{base}/in").groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).orderBy("lo").collect()
    assert sum(r.n for r in files) == n and len(files) == 4 and all(a.hi < b.lo for a, b in zip(files, files[1:]))
    times = [os.path.getmtime(unquote(r.f.removeprefix("file:").replace("///", "/"))) for r in files]
    assert times == sorted(times)
    same(stream_questions.stream_alerts(tables), alerts.alert_transitions(tables.samples))


def test_channel_updates_in_three_parts(spark, tables):
    ev = tables.comm_events

    def run(stream, base):
        updates = jobs.channel_updates(stream)
        jobs.finish(jobs.start_batches(updates, jobs.write_feeds(f"{base}/out"), f"{base}/cp"))
        return (
            read_batches(spark, f"{base}/out/aggregation-updates", updates.schema).drop("batch_id"),
            spark.read.parquet(f"{base}/out/contact-notifications"),
        )

    updates, notes = in_parts(spark, ev, "seq", 3, "t-upd", run)
    same(updates.withColumn("last_updated", F.col("last_updated").cast("timestamp_ntz")), state.update_feed(ev))
    assert notes.count() == updates.count()


def test_fold_in_three_parts(spark, tables):
    ev = tables.comm_events

    def run(stream, base):
        folded = jobs.user_type_fold(stream)
        jobs.finish(jobs.start_batches(folded, jobs.write_updates(f"{base}/out"), f"{base}/cp", mode="update"))
        return jobs.latest_update(read_batches(spark, f"{base}/out", folded.schema), ["user_id", "event_type"])

    same(in_parts(spark, ev, "seq", 3, "t-fold", run), state.user_type_counts(ev))


def test_positions_continue(spark, tables):
    raw = tables.raw_messages
    to = to_table(spark)
    good = lambda s: jobs.decoded(s).filter("outcome = 'accepted'")
    got = in_parts(spark, raw, "offset", 2, "t-pos", lambda s, b: to(jobs.user_positions(good(s)), b))
    per_user = got.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("m"), F.countDistinct("position").alias("d"))
    assert per_user.filter("n <> m OR n <> d").count() == 0
    assert got.count() == ingest.accepted(ingest.parse_user_messages(raw)).count()


def test_split_by_outcome_loses_nothing(spark, tables):
    base = scratch(spark, "t-split")
    tables.raw_messages.write.parquet(f"{base}/in")
    q = jobs.finish(jobs.start_table(jobs.decoded(file_stream(spark, f"{base}/in")), f"{base}/out", f"{base}/cp", by=("outcome",)))
    out = spark.read.parquet(f"{base}/out")
    assert out.count() == tables.raw_messages.count()
    assert out.filter("outcome = 'accepted' AND reason IS NOT NULL").count() == 0
    assert jobs.status(q)["is_active"] is False


def test_a_replayed_batch_replaces_itself(spark):
    path = scratch(spark, "t-replay")
    df = spark.range(5)
    handler = jobs.write_updates(path)
    handler(df, 3)
    handler(df, 3)
    handler(df, 4)
    assert read_batches(spark, path, df.schema).count() == 10


def test_newest_time_expires(spark):
    """With a time to live the query runs until stopped; an expired user starts afresh."""
    base = scratch(spark, "t-ttl")
    ddl = "seq long, event_id string, user_id string, event_type string, ts_us long, arrival_us long"

    def put(seq, us):
        spark.createDataFrame([(seq, f"e{seq}", "u", "DROP", us, seq)], ddl).coalesce(1).write.mode("append").parquet(f"{base}/in")

    put(1, 9_000_000)
    stream = spark.readStream.schema(ddl).parquet(f"{base}/in")
    labelled = jobs.sequence_labels(stream, 1000, ttl=dt.timedelta(seconds=4))
    query = jobs.start_table(labelled, f"{base}/out", f"{base}/cp", trigger={"processingTime": "1 second"})
    seen = lambda: {r.seq: r.label for r in spark.read.schema(labelled.schema).parquet(f"{base}/out").collect()}

    def wait(seq):
        end = time.time() + 60
        while time.time() < end:
            try:
                if seq in seen():
                    return
            except Exception:  # the table is not there yet
                pass
            time.sleep(0.5)
        raise AssertionError(f"row {seq} never came; {query.exception()}")

    try:
        wait(1)
        time.sleep(6)
        put(2, 1_000_000)
        wait(2)
        assert seen() == {1: "VALID", 2: "VALID"}
    finally:
        query.stop()


def test_merge_of_any_split_is_the_whole(spark, tables):
    ev = tables.comm_events
    for share in (F.col("seq") % 2, F.length("event_id") % 3, F.lit(0)):
        cut = ev.withColumn("part", share)
        parts = [state.user_type_counts(cut.filter(F.col("part") == i)) for i in range(3)]
        same(state.merge_states(*parts), state.user_type_counts(ev))


def test_accepted_and_quarantined_are_all_messages(tables):
    raw = tables.raw_messages
    assert sum(
        half(p(raw)).count() for p in (ingest.parse_json, ingest.parse_hash_messages) for half in (ingest.accepted, ingest.quarantined)
    ) == raw.count()
    p = ingest.parse_user_messages(raw)
    assert ingest.accepted(p).count() + ingest.quarantined(p).count() == raw.count()


def test_validity_counts_are_all_events(tables):
    v = quality.validity(tables.comm_events)
    assert v.filter("is_engagement_valid = (reason IS NULL)").count() == tables.comm_events.count()
