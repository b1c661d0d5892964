"""The continuous pipeline over several micro-batches, with messages out of order, behind the watermark and a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rillbook.plans import stream_questions
from rillbook.schemas import RECEIVED
from rillbook.sources.messages import file_stream
from rillbook.sources.storage import scratch
from rillbook.streaming import flow, jobs

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
SEC = dt.timedelta(seconds=1)


def message(topic, partition, offset, received, user, event, second):
    ms = int((T0 + second * SEC).timestamp() * 1000)
    return (topic, partition, offset, None, f"TS{ms}@{user}:{event}:7:x", T0 + received * SEC)


def heartbeat(received):
    return (flow.HEARTBEAT, 0, 0, None, None, T0 + received * SEC)


def drained(spark, batches, runs=1, delay=60):
    """Feed files one by one; with several runs the query stops in between and is started again."""
    base = scratch(spark, "t-flow")
    cut = -(-len(batches) // runs)
    for at in range(0, len(batches), cut):
        for rows in batches[at : at + cut]:
            spark.createDataFrame(rows, RECEIVED).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = file_stream(spark, f"{base}/in", max_files=1, with_time=True)
        jobs.finish(flow.start_pipeline(stream, f"{base}/out", f"{base}/cp", 5000, delay * SEC, spread=4))
    return {name: flow.pipeline_table(spark, f"{base}/out", name).drop("batch_id").collect() for name in flow.TABLES}, base


def expected(rows, max_late_ms=5000):
    """Plain Python over all messages in receive order."""
    users, out = {}, {}
    for topic, partition, offset, _, value, received in sorted(rows, key=lambda r: (r[5], r[0], r[1], r[2])):
        if topic == flow.HEARTBEAT:
            continue
        head, event, *_ = value.split(":")
        ts, user = int(head[2:].split("@")[0]), head.split("@")[1]
        newest, number = users.get(user, (None, 0))
        late = newest - ts if newest is not None and newest > ts else None
        label = "VALID" if late is None else "WARNING" if late <= max_late_ms else "INVALID"
        users[user] = (ts if newest is None else max(ts, newest), number + 1)
        out[topic, partition, offset] = (user, event, label, late, number + 1)
    return out


@pytest.mark.parametrize("runs", [1, 3])
def test_topics_out_of_order(spark, runs):
    draw = random.Random(4)
    rows = [message(draw.choice(["a", "b"]), i % 3, i, i + draw.randint(0, 50), f"u{draw.choice('1112')}", draw.choice(["DROP", "PICKUP"]), i + draw.randint(-20, 0)) for i in range(120)]
    batches = [rows[i : i + 30] for i in range(0, 120, 30)] + [[heartbeat(1000)]]
    got, base = drained(spark, batches, runs)
    want = expected(rows)
    assert {(r.topic, r.partition, r.offset): (r.user_id, r.event_type, r.label, r.late_ms, r.sequence_nr) for r in got["success"]} == want
    assert len(got["success"]) == len(rows) and not got["failed"] and not got["retry"] and not got["behind"]
    assert {(r.persistence_id, r.sequence_nr) for r in got["journal"]} == {(f"PersistentUserActor|{u}", n) for u, _, _, _, n in want.values()}
    counts = {}
    for user, event, *_ in want.values():
        counts[user, event] = counts.get((user, event), 0) + 1
    assert {(r.user_id, r.event_type): r.n for r in flow.current_state(spark, f"{base}/out").collect()} == counts
    batches_seen = flow.pipeline_table(spark, f"{base}/out", "success").select("batch_id").distinct().count()
    assert batches_seen >= 3


def test_nothing_is_lost(spark):
    odd = [
        ("a", 0, 1, None, "garbage", T0), ("a", 0, 2, None, '{"eventId": broken', T0), ("a", 0, 3, None, None, T0),
        ("a", 0, 4, None, '{"eventId":"e","userId":"u","eventType":"EMAIL_OPEN","timestamp":"2024-03-01T00:00:00Z"}', T0),
        ("a", 0, 5, None, '{"eventId":"e","userId":" ","eventType":"EMAIL_OPEN","timestamp":"2024-03-01T00:00:00Z"}', T0),
        ("a", 0, 6, "TS1709251200000@u:NO_SUCH_TYPE:3", "v", T0), ("a", 0, 7, None, "TS1709251200000@abcdefghijkl:SEND", T0),
        ("a", 0, 8, None, "TS@@u:DROP:1", T0), ("a", 0, 9, None, "TS1709251200000@u:DROP:x", T0),
        ("a", 0, 11, None, "TS1709251200000@u:DROP:1", None),
    ]
    late = [message("b", 0, 10, 5, "u", "DROP", 5)]
    got, _ = drained(spark, [odd, [heartbeat(500)], [heartbeat(600)], late, [heartbeat(1000)]])
    assert {r.offset: r.reason for r in got["failed"]} == {
        1: "too_few_parts", 3: "too_few_parts", 5: "missing_user", 6: "unknown_type", 8: "bad_time_user", 9: "bad_contact_id", 11: "missing_receive_time",
    }
    assert [(r.offset, r.reason, r.attempt) for r in got["retry"]] == [(2, "bad_json", 1)]
    assert sorted((r.offset, r.form, r.user_id, r.event_type) for r in got["success"]) == [(4, "json", "u", "EMAIL_OPEN"), (7, "hash", "user_abcdefghij", "SMS_DELIVERY")]
    assert [(r.offset, r.user_id) for r in got["behind"]] == [(10, "u")]


def test_a_repeated_batch_replaces_itself(spark):
    path = scratch(spark, "t-flow-again")
    row = ("u", "a", 0, 1, 5, "user", "e", "u", "DROP", 7, 9, "v", None, False, "VALID", None, 1, 1, 9, 9, "SUCCESS")
    batch = spark.createDataFrame([row], flow.UserFlow.columns + ", outcome string")
    handler = flow.write_tables(path)
    for i in (0, 0, 1):
        handler(batch, i)
    assert [flow.pipeline_table(spark, path, n).count() for n in flow.TABLES] == [2, 2, 2, 0, 0, 0]


def test_users_share_keys(spark):
    """A key holds many users, whose labels, numbers and counts stay apart over batches; long contact ids stay exact."""
    draw = random.Random(9)
    rows = [message("a", 0, i, i + draw.randint(0, 50), f"u{draw.randint(0, 39)}", draw.choice(["DROP", "PICKUP"]), i + draw.randint(-20, 0)) for i in range(200)]
    long = 2**53 + 1
    rows = [(*r[:4], r[4].replace(":7:", f":{long}:"), r[5]) for r in rows]
    json = '{"eventId":"e","userId":"u1","eventType":"EMAIL_OPEN","timestamp":"2024-03-01T00:00:00Z"}'
    base = scratch(spark, "t-flow-keys")
    for part in (rows[:100], rows[100:] + [("b", 0, 999, None, json, T0 + 900 * SEC)], [heartbeat(2000)]):
        spark.createDataFrame(part, RECEIVED).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = file_stream(spark, f"{base}/in", max_files=1, with_time=True)
    out = flow.processed(stream, 5000, 60 * SEC, spread=2, keys=3)
    jobs.finish(jobs.start_batches(out, jobs.write_updates(f"{base}/out"), f"{base}/cp"))
    got = [r for r in spark.read.parquet(f"{base}/out").collect() if r.topic == "a"]
    assert {r.offset: (r.user_id, r.event_type, r.label, r.late_ms, r.sequence_nr) for r in got} == {k[2]: v for k, v in expected(rows).items()}
    assert len(got) == 200 and len({r.flow_key for r in got}) <= 3 and {r.contact_id for r in got} == {long}


def test_a_micro_batch_has_many_files(spark, tables, monkeypatch):
    """Staging is no single task; micro-batches keep their parts of the input."""
    monkeypatch.setattr(stream_questions, "FLOW_FILE_ROWS", 50)
    stream, base = stream_questions._flow(tables, "t-flow-files")
    n = tables.raw_messages.count() // stream_questions.FLOW_BATCHES // 50
    assert n > 3 and len(spark.read.parquet(f"{base}/in").inputFiles()) == 3 * n + 1
    jobs.finish(jobs.start_batches(stream, jobs.write_updates(f"{base}/out"), f"{base}/cp"))
    spans = spark.read.parquet(f"{base}/out").filter("topic <> 'heartbeat'").groupBy("batch_id").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi")).orderBy("lo").collect()
    assert [r.batch_id for r in spans] == [0, 1, 2] and all(a.hi < b.lo for a, b in zip(spans, spans[1:]))
