"""Cutting hot keys into ranges must not change any result."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rillbook.operators import alerts, journal, migration, monitoring, quality, sequence, state
from rillbook.operators.ordered import Running, in_ranges, join_per_key, latest_per_key, running
from tools.oracle_check import compare, spark_frame


def same(a, b):
    assert compare(spark_frame(a), spark_frame(b)) == ""


@pytest.mark.parametrize("ranges", [1, 40])
def test_jobs_agree(tables, ranges):
    ev, mig, samples = tables.comm_events, tables.migrated_events, tables.samples
    same(sequence.sequence_check(ev, 21_600_000, ranges), sequence.sequence_check(ev, 21_600_000))
    same(state.count_changes(ev, ranges), state.count_changes(ev))
    same(state.update_feed(ev, ranges), state.update_feed(ev))
    new = ev.filter(quality.base_valid()).select("seq", "user_id", "ts")
    same(journal.assign_sequence(new, tables.journal, ranges), journal.assign_sequence(new, tables.journal))
    same(migration.out_of_order(mig, ranges), migration.out_of_order(mig))
    same(monitoring.sample_trend(samples, ranges), monitoring.sample_trend(samples))


def test_last_counts_are_the_totals(tables):
    """Every countable event is counted, those without a time too."""
    changes = state.count_changes(tables.comm_events).groupBy("user_id", "event_type").agg(F.max("new_count").alias("n"))
    totals = state.countable(tables.comm_events).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    same(changes, totals)


@pytest.mark.parametrize("key", ["hot", None])
def test_a_key_with_most_rows_is_cut(spark, key):
    """Rows of one single time and a null key are cut by the row number."""
    rows = [(i, key if i % 3 else "u", 500_000 if i % 2 else i * 1_000) for i in range(1200)]
    df = spark.createDataFrame(rows, "seq long, k string, pos long")
    cut = in_ranges(df, ["k"], [F.col("pos"), F.col("seq")], 24)
    assert cut.count() == 1200
    assert cut.groupBy("k", "_part").count().agg(F.max("count")).first()[0] <= 150
    for k in (key, "u"):
        mine = [r._part for r in cut.filter(F.col("k").eqNullSafe(F.lit(k))).orderBy("pos", "seq").collect()]
        assert mine == sorted(mine)
    n = running(df, ["k"], [F.col("pos"), F.col("seq")], [Running("n", F.lit(1).cast("bigint"), "sum", True)], 24)
    assert sorted(r.n for r in n.filter(F.col("k").eqNullSafe(F.lit(key))).collect()) == list(range(1, 801))


def test_join_keeps_null_keys(spark):
    rows = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "seq long, k string")
    per = spark.createDataFrame([(None, 7), ("a", 8)], "k string, v long")
    assert sorted((r.seq, r.v) for r in join_per_key(rows, per, ["k"]).collect()) == [(1, 7), (2, 8), (3, 7)]


def test_one_key_with_a_third_of_the_rows_and_ties(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        user = "hot" if i % 3 == 0 else f"u{rng.randrange(50)}"
        rows.append((i, user, rng.choice([1_000, 1_000, rng.randrange(10_000)]), rng.choice([None, rng.randrange(100)])))
    df = spark.createDataFrame(rows, "seq long, user_id string, pos long, v long")
    values = [
        Running("n", F.lit(1).cast("bigint"), "sum"),
        Running("total", F.col("v"), "sum", True),
        Running("top", F.col("v"), "max"),
        Running("prev", F.col("v"), "lag"),
    ]
    got = {r.seq: r for r in running(df, ["user_id"], [F.col("pos"), F.col("seq")], values, 25).collect()}
    by_user = {}
    for seq, user, pos, v in sorted(rows, key=lambda r: (r[2], r[0])):
        seen = by_user.setdefault(user, [])
        known = [x for x in seen if x is not None]
        r = got[seq]
        assert (r.n, r.total) == (len(seen), sum(known) + (v or 0))
        assert r.top == (max(known) if known else None)
        assert r.prev == (seen[-1] if seen else None)
        seen.append(v)


def test_latest_per_key(spark):
    rows = [(i, "hot" if i % 2 else "cold", (i * 37) % 500) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, k string, pos long")
    got = latest_per_key(df, ["k"], [F.desc("pos"), F.desc("seq")], 9).collect()
    for k in ("hot", "cold"):
        want = sorted(((p, s) for s, key, p in rows if key == k), reverse=True)[:9]
        assert [(r.pos, r.seq) for r in sorted(got, key=lambda r: r.rank_in_key) if r.k == k] == want


def simulate(rows, cooldown_us):
    """The alert rules, followed reading by reading."""
    out, last = [], None
    for us, seq, value in sorted(rows):
        if value <= 0:
            continue
        if value > 80:
            if last is None or us - last >= cooldown_us:
                last = us
                out.append((seq, "RAISED"))
        elif last is not None:
            last = None
            out.append((seq, "CLEARED"))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_alerts_over_many_ranges(spark, seed):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    t, rows = 0, []
    for i in range(600):
        t += rng.choice([0, 1, 7, 30, 30, 200])
        # Long runs of breaches, gaps inside them, values that are no reading.
        value = rng.choice([0.0, 95.0, 95.0]) if (i // 150) % 2 == 0 else rng.choice([95.0, 20.0, -1.0])
        rows.append((i, base + dt.timedelta(seconds=t), value))
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, memory_usage double")
    want = simulate([(int((ts - base).total_seconds()) * 1_000_000, s, v) for s, ts, v in rows], 300_000_000)
    for rows_each, folds, hot in ((7, 3, 50), (40, 64, None), (50_000, 64, None)):
        got = alerts.alert_transitions(df, fold_rows=rows_each, folds=folds, ranges=hot)
        assert sorted((r.seq, r.event) for r in got.collect()) == want


def test_alerts_of_a_dense_metric(spark):
    """1000 samples a second: the cooldown is longer than any range."""
    rows = spark.range(400_000).select(
        F.col("id").alias("seq"), F.timestamp_millis(F.col("id") + 1_700_000_000_000).cast("timestamp_ntz").alias("ts"), F.lit(95.0).alias("memory_usage")
    )
    got = alerts.alert_transitions(rows, cooldown=dt.timedelta(seconds=60), fold_rows=10_000, folds=4).collect()
    assert sorted((r.seq, r.event) for r in got) == [(i, "RAISED") for i in range(0, 400_000, 60_000)]
