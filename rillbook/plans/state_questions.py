"""Questions about user state, the journal, activity, profiles and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillbook.functions.clock import as_of
from rillbook.operators import activity as a, ingest, journal as j, migration as m, profiles as p, quality as q, state as s
from rillbook.operators.ordered import join_per_key, latest_per_key
from rillbook.plans.ingest_questions import INSERTABLE_SQL, TOPS, _incoming
from rillbook.plans.registry import question
from rillbook.plans.sqltext import BASE_VALID, DISPLAY_ID, ENGAGED, ENGAGEMENT, EVENT_LINE, RATES, TYPE_COUNTS

# --------------------------------------------------------------------- user state


@question("c01_user_type_counts", "comm_events", "WITH " + TYPE_COUNTS + "SELECT * FROM type_counts")
def user_type_counts(t):
    return s.user_type_counts(t.comm_events)


USER_STATE = """user_state AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS total_events, min(first_ts) AS first_ts, max(last_ts) AS last_ts FROM type_counts GROUP BY 1)"""


@question("c01_user_state", "comm_events", "WITH " + TYPE_COUNTS + "," + USER_STATE + "SELECT * FROM user_state")
def user_state(t):
    return s.user_state(s.user_type_counts(t.comm_events))


def _halves(t):
    """History before the last day, and everything else; together all events, each once."""
    ev = t.comm_events
    old = F.coalesce(F.col("ts") < F.date_trunc("day", as_of(ev)).cast("timestamp_ntz"), F.lit(False))
    return s.user_type_counts(ev.filter(old)), s.user_type_counts(ev.filter(~old))


@question("c02_merged_state", "comm_events", "WITH " + TYPE_COUNTS + "SELECT * FROM type_counts")
def merged_state(t):
    return s.merge_states(*_halves(t))


HALVES = f"""ev AS (SELECT *, coalesce(ts < date_trunc('day', (SELECT max(ts) FROM comm_events)), FALSE) AS old FROM comm_events WHERE user_id IS NOT NULL AND event_type IS NOT NULL)"""


@question(
    "d01_history_and_current",
    "comm_events",
    "WITH " + HALVES + """SELECT user_id, count(*) FILTER (old) AS history_events, count(*) FILTER (NOT old) AS current_events,
    count(*) AS total_events, max(ts) AS last_ts FROM ev GROUP BY user_id""",
)
def history_and_current(t):
    old, new = _halves(t)
    return s.join_history(s.user_state(old), s.user_state(new))


@question("g03_state_key_union", "comm_events", "SELECT DISTINCT user_id FROM comm_events WHERE user_id IS NOT NULL AND event_type IS NOT NULL")
def state_key_union(t):
    return s.merge_states(*_halves(t)).select("user_id").distinct()


@question("c03_user_engagement", "comm_events", "WITH " + ENGAGEMENT + "SELECT * FROM engagement")
def user_engagement(t):
    return s.user_engagement(t.comm_events)


@question("c04_engagement_rates", "comm_events", "WITH " + ENGAGEMENT + "," + RATES + "SELECT * FROM rates")
def engagement_rates(t):
    return s.with_rates(s.user_engagement(t.comm_events))


@question(
    "c04_open_rate_by_delivery",
    "comm_events",
    f"""SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'EMAIL_DELIVERY') > 0 THEN
      (count(*) FILTER (event_type = 'EMAIL_OPEN'))::DOUBLE / (count(*) FILTER (event_type = 'EMAIL_DELIVERY'))::DOUBLE ELSE 0.0::DOUBLE END AS email_open_rate_by_delivery
    FROM comm_events WHERE {BASE_VALID} GROUP BY user_id""",
)
def open_rate_by_delivery(t):
    return s.open_rate_by_delivery(t.comm_events)


@question(
    "c05_engagement_flags",
    "comm_events",
    "WITH " + ENGAGEMENT + "," + RATES + """SELECT *,
    coalesce(last_activity > (SELECT max(ts) FROM comm_events) - INTERVAL 7 DAY, FALSE) AS recently_active,
    email_open_rate > 0.7 OR sms_response_rate > 0.5 OR call_completion_rate > 0.8 AS high_engagement, total_events > 10 AS hot_user FROM rates""",
)
def engagement_flags(t):
    return s.engagement_report(t.comm_events)


@question(
    "c06_history_by_type",
    "journal",
    """SELECT split_part(persistence_id, '|', -1) AS user_id, event_type, count(*) AS n, max(ts) AS last_updated FROM journal
    WHERE persistence_id LIKE 'PersistentUserActor|%' GROUP BY ALL""",
)
def history_by_type(t):
    return j.history_counts(t.journal)


@question(
    "c06_one_user_history",
    "journal",
    "SELECT event_type, count(*) AS n, max(ts) AS last_updated FROM journal WHERE persistence_id = 'PersistentUserActor|user7' GROUP BY ALL",
)
def one_user_history(t):
    return j.user_history(t.journal, "user7")


@question(
    "c07_totals",
    "comm_events",
    "WITH " + TYPE_COUNTS + "," + USER_STATE + """SELECT count(*) AS total_users, CAST(sum(total_events) AS BIGINT) AS total_events,
    sum(total_events)::DOUBLE / count(*)::DOUBLE AS avg_events_per_user FROM user_state""",
)
def totals(t):
    return s.totals(s.user_type_counts(t.comm_events))


SHARES = """SELECT event_type, CAST(sum(n) AS BIGINT) AS n, sum(n)::DOUBLE / (sum(sum(n)) OVER ())::DOUBLE * 100.0 AS percentage FROM type_counts GROUP BY 1"""


@question("c08_type_breakdown", "comm_events", "WITH " + TYPE_COUNTS + SHARES)
def type_breakdown(t):
    return a.type_breakdown(s.user_type_counts(t.comm_events))


@question(
    "e07_share_of_total",
    "journal",
    """SELECT persistence_id AS event_type, count(*) AS n, count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE * 100.0 AS percentage FROM journal GROUP BY 1""",
)
def share_of_total(t):
    # The share of every id: one row per id is left when the total is taken.
    per_id = t.journal.groupBy(F.col("persistence_id").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))
    total = per_id.agg(F.sum("n")).scalar()
    return per_id.withColumn("percentage", F.col("n").cast("double") / total.cast("double") * 100.0)


@question(
    "c09_user_activity",
    "journal",
    """WITH k AS (SELECT persistence_id, count(*) AS n FROM journal GROUP BY 1)
    SELECT count(*) AS total_users, count(*) FILTER (n > 0) AS active_users, round(sum(n)::DOUBLE / count(*)::DOUBLE, 2) AS avg_events_per_user, max(n) AS max_events_per_user FROM k""",
)
def user_activity(t):
    return a.user_activity(t.journal)


@question(
    "c10_journal_summary",
    "journal",
    "SELECT persistence_id, count(*) AS event_count, min(ts) AS first_event, max(ts) AS last_event FROM journal GROUP BY 1",
)
def journal_summary(t):
    return j.summary(t.journal)


@question("c10_journal_totals", "journal", "SELECT count(*) AS total_events, count(DISTINCT persistence_id) AS total_ids FROM journal")
def journal_totals(t):
    return j.summary_totals(t.journal)


@question(
    "c11_journal_inventory",
    "journal",
    """SELECT persistence_id, count(*) AS event_count, max(sequence_nr) AS highest_sequence_nr, split_part(persistence_id, '|', -1) AS user_id
    FROM journal GROUP BY 1""",
)
def journal_inventory(t):
    return j.inventory(t.journal)


@question(
    "c12_stream_statistics",
    "journal",
    """SELECT count(DISTINCT persistence_id) AS total_ids, count(*) AS total_events, count(*) // count(DISTINCT persistence_id) AS avg_events_whole,
    count(*)::DOUBLE / count(DISTINCT persistence_id)::DOUBLE AS avg_events FROM journal""",
)
def stream_statistics(t):
    return j.stream_statistics(t.journal)


@question(
    "c13_recent_stats",
    "comm_events",
    f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS rn FROM comm_events WHERE {BASE_VALID})
    SELECT user_id, count(*) AS total_events, max(ts) AS last_activity,
      count(*) FILTER (rn <= 100 AND ts > (SELECT max(ts) FROM comm_events) - INTERVAL 1 HOUR) AS recent_events FROM v GROUP BY 1""",
)
def recent_stats(t):
    return s.recent_stats(t.comm_events, as_of(t.comm_events))


@question(
    "c25_count_changes",
    "comm_events",
    """SELECT seq, user_id, event_type, ts, row_number() OVER w - 1 AS previous_count, row_number() OVER w AS new_count FROM comm_events
    WHERE user_id IS NOT NULL AND event_type IS NOT NULL WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts NULLS FIRST, seq)""",
)
def count_changes(t):
    return s.count_changes(t.comm_events)


def _balance_sql(shards: int) -> str:
    return (
        "WITH "
        + TYPE_COUNTS
        + ","
        + USER_STATE
        + f""", h AS (SELECT total_events, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(user_id, ''), lambda ch: unicode(ch)::BIGINT)),
      lambda acc, x: (acc * 31 + x) % 4294967296) AS h FROM user_state),
    k AS (SELECT abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % {shards} AS shard, count(*) AS users, CAST(sum(total_events) AS BIGINT) AS events FROM h GROUP BY 1)
    SELECT *, (SELECT max(events) * count(*) / sum(events)::DOUBLE FROM k) AS skew FROM k"""
    )


@question("c27_shard_balance", "comm_events", _balance_sql(100))
def shard_balance(t):
    return s.shard_balance(s.user_type_counts(t.comm_events), 100)


@question("c27_shard_balance_small", "comm_events", _balance_sql(10))
def shard_balance_small(t):
    return s.shard_balance(s.user_type_counts(t.comm_events), 10)


# ------------------------------------------------------------- profiles and joins


@question(
    "c28_enriched_profiles",
    "comm_events profile_attributes",
    "WITH " + ENGAGEMENT + "," + RATES + f""", days AS (SELECT user_id, count(DISTINCT ts::DATE) AS active_days FROM comm_events WHERE {BASE_VALID} AND event_type IN {ENGAGED} GROUP BY 1),
    b AS (SELECT r.*, d.active_days, CASE WHEN email_opens > 0 THEN email_clicks::DOUBLE / email_opens::DOUBLE ELSE 0.0::DOUBLE END AS ctr,
      date_diff('day', last_activity::DATE, (SELECT max(ts) FROM comm_events)::DATE) AS days, total_events::DOUBLE / active_days::DOUBLE AS per_day
      FROM rates r JOIN days d USING (user_id)),
    sc AS (SELECT *, (least(email_open_rate, 1.0::DOUBLE) + least(sms_response_rate, 1.0::DOUBLE) + least(call_completion_rate, 1.0::DOUBLE)) * 100.0::DOUBLE / 3.0::DOUBLE AS es,
      greatest(0.0::DOUBLE, 100.0::DOUBLE - days * 100.0::DOUBLE / 30.0::DOUBLE) AS acs, least(100.0::DOUBLE, per_day * 20.0::DOUBLE) AS fs FROM b),
    o AS (SELECT *, (es + acs + fs) / 3.0::DOUBLE AS os FROM sc),
    f AS (SELECT a.user_id, CASE WHEN o.total_events IS NULL THEN 'INACTIVE' WHEN os >= 80 THEN 'HIGH' WHEN os >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS engagement_tier,
      coalesce(o.total_events, 0) AS total_events, coalesce(email_open_rate, 0.0::DOUBLE) AS email_open_rate, coalesce(ctr, 0.0::DOUBLE) AS email_click_through_rate,
      coalesce(sms_response_rate, 0.0::DOUBLE) AS sms_response_rate, coalesce(call_completion_rate, 0.0::DOUBLE) AS call_completion_rate,
      coalesce(es, 0.0::DOUBLE) AS engagement_score, coalesce(acs, 20.0::DOUBLE) AS activity_score, coalesce(fs, 20.0::DOUBLE) AS frequency_score,
      coalesce(os, 20.0::DOUBLE) AS overall_score, coalesce(days, 999) AS days_since_last_activity, coalesce(active_days, 0) AS active_days,
      coalesce(last_activity, TIMESTAMP '1970-01-01') AS last_activity, coalesce(per_day, 0.0::DOUBLE) AS avg_events_per_day
      FROM profile_attributes a LEFT JOIN o USING (user_id))
    SELECT *, engagement_tier = 'HIGH' AND overall_score >= 80 AS highly_engaged, days_since_last_activity <= 7 AS recently_active,
      CASE WHEN avg_events_per_day > 5 AND overall_score < 40 THEN 80.0::DOUBLE WHEN avg_events_per_day > 10 AND overall_score < 60 THEN 60.0::DOUBLE
        WHEN days_since_last_activity > 30 THEN 70.0::DOUBLE ELSE greatest(0.0::DOUBLE, 100.0::DOUBLE - overall_score) END AS fatigue_risk FROM f""",
)
def enriched_profiles(t):
    return p.enriched_profiles(t.profile_attributes, t.comm_events, as_of(t.comm_events))


@question(
    "d02_missing_users",
    "legacy_events migrated_events",
    """SELECT DISTINCT user_id FROM legacy_events WHERE user_id IS NOT NULL AND user_id NOT IN
    (SELECT split_part(persistence_id, '|', -1) FROM migrated_events WHERE persistence_id IS NOT NULL)""",
)
def missing_users(t):
    return m.missing_users(t.legacy_events, t.migrated_events)


@question(
    "d03_attached_attributes",
    "comm_events profile_attributes",
    "WITH " + ENGAGEMENT + """SELECT e.user_id, e.last_activity, do_not_email IS NULL OR (NOT do_not_email AND disqualified_count < 3) AS is_mailable,
    CASE WHEN area_of_interest IS NOT NULL THEN 'Education' WHEN contains(inquiry_vertical, 'Auto') THEN 'Auto' ELSE 'General' END AS segment,
    coalesce(last_activity > (SELECT max(ts) FROM comm_events) - INTERVAL 7 DAY, FALSE) AS active_in_either, a.user_id IS NOT NULL AS has_attributes
    FROM engagement e LEFT JOIN profile_attributes a ON a.user_id = e.user_id""",
)
def attached_attributes(t):
    users = s.user_engagement(t.comm_events).select("user_id", "last_activity")
    return p.attach_attributes(users, t.profile_attributes, as_of(t.comm_events))


#: A request for users that exist and users that do not.
REQUESTED = [f"user{i}" for i in range(0, 60)] + [f"nobody{i}" for i in range(5)]


@question(
    "d04_batch_lookup",
    "comm_events",
    "WITH " + ENGAGEMENT + "," + RATES + f""", keys AS (SELECT unnest([{', '.join("'" + u + "'" for u in REQUESTED)}]) AS user_id)
    SELECT k.user_id, coalesce(email_opens, 0) AS email_opens, coalesce(email_clicks, 0) AS email_clicks, coalesce(sms_replies, 0) AS sms_replies,
      coalesce(sms_deliveries, 0) AS sms_deliveries, coalesce(calls_completed, 0) AS calls_completed, coalesce(calls_missed, 0) AS calls_missed,
      coalesce(email_open_rate, 0.0::DOUBLE) AS email_open_rate, coalesce(sms_response_rate, 0.0::DOUBLE) AS sms_response_rate, coalesce(call_completion_rate, 0.0::DOUBLE) AS call_completion_rate,
      last_activity, 'PENDING_REVIEW' AS contactable_status, r.user_id IS NOT NULL AS known
    FROM keys k LEFT JOIN rates r ON r.user_id = k.user_id""",
)
def batch_lookup(t):
    return p.lookup(s.with_rates(s.user_engagement(t.comm_events)), REQUESTED)


APPLIED = """latest AS (SELECT user_id, arg_max(seq, (processing_ts, seq)) AS seq, count(*) AS n FROM contactable_updates WHERE contactable_status IS NOT NULL GROUP BY 1)"""


@question(
    "d05_contactable_applied",
    "comm_events contactable_updates",
    "WITH " + ENGAGEMENT + "," + APPLIED + """SELECT e.*, coalesce(u.contactable_status, 'PENDING_REVIEW') AS contactable_status, u.graph_node AS current_graph_node,
    u.processing_ts AS last_processing, coalesce(l.n, 0) AS processing_count
    FROM engagement e LEFT JOIN latest l USING (user_id) LEFT JOIN contactable_updates u ON u.seq = l.seq""",
)
def contactable_applied(t):
    return s.apply_contactable(s.user_engagement(t.comm_events), t.contactable_updates)


@question(
    "d05_contactable_rejects",
    "contactable_updates",
    "SELECT seq, user_id, 'missing_status' AS reason FROM contactable_updates WHERE contactable_status IS NULL",
)
def contactable_rejects(t):
    return s.contactable_rejects(t.contactable_updates).select("seq", "user_id", "reason")


@question(
    "d06_key_conflicts",
    "journal migrated_events",
    """SELECT persistence_id, sequence_nr, seq FROM migrated_events m
    WHERE EXISTS (SELECT 1 FROM journal x WHERE x.persistence_id = m.persistence_id AND x.sequence_nr = m.sequence_nr)""",
)
def key_conflicts(t):
    return j.key_conflicts(_incoming(t), t.journal).select("persistence_id", "sequence_nr", "seq")


@question("d06_insertable", "journal migrated_events", INSERTABLE_SQL + "SELECT persistence_id, sequence_nr, seq FROM added")
def insertable(t):
    return j.insertable(_incoming(t), t.journal).select("persistence_id", "sequence_nr", "seq")


@question(
    "d06_free_keys",
    "journal migrated_events",
    """WITH top AS (SELECT persistence_id, max(sequence_nr) AS highest FROM journal GROUP BY 1),
    new AS (SELECT m.persistence_id, m.seq, m.sequence_nr + CASE WHEN m.seq % 2 = 1 THEN highest ELSE 0 END AS sequence_nr FROM migrated_events m JOIN top USING (persistence_id))
    SELECT persistence_id, sequence_nr, min(seq) AS seq FROM new n
    WHERE NOT EXISTS (SELECT 1 FROM journal x WHERE x.persistence_id = n.persistence_id AND x.sequence_nr = n.sequence_nr) GROUP BY ALL""",
)
def free_keys(t):
    """Every other row moved behind the highest number of its id, where keys are free."""
    moved = F.when(F.col("seq") % 2 == 1, F.col("highest")).otherwise(0)
    rows = join_per_key(_incoming(t), j.highest_sequence(t.journal), ["persistence_id"])
    rows = rows.withColumn("sequence_nr", F.col("sequence_nr") + moved).drop("highest")
    return j.insertable(rows, t.journal).select("persistence_id", "sequence_nr", "seq")


# ---------------------------------------------------------------- journal windows


@question(
    "e01_next_sequence",
    "comm_events journal",
    f"""WITH top AS (SELECT persistence_id, max(sequence_nr) AS highest FROM journal GROUP BY 1),
    n AS (SELECT seq, 'PersistentUserActor|' || user_id AS persistence_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS rn FROM comm_events WHERE {BASE_VALID})
    SELECT n.seq, n.persistence_id, rn + coalesce(highest, 0) AS sequence_nr FROM n LEFT JOIN top USING (persistence_id)""",
)
def next_sequence(t):
    new = t.comm_events.filter(q.base_valid()).select("seq", "user_id", "ts")
    return j.assign_sequence(new, t.journal).select("seq", "persistence_id", "sequence_nr")


@question(
    "e06_latest_per_user",
    "comm_events",
    f"""SELECT seq, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS rank_in_key FROM comm_events WHERE {BASE_VALID}
    QUALIFY rank_in_key <= 100""",
)
def latest_per_user(t):
    rows = t.comm_events.filter(q.base_valid()).select("seq", "user_id", "event_type", "ts")
    return latest_per_key(rows, ["user_id"], [F.desc("ts"), F.desc("seq")], 100)


@question(
    "e06_latest_snapshots",
    "journal",
    "WITH " + TOPS + """SELECT persistence_id, snapshot_nr, row_number() OVER (PARTITION BY persistence_id ORDER BY snapshot_nr DESC) AS rank_in_key FROM
    (SELECT persistence_id, unnest(generate_series(50, last_snapshot, 50)) AS snapshot_nr FROM tops WHERE last_snapshot > 0) QUALIFY rank_in_key <= 5""",
)
def latest_snapshots(t):
    points = t.journal.filter(F.col("sequence_nr") % 50 == 0).select("persistence_id", F.col("sequence_nr").alias("snapshot_nr"))
    return latest_per_key(points, ["persistence_id"], [F.desc("snapshot_nr")], 5)


# ---------------------------------------------------------------------- top and page


@question(
    "f01_recent_activity",
    "comm_events",
    "WITH " + TYPE_COUNTS + f""", r AS (SELECT user_id, event_type, n, max(last_ts) OVER (PARTITION BY user_id) AS last_updated FROM type_counts)
    SELECT {DISPLAY_ID.format(id='user_id')} AS display_id, user_id, event_type, n, last_updated,
      {EVENT_LINE.format(user='(' + DISPLAY_ID.format(id='user_id') + ')', type='event_type')} AS details
    FROM r ORDER BY last_updated DESC NULLS LAST, user_id, event_type LIMIT 20""",
)
def recent_activity(t):
    return a.recent_activity(s.user_type_counts(t.comm_events), 20)


@question(
    "f02_top_users",
    "comm_events",
    "WITH " + TYPE_COUNTS + "," + USER_STATE + f"""SELECT {DISPLAY_ID.format(id='user_id')} AS display_id, user_id, total_events, last_ts AS last_activity
    FROM user_state ORDER BY total_events DESC, user_id LIMIT 10""",
)
def top_users(t):
    return a.top_users(s.user_type_counts(t.comm_events), 10)


@question(
    "f03_journal_page",
    "journal",
    "SELECT * FROM journal WHERE persistence_id = 'PersistentUserActor|user7' AND sequence_nr >= 5 ORDER BY sequence_nr LIMIT 20",
)
def journal_page(t):
    return j.page(t.journal, "PersistentUserActor|user7", 5, 20)


@question("f04_latest_rows", "journal", "SELECT * FROM journal ORDER BY ts DESC, persistence_id, sequence_nr LIMIT 10")
def latest_rows(t):
    return j.latest_rows(t.journal, 10)


@question(
    "f05_latest_rows_of_id",
    "journal",
    "SELECT * FROM journal WHERE persistence_id = 'PersistentUserActor|user7' ORDER BY sequence_nr DESC LIMIT 10",
)
def latest_rows_of_id(t):
    return j.latest_rows_of(t.journal, "PersistentUserActor|user7", 10)


@question(
    "g01_topic_union",
    "raw_messages",
    """SELECT topic, partition, "offset", key, value FROM raw_messages""",
)
def topic_union(t):
    raw = t.raw_messages
    return ingest.union_topics(*[raw.filter(F.col("topic") == name) for name in ("call-queue", "digital-queue")])


@question("g02_persistence_ids", "journal", "SELECT DISTINCT persistence_id FROM journal")
def persistence_ids(t):
    return j.persistence_ids(t.journal)


@question(
    "g04_user_difference",
    "legacy_events migrated_events",
    "SELECT user_id FROM legacy_events WHERE user_id IS NOT NULL EXCEPT SELECT split_part(persistence_id, '|', -1) FROM migrated_events",
)
def user_difference(t):
    have = t.migrated_events.select(ingest.user_of(F.col("persistence_id")).alias("user_id"))
    return t.legacy_events.select("user_id").filter(F.col("user_id").isNotNull()).subtract(have)


@question(
    "i14_restored_state",
    "journal",
    """SELECT split_part(persistence_id, '|', -1) AS user_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM journal
    WHERE persistence_id LIKE 'PersistentUserActor|%' GROUP BY ALL""",
)
def restored_state(t):
    return j.restore(j.snapshots(t.journal), j.live_journal(t.journal))
