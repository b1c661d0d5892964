"""Input tables derived from the given test tables.

Each view is one SQL text for both engines; three tokens differ between them. See FIXTURES.md.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from rillbook.operators.journal import assign_sequence
from rillbook.schemas import JOURNAL as JOURNAL_RECORD
from rillbook.session import configure

JOURNAL_COLUMNS = JOURNAL_RECORD.names

COMM_EVENTS = """
SELECT event_id AS seq,
  concat('evt-', CAST(event_id AS STRING)) AS event_id,
  CASE WHEN event_id % 97 = 0 THEN ' ' ELSE concat('user', CAST(user_id AS STRING)) END AS user_id,
  CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 103 = 0 THEN 'NO_SUCH_TYPE' ELSE
  CASE (event_id * 7 + user_id * 3) % 22
    WHEN 0 THEN 'EMAIL_OPEN' WHEN 1 THEN 'EMAIL_CLICK' WHEN 2 THEN 'EMAIL_BOUNCE' WHEN 3 THEN 'EMAIL_DELIVERY'
    WHEN 4 THEN 'SMS_REPLY' WHEN 5 THEN 'SMS_DELIVERY' WHEN 6 THEN 'SMS_BOUNCE' WHEN 7 THEN 'SMS_CLICK'
    WHEN 8 THEN 'CALL_COMPLETED' WHEN 9 THEN 'CALL_MISSED' WHEN 10 THEN 'CALL_ANSWERED' WHEN 11 THEN 'CALL_BUSY'
    WHEN 12 THEN 'LOGIN' WHEN 13 THEN 'LOGOUT' WHEN 14 THEN 'VIEW_PRODUCT' WHEN 15 THEN 'ADD_TO_CART'
    WHEN 16 THEN 'PURCHASE' WHEN 17 THEN 'DROP' WHEN 18 THEN 'PICKUP' WHEN 19 THEN 'DELIVERY'
    WHEN 20 THEN 'HEALTH_CHECK' ELSE 'PEKKO_KAFKA_TEST' END END AS event_type,
  CASE WHEN event_id % 83 = 0 THEN NULL ELSE ts END AS ts,
  CASE WHEN event_id % 83 = 0 THEN NULL ELSE {US} END AS ts_us,
  {US} + ((event_id * 7919) % 172800) * 1000000 AS arrival_us,
  CASE WHEN event_id % 101 = 0 THEN 0 ELSE 1000 + event_id % 500 END AS contact_id,
  CASE WHEN event_id % 79 = 0 THEN 'not-a-phone' ELSE concat('+1555', CAST(1000000 + event_id AS STRING)) END AS phone_number,
  CASE WHEN event_id % 71 = 0 THEN NULL ELSE concat('u', CAST(user_id AS STRING), '@example.com') END AS email_address,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('https://example.com/', CAST(event_id % 50 AS STRING)) END AS link_url,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 4000 END AS duration_seconds,
  props AS event_data
FROM events
"""

RAW_MESSAGES = """
SELECT CASE WHEN event_id % 3 = 0 THEN 'call-queue' ELSE 'digital-queue' END AS topic,
  CAST(user_id % 4 AS INT) AS partition, event_id AS "offset",
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('user', CAST(user_id AS STRING)) END AS "key",
  CASE event_id % 20
    WHEN 0 THEN 'garbage'
    WHEN 1 THEN concat('TS', CAST({US} {DIV} 1000 AS STRING), '@user', CAST(user_id AS STRING), ':DROP')
    WHEN 2 THEN concat('TS@@user', CAST(user_id AS STRING), ':DROP:1')
    WHEN 3 THEN concat('TS', CAST({US} {DIV} 1000 AS STRING), '@user', CAST(user_id AS STRING), ':PICKUP:notanumber:9')
    WHEN 4 THEN concat('{"eventId":"evt-', CAST(event_id AS STRING), '","userId":"user', CAST(user_id AS STRING), '","eventType":"EMAIL_OPEN"}')
    WHEN 5 THEN '{"eventId": broken'
    ELSE concat('TS', CAST({US} {DIV} 1000 AS STRING), '@user', CAST(user_id AS STRING), ':',
      CASE event_id % 5 WHEN 0 THEN 'DROP' WHEN 1 THEN 'PICKUP' WHEN 2 THEN 'DELIVERY' WHEN 3 THEN 'ANSWER' ELSE 'CANCEL' END,
      ':', CAST(1000 + event_id % 500 AS STRING), ':', CAST(event_id AS STRING)) END AS "value"
FROM events
"""

JOURNAL = """
SELECT concat('PersistentUserActor|', user_id) AS persistence_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts_us, seq) AS BIGINT) AS sequence_nr,
  event_type, event_data, ts, seq
FROM comm_events
WHERE trim(user_id) <> '' AND event_type IS NOT NULL AND ts_us IS NOT NULL
"""

LEGACY_EVENTS = """
SELECT seq AS id, user_id, event_type, ts,
  CASE WHEN event_type LIKE 'EMAIL%' THEN 'EMAIL' WHEN event_type LIKE 'SMS%' THEN 'SMS'
       WHEN event_type LIKE 'CALL%' AND seq % 2 = 0 THEN 'CALL' WHEN event_type LIKE 'CALL%' THEN 'PHONE' ELSE 'OTHER' END AS channel
FROM comm_events WHERE trim(user_id) <> '' AND ts_us IS NOT NULL
"""

MIGRATED_EVENTS = """
SELECT persistence_id, CASE WHEN seq % 211 = 0 THEN sequence_nr + 1 ELSE sequence_nr END AS sequence_nr, event_type,
  CASE WHEN seq % 199 = 0 THEN {NTZ:ts_us_j - 864000000000} ELSE ts END AS created, seq
FROM (SELECT j.*, c.ts_us AS ts_us_j FROM journal j JOIN comm_events c ON j.seq = c.seq) x
WHERE persistence_id NOT IN ('PersistentUserActor|user3', 'PersistentUserActor|user5') AND seq % 307 <> 0
"""

STAGE_LOG = """
SELECT event_id AS seq, ts, concat('user', CAST(user_id AS STRING)) AS user_id, event_type,
  CASE event_id % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'process' ELSE 'store' END AS stage,
  CASE WHEN event_id % 13 = 0 OR event_id % 400 < 24 THEN FALSE ELSE TRUE END AS ok,
  CAST(1 + (event_id * 37) % 2500 AS BIGINT) AS processing_ms,
  CASE WHEN NOT (event_id % 13 = 0 OR event_id % 400 < 24) THEN NULL
       WHEN event_id % 4 = 0 THEN concat('Connection timeout after ', CAST(event_id AS STRING), ' ms')
       WHEN event_id % 4 = 1 THEN concat('Invalid format at position ', CAST(event_id % 100 AS STRING))
       WHEN event_id % 4 = 2 THEN 'Temporary failure, retry later'
       ELSE concat('Unexpected error ', CAST(event_id AS STRING), ' while storing the event in the journal table') END AS error_message,
  CASE event_id % 6 WHEN 0 THEN 1040 WHEN 1 THEN 1205 WHEN 2 THEN 1213 WHEN 3 THEN 1062 WHEN 4 THEN 1146 ELSE 0 END AS error_code,
  CASE event_id % 12 WHEN 5 THEN '08001' WHEN 11 THEN '40001' ELSE NULL END AS sql_state,
  CAST(event_id % 4 AS INT) AS attempt
FROM events
"""

SAMPLES = """
SELECT event_id AS seq, {NTZ:1704067200000000 + event_id * 30000000} AS ts,
  CAST((event_id * 13) % 101 AS DOUBLE) AS cpu_usage,
  CASE WHEN event_id % 60 < 25 THEN 90.0 ELSE 40.0 END + CAST(event_id % 5 AS DOUBLE) AS memory_usage,
  CAST((event_id * 29) % 101 AS DOUBLE) AS disk_usage,
  CAST((event_id * 17) % 120 AS DOUBLE) / 10 AS throughput,
  CAST((event_id * 7) % 1500 AS BIGINT) AS consumer_lag
FROM events
"""

PROFILE_ATTRIBUTES = """
SELECT concat('user', CAST(c_custkey AS STRING)) AS user_id, c_mktsegment AS inquiry_vertical,
  CASE WHEN c_custkey % 6 = 0 THEN 'Business' ELSE NULL END AS area_of_interest,
  CAST(c_custkey % 5 AS BIGINT) AS disqualified_count,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 10 < 2 THEN TRUE ELSE FALSE END AS do_not_email
FROM customer
"""

CONTACTABLE_UPDATES = """
SELECT event_id AS seq, concat('user', CAST(user_id AS STRING)) AS user_id,
  CASE event_id % 6 WHEN 0 THEN 'CONTACTABLE' WHEN 1 THEN 'NOT_CONTACTABLE' WHEN 2 THEN 'PENDING_REVIEW'
    WHEN 3 THEN 'SUPPRESSED' WHEN 4 THEN 'OPTED_OUT' ELSE NULL END AS contactable_status,
  concat('node-', CAST(event_id % 9 AS STRING)) AS graph_node, ts AS processing_ts
FROM events WHERE event_id % 7 = 0
"""

JOB_HISTORY = """
SELECT concat(CASE event_id % 2 WHEN 0 THEN 'user_profile_enrichment_' ELSE 'cache_warming_' END, CAST(event_id AS STRING)) AS job_id,
  ts AS start_time,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE {NTZ:us + (event_id % 900) * 1000000} END AS end_time,
  CASE WHEN event_id % 29 = 0 THEN 'RUNNING' WHEN event_id % 3 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status
FROM (SELECT event_id, ts, {US} AS us FROM events WHERE event_id % 10 < 3) e
"""

#: View name -> (text, views it reads), in order of dependency.
VIEWS = {
    "comm_events": (COMM_EVENTS, []),
    "raw_messages": (RAW_MESSAGES, []),
    "journal": (JOURNAL, ["comm_events"]),
    "legacy_events": (LEGACY_EVENTS, ["comm_events"]),
    "migrated_events": (MIGRATED_EVENTS, ["comm_events", "journal"]),
    "stage_log": (STAGE_LOG, []),
    "samples": (SAMPLES, []),
    "profile_attributes": (PROFILE_ATTRIBUTES, []),
    "contactable_updates": (CONTACTABLE_UPDATES, []),
    "job_history": (JOB_HISTORY, []),
}

_TOKENS = {
    "spark": ("unix_micros(CAST(ts AS TIMESTAMP))", "div", r"CAST(timestamp_micros(\1) AS TIMESTAMP_NTZ)"),
    "duckdb": ("epoch_us(ts)", "//", r"make_timestamp(\1)"),
}


def render(text: str, engine: str) -> str:
    us, div, ntz = _TOKENS[engine]
    text = re.sub(r"\{NTZ:([^}]*)\}", ntz, text).replace("{US}", us).replace("{DIV}", div)
    if engine == "spark":
        text = re.sub(r'AS "(offset|key|value)"', r"AS `\1`", text)
    return text.strip()


def _closure(names: list[str], given: tuple[str, ...]) -> list[str]:
    need: set[str] = set()

    def visit(name: str) -> None:
        if name in given:
            return
        for dep in VIEWS[name][1]:
            visit(dep)
        need.add(name)

    for n in names:
        visit(n)
    return [n for n in VIEWS if n in need]


def with_views(names: list[str], body: str, engine: str, given: tuple[str, ...] = ()) -> str:
    """``body`` with the named views in front as common table expressions.

    Views in ``given`` exist already and are only read.
    """
    ctes = [f"{n} AS (\n{render(VIEWS[n][0], engine)}\n)" for n in _closure(names, given)]
    body = render(body, engine)
    if not ctes:
        return body
    recursive = re.match(r"WITH\s+RECURSIVE\s+", body, re.I)
    plain = re.match(r"WITH\s+", body, re.I)
    head = "WITH RECURSIVE " if recursive else "WITH "
    lead = recursive or plain
    rest = ",\n" + body[lead.end():] if lead else "\n" + body
    return head + ",\n".join(ctes) + rest


class Tables:
    """The derived tables of one scale factor, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = str(sf_dir).rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _derive(self, name: str, given: tuple[str, ...] = ()) -> DataFrame:
        for base in ("events", "customer"):
            self.base(base).createOrReplaceTempView(base)
        return self.spark.sql(with_views([name], f"SELECT * FROM {name}", "spark", given))

    @property
    def journal(self) -> DataFrame:
        """The journal view, numbered by the library's own job: a hot user is no single task here."""
        rows = self.comm_events.filter("trim(user_id) <> '' AND event_type IS NOT NULL AND ts_us IS NOT NULL")
        numbered = assign_sequence(rows.select("user_id", "event_type", "event_data", "ts", "seq"))
        return numbered.select(*JOURNAL_COLUMNS)

    @property
    def migrated_events(self) -> DataFrame:
        self.journal.createOrReplaceTempView("journal")
        return self._derive("migrated_events", ("journal",))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return self._derive(name)
