"""Questions about processing health, errors, alerts, event order and migration checks."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from rillbook.functions.clock import as_of
from rillbook.operators import activity as a, alerts as al, migration as m, monitoring as mon, sequence as sq
from rillbook.plans.ingest_questions import ACTION_SQL, METRICS, RESULTS
from rillbook.plans.registry import question

DAY = timedelta(days=1)
SIX_HOURS_MS = 6 * 3600 * 1000

# ------------------------------------------------------------ outcomes and latency


@question(
    "c14_outcome_summary",
    "stage_log",
    "WITH " + METRICS + """, s AS (SELECT count(*) FILTER (status = 'PROCESSED') AS processed, count(*) FILTER (status = 'FAILED') AS failed,
      count(*) FILTER (attempt > 0) AS retried, count(*) FILTER (reason = 'decode') AS decode_errors, count(*) FILTER (reason = 'sequence') AS sequence_errors,
      count(*) FILTER (reason = 'timeout') AS timeouts, sum(processing_time_ms)::DOUBLE / count(*)::DOUBLE AS avg_processing_ms FROM metrics),
    r AS (SELECT *, processed::DOUBLE / (processed + failed)::DOUBLE * 100.0::DOUBLE AS success_rate, failed::DOUBLE / (processed + failed)::DOUBLE * 100.0::DOUBLE AS error_rate FROM s)
    SELECT *, success_rate > 95 AND avg_processing_ms < 1000 AND timeouts < 10 AS is_healthy FROM r""",
)
def outcome_summary(t):
    return mon.outcome_summary(mon.processing_metrics(t.stage_log))


@question(
    "c14_outcome_counts",
    "stage_log",
    "WITH " + METRICS + "SELECT event_type, status, coalesce(reason, 'none') AS reason, attempt, count(*) AS n FROM metrics GROUP BY ALL",
)
def outcome_counts(t):
    return mon.outcome_counts(mon.processing_metrics(t.stage_log))


LATENCY = """lat0 AS (SELECT sum(processing_ms)::DOUBLE / count(*)::DOUBLE AS average_ms, quantile_cont(processing_ms, 0.95)::DOUBLE AS p95_ms, max(processing_ms) AS max_ms FROM stage_log),
lat AS (SELECT *, CASE WHEN average_ms < 100 THEN 'EXCELLENT' WHEN average_ms < 500 THEN 'GOOD' WHEN average_ms < 1000 THEN 'ACCEPTABLE' WHEN average_ms < 2000 THEN 'POOR'
  ELSE 'CRITICAL' END AS level, average_ms < 1000 AND p95_ms < 2000 AS is_healthy FROM lat0)
"""


@question("c15_latency", "stage_log", "WITH " + LATENCY + "SELECT * FROM lat")
def latency(t):
    return mon.latency(mon.processing_metrics(t.stage_log))


def _throughput_sql(minutes: int) -> str:
    return f"""tp0 AS (SELECT (SELECT max(ts) FROM stage_log) AS stop_at),
tp1 AS (SELECT ceil((epoch_us(ts) - epoch_us(stop_at - INTERVAL {minutes} MINUTE)) / 60000000.0) - 1 AS minute, count(*) AS n FROM stage_log, tp0
  WHERE ts > stop_at - INTERVAL {minutes} MINUTE AND ts <= stop_at GROUP BY 1),
tp2 AS (SELECT coalesce(sum(n), 0)::DOUBLE / {minutes * 60}.0::DOUBLE AS events_per_second, coalesce(max(n), 0)::DOUBLE / 60.0::DOUBLE AS peak_throughput FROM tp1),
tp3 AS (SELECT *, CASE WHEN peak_throughput > 0 THEN events_per_second / peak_throughput * 100.0::DOUBLE ELSE 0.0::DOUBLE END AS efficiency FROM tp2),
tp AS (SELECT *, CASE WHEN efficiency > 80 THEN 'Excellent throughput performance' WHEN efficiency > 50 THEN 'Good throughput performance'
  WHEN efficiency > 20 THEN 'Moderate throughput performance' ELSE 'Low throughput performance' END AS status, efficiency > 50 AS is_healthy FROM tp3)
"""


@question("c16_throughput", "stage_log", "WITH " + _throughput_sql(1440) + "SELECT * FROM tp")
def throughput(t):
    return mon.throughput(t.stage_log, as_of(t.stage_log), DAY)


# ------------------------------------------------------------------- stage health

HEALTH = """last_ok AS (SELECT stage, max((ts, seq)) FILTER (ok) AS p, max(ts) AS last_updated FROM stage_log GROUP BY stage),
runs AS (SELECT l.stage, l.last_updated, count(g.seq) AS consecutive_failures FROM last_ok l
  LEFT JOIN stage_log g ON g.stage = l.stage AND NOT g.ok AND (l.p IS NULL OR (g.ts, g.seq) > l.p) GROUP BY ALL),
health AS (SELECT *, consecutive_failures < 5 AS is_healthy,
  CASE WHEN consecutive_failures < 5 THEN 'Healthy' WHEN consecutive_failures >= 10 THEN 'Critical' ELSE 'Degraded' END AS health_status,
  CASE WHEN consecutive_failures < 5 THEN 100.0::DOUBLE ELSE greatest(10.0::DOUBLE, 100.0::DOUBLE - least(consecutive_failures * 10.0::DOUBLE, 90.0::DOUBLE)) END AS health_score,
  consecutive_failures >= 5 AS requires_attention, CASE WHEN consecutive_failures < 5 THEN 'Improving' ELSE 'Declining' END AS trend FROM runs)
"""

# A second, independent form: islands of equal outcome, the last row of each stage.
HEALTH_BY_ISLANDS = """isl AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY stage ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM stage_log),
numbered AS (SELECT stage, ts, seq, ok, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY stage, island ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM isl),
runs AS (SELECT stage, ts AS last_updated, CAST(run AS BIGINT) AS consecutive_failures FROM numbered QUALIFY row_number() OVER (PARTITION BY stage ORDER BY ts DESC, seq DESC) = 1),
health AS (SELECT *, consecutive_failures < 5 AS is_healthy,
  CASE WHEN consecutive_failures < 5 THEN 'Healthy' WHEN consecutive_failures >= 10 THEN 'Critical' ELSE 'Degraded' END AS health_status,
  CASE WHEN consecutive_failures < 5 THEN 100.0::DOUBLE ELSE greatest(10.0::DOUBLE, 100.0::DOUBLE - least(consecutive_failures * 10.0::DOUBLE, 90.0::DOUBLE)) END AS health_score,
  consecutive_failures >= 5 AS requires_attention, CASE WHEN consecutive_failures < 5 THEN 'Improving' ELSE 'Declining' END AS trend FROM runs)
"""


@question("e04_stage_health", "stage_log", "WITH " + HEALTH_BY_ISLANDS + "SELECT * FROM health")
def stage_health(t):
    return mon.stage_health(t.stage_log)


def _funnel_sql(minutes: int) -> str:
    cols = ", ".join(
        f"count(*) FILTER (stage = '{s}' AND ok) AS {s}_events, count(*) FILTER (stage = '{s}' AND NOT ok) AS {s}_errors, "
        f"(count(*) FILTER (stage = '{s}' AND ok AND ts > stop_at - INTERVAL {minutes} MINUTE AND ts <= stop_at))::DOUBLE / {minutes}.0::DOUBLE AS {s}_throughput"
        for s in ("source", "process", "store")
    )
    return f"""WITH {HEALTH}, f0 AS (SELECT {cols} FROM stage_log, (SELECT max(ts) AS stop_at FROM stage_log) AS x),
    f1 AS (SELECT *, source_errors + process_errors + store_errors AS total_errors,
      CASE WHEN source_events > 0 THEN store_events::DOUBLE / source_events::DOUBLE * 100.0::DOUBLE ELSE 100.0::DOUBLE END AS success_rate,
      CASE WHEN source_events > 0 THEN store_events::DOUBLE / source_events::DOUBLE * 100.0::DOUBLE ELSE 100.0::DOUBLE END AS efficiency,
      greatest(0, source_events - store_events) AS events_in_progress, (source_throughput + process_throughput + store_throughput) / 3.0::DOUBLE AS avg_throughput,
      (SELECT bool_and(is_healthy) FROM health) AS stages_healthy FROM f0),
    f2 AS (SELECT *, CASE WHEN source_events > 0 THEN total_errors::DOUBLE / source_events::DOUBLE * 100.0::DOUBLE ELSE 0.0::DOUBLE END AS error_rate,
      CASE least(source_throughput, process_throughput, store_throughput) WHEN source_throughput THEN 'source' WHEN process_throughput THEN 'process' ELSE 'store' END AS bottleneck,
      least(100.0::DOUBLE, avg_throughput / 1000.0::DOUBLE * 100.0::DOUBLE) AS utilization FROM f1)
    SELECT *, CASE WHEN stages_healthy AND error_rate < 5 THEN 'Healthy' WHEN error_rate > 20 THEN 'Critical' WHEN error_rate > 10 THEN 'Degraded' ELSE 'Warning' END AS health_status
    FROM f2"""


@question("c17_stage_funnel", "stage_log", _funnel_sql(1440))
def stage_funnel(t):
    return mon.stage_funnel(t.stage_log, as_of(t.stage_log), DAY)


FLOW = """WITH r AS (SELECT * FROM stage_log WHERE ok AND ts > (SELECT max(ts) FROM stage_log) - INTERVAL 1440 MINUTE),
f0 AS (SELECT count(*) FILTER (stage = 'source') AS source_events, count(*) FILTER (stage = 'process') AS process_events, count(*) FILTER (stage = 'store') AS store_events,
  coalesce(sum(processing_ms) FILTER (stage = 'source'), 0)::DOUBLE AS a, coalesce(sum(processing_ms) FILTER (stage = 'process'), 0)::DOUBLE AS b,
  coalesce(sum(processing_ms) FILTER (stage = 'store'), 0)::DOUBLE AS c FROM r),
f1 AS (SELECT source_events, process_events, store_events,
  CASE WHEN source_events > 0 THEN a / source_events::DOUBLE ELSE 0.0::DOUBLE END AS source_avg_ms,
  CASE WHEN process_events > 0 THEN b / process_events::DOUBLE ELSE 0.0::DOUBLE END AS process_avg_ms,
  CASE WHEN store_events > 0 THEN c / store_events::DOUBLE ELSE 0.0::DOUBLE END AS store_avg_ms,
  CASE WHEN source_events > 0 THEN least(100.0::DOUBLE, process_events::DOUBLE / source_events::DOUBLE * 100.0::DOUBLE) ELSE 0.0::DOUBLE END AS source_to_process_pct,
  CASE WHEN process_events > 0 THEN least(100.0::DOUBLE, store_events::DOUBLE / process_events::DOUBLE * 100.0::DOUBLE) ELSE 0.0::DOUBLE END AS process_to_store_pct,
  CASE WHEN source_events > 0 THEN least(100.0::DOUBLE, store_events::DOUBLE / source_events::DOUBLE * 100.0::DOUBLE) ELSE 0.0::DOUBLE END AS end_to_end_pct FROM f0),
f2 AS (SELECT *, source_avg_ms + process_avg_ms + store_avg_ms AS total_ms,
  CASE WHEN source_avg_ms >= process_avg_ms AND source_avg_ms >= store_avg_ms THEN 'source' WHEN process_avg_ms >= store_avg_ms THEN 'process' ELSE 'store' END AS slowest_stage,
  CASE WHEN source_avg_ms <= process_avg_ms AND source_avg_ms <= store_avg_ms THEN 'source' WHEN process_avg_ms <= store_avg_ms THEN 'process' ELSE 'store' END AS fastest_stage FROM f1),
f3 AS (SELECT *, CASE WHEN end_to_end_pct >= 95 THEN 'Excellent' WHEN end_to_end_pct >= 85 THEN 'Good' WHEN end_to_end_pct >= 70 THEN 'Fair' WHEN end_to_end_pct >= 50 THEN 'Poor'
  ELSE 'Critical' END AS flow_efficiency,
  CASE WHEN total_ms <= 100 THEN 'Very Fast' WHEN total_ms <= 500 THEN 'Fast' WHEN total_ms <= 1000 THEN 'Moderate' WHEN total_ms <= 2000 THEN 'Slow' ELSE 'Very Slow' END AS processing_speed,
  CASE WHEN total_ms > 0 THEN (source_events * 1000.0::DOUBLE) / total_ms ELSE 0.0::DOUBLE END AS events_per_second FROM f2)
SELECT *, flow_efficiency || ' flow at ' || processing_speed || ' speed: ' || printf('%.1f', end_to_end_pct) || '% arrive, ' || CAST(floor(total_ms) AS BIGINT) || ' ms in all' AS flow_summary
FROM f3"""


@question("c18_stage_flow", "stage_log", FLOW)
def stage_flow(t):
    return mon.stage_flow(t.stage_log, as_of(t.stage_log), DAY)


# ------------------------------------------------------------------------- errors

ERRORS = """err AS (SELECT *, stage || ':' || event_type || ':' || regexp_replace(error_message, '[0-9]+', 'X', 'g') AS group_id,
  CASE WHEN lower(error_message) LIKE '%timeout%' OR lower(error_message) LIKE '%connection%' THEN 'High'
    WHEN lower(error_message) LIKE '%validation%' OR lower(error_message) LIKE '%format%' THEN 'Medium'
    WHEN lower(error_message) LIKE '%retry%' OR lower(error_message) LIKE '%temporary%' THEN 'Low' ELSE 'Medium' END AS severity,
  CASE WHEN length(error_message) <= 50 THEN error_message ELSE left(error_message, 47) || '...' END AS short_message,
  CASE WHEN lower(error_message) LIKE '%timeout%' THEN 'timeout' WHEN lower(error_message) LIKE '%format%' THEN 'decode'
    WHEN lower(error_message) LIKE '%sequence%' THEN 'sequence' WHEN lower(error_message) LIKE '%temporary%' THEN 'temporary' ELSE 'other' END AS reason
  FROM stage_log WHERE NOT ok AND error_message IS NOT NULL)
"""


@question(
    "c19_error_details",
    "stage_log",
    "WITH " + ERRORS + """SELECT seq, stage, event_type, user_id, ts, severity, short_message, group_id,
    CAST(floor((epoch_us((SELECT max(ts) FROM stage_log)) - epoch_us(ts)) / 60000000.0) AS BIGINT) AS age_minutes,
    ts > (SELECT max(ts) FROM stage_log) - INTERVAL 5 MINUTE AS is_recent FROM err""",
)
def error_details(t):
    return mon.error_details(t.stage_log, as_of(t.stage_log))


def _error_question(name: str, *by: str):
    keys = ", ".join(by)

    @question(name, "stage_log", f"WITH {ERRORS} SELECT {keys}, count(*) AS n FROM err WHERE user_id IS NOT NULL GROUP BY ALL")
    def job(t):
        return mon.error_counts(t.stage_log, *by)

    return job


errors_by_stage = _error_question("c19_errors_by_stage", "stage")
errors_by_group = _error_question("c19_errors_by_group", "group_id")
errors_by_severity = _error_question("c19_errors_by_severity", "severity")
similar_errors = _error_question("c19_similar_errors", "stage", "event_type", "user_id")
errors_by_type = _error_question("c19_errors_by_type", "reason")
errors_by_user = _error_question("c19_errors_by_user", "user_id")


@question(
    "c19_errors_of_user",
    "stage_log",
    "SELECT seq, stage, event_type, error_message, ts FROM stage_log WHERE NOT ok AND error_message IS NOT NULL AND user_id = 'user7'",
)
def errors_of_user(t):
    return mon.errors_of_user(t.stage_log, "user7")


LATEST_ERRORS = """q AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ts DESC, seq DESC) AS rank_in_key FROM stage_log WHERE NOT ok AND error_message IS NOT NULL)"""


@question(
    "e06_latest_errors",
    "stage_log",
    "WITH " + LATEST_ERRORS + "SELECT seq, stage, user_id, event_type, error_message, ts, rank_in_key FROM q WHERE rank_in_key <= 100",
)
def latest_errors(t):
    return mon.latest_errors(t.stage_log).select("seq", "stage", "user_id", "event_type", "error_message", "ts", "rank_in_key")


@question(
    "f06_recent_errors",
    "stage_log",
    "WITH " + LATEST_ERRORS + "SELECT seq, stage, user_id, event_type, error_message, ts FROM q WHERE rank_in_key <= 16 ORDER BY ts DESC, seq DESC LIMIT 50",
)
def recent_errors(t):
    return mon.recent_errors(t.stage_log, 50).select("seq", "stage", "user_id", "event_type", "error_message", "ts")


@question(
    "c24_batch_outcome",
    "stage_log",
    """SELECT count(*) AS total_events, count(*) FILTER (ok) AS success_count, count(*) FILTER (NOT ok) AS error_count, count(*) FILTER (NOT ok) = 0 AS all_ok,
    (count(*) FILTER (ok)) || ' passed and ' || (count(*) FILTER (NOT ok)) || ' did not' AS message FROM stage_log""",
)
def batch_outcome(t):
    return mon.batch_outcome(t.stage_log)


@question(
    "c26_tag_counts",
    "stage_log",
    "WITH " + METRICS + "SELECT status, event_type, CASE WHEN status = 'PROCESSED' THEN user_id ELSE coalesce(reason, 'none') END AS tag, count(*) AS n FROM metrics GROUP BY ALL",
)
def tag_counts(t):
    return mon.tag_counts(mon.processing_metrics(t.stage_log))


@question(
    "h02_retry_plan",
    "stage_log",
    f"""WITH p AS (SELECT *, {ACTION_SQL} AS action FROM stage_log)
    SELECT seq, error_code, sql_state, attempt, action, action LIKE 'RETRY%' AS is_retryable,
      CAST(CASE WHEN action IN ('RETRY', 'RETRY_WITH_RANDOM_DELAY') THEN 100 WHEN action = 'RETRY_WITH_BACKOFF' THEN 100 * pow(2, attempt) ELSE 0 END AS BIGINT) AS delay_ms FROM p""",
)
def retry_plan(t):
    return mon.retry_plan(t.stage_log).select("seq", "error_code", "sql_state", "attempt", "action", "is_retryable", "delay_ms")


@question(
    "h02_retry_counts",
    "stage_log",
    f"""WITH p AS (SELECT *, {ACTION_SQL} AS action FROM stage_log)
    SELECT action, count(*) AS n, count(*) FILTER (action LIKE 'RETRY%') AS retryable,
      CAST(sum(CASE WHEN action IN ('RETRY', 'RETRY_WITH_RANDOM_DELAY') THEN 100 WHEN action = 'RETRY_WITH_BACKOFF' THEN 100 * pow(2, attempt) ELSE 0 END) AS BIGINT) AS total_delay_ms
    FROM p GROUP BY 1""",
)
def retry_counts(t):
    return mon.retry_counts(t.stage_log)


# -------------------------------------------------------------------- job history


@question(
    "c23_job_health",
    "job_history",
    """WITH n AS (SELECT max(start_time) AS t FROM job_history),
    s AS (SELECT count(*) FILTER (status = 'RUNNING' AND start_time < t - INTERVAL 2 HOUR) AS stuck_jobs,
      count(*) FILTER (status <> 'RUNNING' AND start_time > t - INTERVAL 1 HOUR) AS recent_jobs,
      count(*) FILTER (status = 'FAILED' AND start_time > t - INTERVAL 1 HOUR) AS recent_failures FROM job_history, n),
    r AS (SELECT *, CASE WHEN recent_jobs > 0 THEN recent_failures::DOUBLE / recent_jobs::DOUBLE ELSE 0.0::DOUBLE END AS failure_rate FROM s)
    SELECT *, stuck_jobs = 0 AND failure_rate <= 0.5 AS is_healthy FROM r""",
)
def job_health(t):
    return mon.job_health(t.job_history, as_of(t.job_history, ts="start_time"))


@question(
    "c23_latest_runs",
    "job_history",
    """SELECT regexp_replace(job_id, '_?[0-9]+$', '') AS family, job_id, start_time, end_time, status FROM job_history WHERE status <> 'RUNNING'
    QUALIFY row_number() OVER (PARTITION BY family ORDER BY start_time DESC, job_id DESC) = 1""",
)
def latest_runs(t):
    return mon.latest_runs(t.job_history)


@question(
    "c23_kept_jobs",
    "job_history",
    "SELECT * FROM job_history WHERE start_time >= (SELECT max(start_time) FROM job_history) - INTERVAL 7 DAY",
)
def kept_jobs(t):
    return mon.kept_jobs(t.job_history, as_of(t.job_history, ts="start_time"))


@question(
    "f08_latest_run",
    "job_history",
    """SELECT job_id, start_time, end_time, status FROM job_history WHERE status <> 'RUNNING' AND job_id LIKE 'user_profile_enrichment%'
    ORDER BY start_time DESC, job_id DESC LIMIT 1""",
)
def latest_run(t):
    return mon.latest_run_of(t.job_history, "user_profile_enrichment")


# --------------------------------------------------------- samples, trend, resources

SCORE = "(greatest(0.0::DOUBLE, 100.0::DOUBLE - cpu_usage) + greatest(0.0::DOUBLE, 100.0::DOUBLE - memory_usage) + least(100.0::DOUBLE, throughput * 10.0::DOUBLE)) / 3.0::DOUBLE"
LEVEL = "CASE WHEN score >= 80 THEN 'EXCELLENT' WHEN score >= 60 THEN 'GOOD' WHEN score >= 40 THEN 'FAIR' WHEN score >= 20 THEN 'POOR' WHEN score IS NOT NULL THEN 'CRITICAL' END"


@question(
    "e05_sample_trend",
    "samples",
    f"""WITH s AS (SELECT *, {SCORE} AS score FROM samples), l AS (SELECT *, lag(score) OVER (ORDER BY ts, seq) AS previous_score FROM s)
    SELECT seq, ts, score, {LEVEL} AS level, previous_score, CASE WHEN abs(score - previous_score) < 5 THEN 'STABLE' WHEN score > previous_score THEN 'IMPROVING'
      WHEN score < previous_score THEN 'DECLINING' END AS trend, cpu_usage < 80 AND memory_usage < 85 AND throughput > 0 AS is_healthy FROM l""",
)
def sample_trend(t):
    return mon.sample_trend(t.samples)


@question(
    "e08_hourly_series",
    "comm_events",
    """WITH n AS (SELECT max(ts) AS t FROM comm_events),
    cal AS (SELECT unnest(generate_series(date_trunc('hour', t) - INTERVAL 23 HOUR, t, INTERVAL 1 HOUR)) AS hour_start FROM n),
    k AS (SELECT date_trunc('hour', ts) AS hour_start, count(*) AS events, count(DISTINCT user_id) AS users FROM comm_events WHERE ts IS NOT NULL GROUP BY 1)
    SELECT c.hour_start, strftime(c.hour_start, '%H:%M') AS label, coalesce(events, 0) AS events, coalesce(users, 0) AS users FROM cal c LEFT JOIN k ON k.hour_start = c.hour_start""",
)
def hourly_series(t):
    return a.hourly_series(t.comm_events, as_of(t.comm_events))


@question(
    "e09_performance_trend",
    "samples stage_log",
    f"""WITH n AS (SELECT max(ts) AS t, max(ts) - INTERVAL 1 HOUR AS b FROM samples),
    cal AS (SELECT unnest(generate_series(0, 11)) AS bucket),
    e AS (SELECT CAST(ceil((epoch_us(ts) - epoch_us(b)) / 300000000.0) AS BIGINT) - 1 AS bucket, count(*) AS events FROM stage_log, n WHERE ts > b AND ts <= t GROUP BY 1),
    u AS (SELECT CAST(ceil((epoch_us(ts) - epoch_us(b)) / 300000000.0) AS BIGINT) - 1 AS bucket, sum(cpu_usage) / count(cpu_usage) AS cpu_usage, sum(memory_usage) / count(memory_usage) AS memory_usage
      FROM samples, n WHERE ts > b AND ts <= t GROUP BY 1),
    j AS (SELECT cal.bucket, (SELECT b FROM n) + cal.bucket * INTERVAL 5 MINUTE AS bucket_start, coalesce(events, 0) AS events, coalesce(events, 0)::DOUBLE / 300.0::DOUBLE AS throughput,
      cpu_usage, memory_usage FROM cal LEFT JOIN e ON e.bucket = cal.bucket LEFT JOIN u ON u.bucket = cal.bucket),
    s AS (SELECT *, {SCORE} AS score FROM j)
    SELECT *, {LEVEL} AS level FROM s""",
)
def performance_trend(t):
    return mon.performance_trend(t.stage_log, t.samples, as_of(t.samples))


STATE = """CASE WHEN cpu_usage > 90 THEN 'CPU_CRITICAL' WHEN memory_usage > 90 THEN 'MEMORY_CRITICAL' WHEN disk_usage > 95 THEN 'DISK_CRITICAL' WHEN cpu_usage > 75 THEN 'CPU_HIGH'
  WHEN memory_usage > 80 THEN 'MEMORY_HIGH' WHEN disk_usage > 85 THEN 'DISK_HIGH' ELSE 'NONE' END"""
RESOURCE_OK = "(cpu_usage < 80 AND memory_usage < 85 AND disk_usage < 90)"
MEMORY_MB = 8192.0


@question(
    "h01_resource_state",
    "samples",
    f"""SELECT seq, ts, cpu_usage, memory_usage, disk_usage, memory_usage / 100.0::DOUBLE * 8192.0::DOUBLE AS memory_used_mb,
    8192.0::DOUBLE - memory_usage / 100.0::DOUBLE * 8192.0::DOUBLE AS memory_available_mb, {RESOURCE_OK} AS is_healthy, {STATE} AS "constraint" FROM samples""",
)
def resource_state(t):
    return mon.resource_state(t.samples, MEMORY_MB)


@question(
    "h01_resource_counts",
    "samples",
    f"""SELECT {STATE} AS "constraint", count(*) AS n, count(*) FILTER {RESOURCE_OK} AS healthy FROM samples GROUP BY 1""",
)
def resource_counts(t):
    return mon.resource_counts(t.samples, MEMORY_MB)


def _summary_sql(minutes: int) -> str:
    return f"""WITH {LATENCY}, {_throughput_sql(minutes)},
    newest AS (SELECT cpu_usage, memory_usage, {RESOURCE_OK} AS ok FROM samples ORDER BY ts DESC, seq DESC LIMIT 1),
    o AS (SELECT tp.events_per_second, tp.peak_throughput, tp.is_healthy AS throughput_healthy, lat.average_ms, lat.is_healthy AS latency_healthy, newest.cpu_usage, newest.memory_usage,
      newest.ok AS resources_healthy FROM tp, lat, newest)
    SELECT *, throughput_healthy AND latency_healthy AND resources_healthy AS is_healthy,
      CASE WHEN throughput_healthy AND latency_healthy AND resources_healthy THEN 'all measures in bounds' ELSE 'some measures out of bounds' END AS status FROM o"""


@question("c29_performance_summary", "stage_log samples", _summary_sql(1440))
def performance_summary(t):
    return mon.performance_summary(t.stage_log, t.samples, as_of(t.stage_log), DAY)


@question("c29_last_minute", "stage_log samples", _summary_sql(1))
def last_minute(t):
    return mon.performance_summary(t.stage_log, t.samples, as_of(t.stage_log), timedelta(minutes=1))


# ------------------------------------------------------------------------- alerts

ALERTS = """WITH RECURSIVE readings AS (SELECT 'HIGH_MEMORY_USAGE' AS alert_type, seq, ts, memory_usage AS value, memory_usage > 80 AS breach FROM samples WHERE memory_usage > 0
  UNION ALL SELECT 'HIGH_KAFKA_LAG', seq, ts, consumer_lag::DOUBLE, consumer_lag > 1000 FROM samples WHERE consumer_lag > 0),
r AS (SELECT *, sum(CASE WHEN breach THEN 0 ELSE 1 END) OVER w AS run, lag(breach) OVER (PARTITION BY alert_type ORDER BY ts, seq) AS after_breach FROM readings
  WINDOW w AS (PARTITION BY alert_type ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
breaches AS (SELECT alert_type, run, seq, ts, value, row_number() OVER (PARTITION BY alert_type, run ORDER BY ts, seq) AS i,
  count(*) OVER (PARTITION BY alert_type, run ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM r WHERE breach),
hops AS (SELECT alert_type, run, i, seq, ts, value, i + count(*) OVER (PARTITION BY alert_type, run ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL '4 minutes 59.999999 seconds' FOLLOWING)
  - (i - min(i) OVER (PARTITION BY alert_type, run, ts)) AS nxt FROM breaches),
raised AS (SELECT * FROM hops WHERE i = 1 UNION ALL SELECT h.* FROM raised a JOIN hops h ON h.alert_type = a.alert_type AND h.run = a.run AND h.i = a.nxt)
"""


@question(
    "e10_alert_transitions",
    "samples",
    ALERTS + """SELECT alert_type, seq, ts, value, 'RAISED' AS event FROM raised
    UNION ALL SELECT alert_type, seq, ts, value, 'CLEARED' FROM r WHERE NOT breach AND after_breach""",
)
def alert_transitions(t):
    return al.alert_transitions(t.samples)


# ------------------------------------------------------------------- event order

SEQUENCE = """last AS (SELECT seq, event_id, user_id, event_type, ts_us, arrival_us, max(ts_us) OVER (PARTITION BY user_id ORDER BY arrival_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_us
  FROM comm_events WHERE user_id IS NOT NULL AND ts_us IS NOT NULL),
late AS (SELECT *, CASE WHEN last_us > ts_us THEN (last_us - ts_us) // 1000 END AS late_ms FROM last),
checked AS (SELECT *, CASE WHEN late_ms IS NULL THEN 'VALID' WHEN late_ms > 21600000 THEN 'INVALID' ELSE 'WARNING' END AS label FROM late
  UNION ALL SELECT seq, event_id, user_id, event_type, ts_us, arrival_us, NULL, NULL, 'INVALID' FROM comm_events WHERE user_id IS NULL OR ts_us IS NULL)
"""


@question("e03_sequence_check", "comm_events", "WITH " + SEQUENCE + "SELECT * FROM checked")
def sequence_check(t):
    return sq.sequence_check(t.comm_events, SIX_HOURS_MS)


@question(
    "e03_kept_violations",
    "comm_events",
    "WITH " + SEQUENCE + """SELECT event_id, user_id, event_type, ts_us, last_us, late_ms, label FROM checked WHERE late_ms IS NOT NULL
    AND last_us >= (SELECT max(ts_us) FROM comm_events) - 7 * 86400000000""",
)
def kept_violations(t):
    v = sq.sequence_violations(sq.sequence_check(t.comm_events, SIX_HOURS_MS))
    return sq.kept_violations(v, t.comm_events.agg(F.max("ts_us")).scalar())


# ------------------------------------------------------------------ migration checks


@question(
    "e02_out_of_order",
    "migrated_events",
    """SELECT persistence_id, count(*) AS out_of_order_count FROM (SELECT persistence_id, created, lag(created) OVER (PARTITION BY persistence_id ORDER BY sequence_nr, seq) AS p FROM migrated_events)
    WHERE p > created GROUP BY 1""",
)
def out_of_order(t):
    return m.out_of_order(t.migrated_events)


COUNTS = """src AS (UNPIVOT (SELECT count(*) AS total_events, count(DISTINCT user_id) AS unique_users, count(*) FILTER (channel = 'EMAIL') AS email_events,
  count(*) FILTER (channel = 'SMS') AS sms_events, count(*) FILTER (channel IN ('CALL', 'PHONE')) AS call_events FROM legacy_events) ON COLUMNS(*) INTO NAME measure VALUE events),
tgt AS (UNPIVOT (SELECT count(*) AS total_events, count(DISTINCT persistence_id) AS unique_users, count(*) FILTER (event_type LIKE 'EMAIL%') AS email_events,
  count(*) FILTER (event_type LIKE 'SMS%') AS sms_events, count(*) FILTER (event_type LIKE 'CALL%') AS call_events FROM migrated_events) ON COLUMNS(*) INTO NAME measure VALUE events)
"""


@question(
    "c20_reconciliation",
    "legacy_events migrated_events",
    "WITH " + COUNTS + "SELECT 'source' AS side, measure, events FROM src UNION ALL SELECT 'target', measure, events FROM tgt",
)
def reconciliation(t):
    src = m.source_counts(t.legacy_events).withColumn("side", F.lit("source"))
    return src.unionByName(m.target_counts(t.migrated_events).withColumn("side", F.lit("target")))


@question(
    "d07_count_comparison",
    "legacy_events migrated_events",
    "WITH " + COUNTS + """SELECT s.measure, s.events AS source_events, coalesce(t.events, 0) AS target_events, s.events - coalesce(t.events, 0) AS difference
    FROM src s LEFT JOIN tgt t ON s.measure = t.measure""",
)
def count_comparison(t):
    return m.compare_counts(m.source_counts(t.legacy_events), m.target_counts(t.migrated_events))


DUPLICATES = "SELECT persistence_id, sequence_nr, count(*) AS duplicate_count FROM migrated_events GROUP BY ALL HAVING count(*) > 1"


@question("c21_duplicate_sequences", "migrated_events", DUPLICATES)
def duplicate_sequences(t):
    return m.duplicate_sequences(t.migrated_events)


@question(
    "c20_validation_issues",
    "legacy_events migrated_events",
    "WITH " + COUNTS + f""", dup AS ({DUPLICATES}),
    ord AS (SELECT persistence_id, count(*) AS n FROM (SELECT persistence_id, created, lag(created) OVER (PARTITION BY persistence_id ORDER BY sequence_nr, seq) AS p FROM migrated_events)
      WHERE p > created GROUP BY 1),
    mis AS (SELECT user_id FROM legacy_events EXCEPT SELECT split_part(persistence_id, '|', -1) FROM migrated_events)
    SELECT 'counts' AS "check", s.measure || ': ' || s.events || ' in the source, ' || t.events || ' in the target, ' || (s.events - t.events) || ' apart' AS message
      FROM src s JOIN tgt t ON s.measure = t.measure WHERE s.events <> t.events
    UNION ALL SELECT 'duplicates', persistence_id || ' has one sequence number ' || duplicate_count || ' times' FROM dup
    UNION ALL SELECT 'users', 'no copied row of user ' || user_id FROM mis
    UNION ALL SELECT 'ordering', persistence_id || ' has rows older than the row before them: ' || n FROM ord""",
)
def validation_issues(t):
    return m.validation_issues(t.legacy_events, t.migrated_events)


@question(
    "c22_migration_progress",
    "legacy_events migrated_events",
    "WITH " + RESULTS + """, s AS (SELECT count(*) AS total_records, count(*) AS processed, count(*) FILTER (status = 'SUCCESS') AS successful, count(*) FILTER (status = 'FAILED') AS failed,
      count(*) FILTER (status = 'SKIPPED') AS skipped, epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 AS duration_seconds FROM results),
    p AS (SELECT *, processed::DOUBLE / total_records::DOUBLE * 100.0::DOUBLE AS progress_pct, CASE WHEN duration_seconds > 0 THEN processed // duration_seconds ELSE 0 END AS records_per_second FROM s)
    SELECT *, processed || ' of ' || total_records || ' copied (' || printf('%.2f', progress_pct) || '%): ' || successful || ' good, ' || failed || ' bad, ' ||
      skipped || ' passed over; ' || records_per_second || ' a second for ' || duration_seconds || ' s' AS status_line FROM p""",
)
def migration_progress(t):
    return m.progress(m.migration_results(t.legacy_events, t.migrated_events))


@question(
    "c22_may_continue",
    "legacy_events migrated_events",
    "WITH " + RESULTS + """SELECT count(*) AS processed, count(*) FILTER (status = 'FAILED') AS failed, (count(*) FILTER (status = 'FAILED'))::DOUBLE / count(*)::DOUBLE AS error_rate,
    (count(*) FILTER (status = 'FAILED'))::DOUBLE / count(*)::DOUBLE <= 0.01 AS may_continue FROM results""",
)
def may_continue(t):
    return m.may_continue(m.migration_results(t.legacy_events, t.migrated_events), 0.01)


@question(
    "c22_error_report",
    "legacy_events migrated_events",
    "WITH " + RESULTS + "SELECT *, (SELECT count(*) FROM errors) > 1000 AS truncated FROM errors ORDER BY id LIMIT 1000",
)
def error_report(t):
    return m.error_report(m.migration_errors(m.migration_results(t.legacy_events, t.migrated_events)))


@question(
    "c19_migration_errors_by_type",
    "legacy_events migrated_events",
    "WITH " + RESULTS + "SELECT error_type, count(*) AS n FROM errors GROUP BY 1",
)
def migration_errors_by_type(t):
    return m.errors_by_type(m.migration_errors(m.migration_results(t.legacy_events, t.migrated_events)))


@question(
    "f07_top_error_users",
    "legacy_events migrated_events",
    "WITH " + RESULTS + "SELECT user_id, count(*) AS n FROM errors WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
)
def top_error_users(t):
    return m.top_error_users(m.migration_errors(m.migration_results(t.legacy_events, t.migrated_events)))
