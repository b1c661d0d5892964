"""Throughput, latency, stage health, errors, resources and job history."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from rillbook.functions.clock import micros, span, time_key
from rillbook.functions.text import ladder, percent, ratio
from rillbook.operators.ordered import Running, latest_per_key, running
from rillbook.schemas import STAGES

c = F.col


# ------------------------------------------------------------------- outcomes


def failure_reason(message: Column) -> Column:
    m = F.lower(message)
    return F.when(
        message.isNotNull(),
        ladder(
            [
                (F.contains(m, F.lit("timeout")), "timeout"),
                (F.contains(m, F.lit("format")), "decode"),
                (F.contains(m, F.lit("sequence")), "sequence"),
                (F.contains(m, F.lit("temporary")), "temporary"),
            ],
            "other",
        ),
    )


def processing_metrics(log: DataFrame) -> DataFrame:
    """The append-only table behind the outcome and latency questions."""
    return log.select(
        "seq", "user_id", "event_type", "stage",
        c("processing_ms").alias("processing_time_ms"), c("ts").alias("processed_at"),
        F.when(c("ok"), "PROCESSED").otherwise("FAILED").alias("status"),
        failure_reason(c("error_message")).alias("reason"),
        c("attempt"),
    )


def outcome_summary(metrics: DataFrame) -> DataFrame:
    processed = F.count_if(c("status") == "PROCESSED")
    failed = F.count_if(c("status") == "FAILED")
    out = metrics.agg(
        processed.alias("processed"),
        failed.alias("failed"),
        F.count_if(c("attempt") > 0).alias("retried"),
        F.count_if(c("reason") == "decode").alias("decode_errors"),
        F.count_if(c("reason") == "sequence").alias("sequence_errors"),
        F.count_if(c("reason") == "timeout").alias("timeouts"),
        ratio(F.coalesce(F.sum("processing_time_ms"), F.lit(0)), F.count(F.lit(1))).alias("avg_processing_ms"),
    )
    total = c("processed") + c("failed")
    out = out.withColumns({"success_rate": percent(c("processed"), total), "error_rate": percent(c("failed"), total)})
    return out.withColumn(
        "is_healthy", (c("success_rate") > 95.0) & (c("avg_processing_ms") < 1000.0) & (c("timeouts") < 10)
    )


def outcome_counts(metrics: DataFrame) -> DataFrame:
    """The same counts by event type, reason and attempt."""
    return metrics.groupBy("event_type", "status", F.coalesce("reason", F.lit("none")).alias("reason"), "attempt").agg(
        F.count(F.lit(1)).alias("n")
    )


def tag_counts(metrics: DataFrame) -> DataFrame:
    """Processed by type and user, failed by type and reason, in one table of tags."""
    tag = F.when(c("status") == "PROCESSED", c("user_id")).otherwise(F.coalesce("reason", F.lit("none")))
    return metrics.groupBy("status", "event_type", tag.alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def batch_outcome(log: DataFrame) -> DataFrame:
    ok, all_ = F.count_if(c("ok")), F.count(F.lit(1))
    out = log.agg(all_.alias("total_events"), ok.alias("success_count"), (all_ - ok).alias("error_count"))
    return out.withColumn("all_ok", c("error_count") == 0).withColumn(
        "message", F.concat(c("success_count"), F.lit(" passed and "), c("error_count"), F.lit(" did not"))
    )


# --------------------------------------------------------- latency, throughput


def latency(metrics: DataFrame, approximate: bool = False) -> DataFrame:
    """Mean, 95th percentile, maximum and their bands.

    Times are whole milliseconds, so the exact percentile keeps one counter per distinct value;
    ``approximate`` bounds it where times are finer.
    """
    t = c("processing_time_ms")
    p95 = F.percentile_approx(t, 0.95, 10000).cast("double") if approximate else F.percentile(t, 0.95)
    out = metrics.agg(
        ratio(F.coalesce(F.sum(t), F.lit(0)), F.count(t)).alias("average_ms"),
        F.coalesce(p95, F.lit(0.0)).alias("p95_ms"),
        F.coalesce(F.max(t), F.lit(0)).alias("max_ms"),
    )
    avg = c("average_ms")
    level = ladder([(avg < 100, "EXCELLENT"), (avg < 500, "GOOD"), (avg < 1000, "ACCEPTABLE"), (avg < 2000, "POOR")], "CRITICAL")
    return out.withColumns({"level": level, "is_healthy": (avg < 1000) & (c("p95_ms") < 2000)})


def _bucket(ts: Column, start: Column, seconds: int) -> Column:
    """Index of the left-open, right-closed bucket after ``start``."""
    return F.ceil((micros(ts) - micros(start)) / F.lit(seconds * 1_000_000)) - 1


# Throughput bands.
THROUGHPUT_BANDS = {
    80.0: "Excellent throughput performance",
    50.0: "Good throughput performance",
    20.0: "Moderate throughput performance",
}
THROUGHPUT_LOW = "Low throughput performance"


def throughput(log: DataFrame, as_of: Column, period: timedelta = timedelta(minutes=5)) -> DataFrame:
    """Events per second over the period and in its busiest minute.

    Minutes without events cannot be the busiest, so only minutes with events are counted.
    """
    start = as_of - span(period)
    per_minute = (
        log.filter((c("ts") > start) & (c("ts") <= as_of))
        .groupBy(_bucket(c("ts"), start, 60).alias("minute"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    seconds = period.total_seconds()
    out = per_minute.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) / F.lit(seconds)).alias("events_per_second"),
        (F.coalesce(F.max("n"), F.lit(0)) / F.lit(60.0)).alias("peak_throughput"),
    )
    out = out.withColumn("efficiency", percent(c("events_per_second"), c("peak_throughput")))
    status = ladder([(c("efficiency") > k, v) for k, v in THROUGHPUT_BANDS.items()], THROUGHPUT_LOW)
    return out.withColumns({"status": status, "is_healthy": c("efficiency") > 50.0})


# ------------------------------------------------------------------ stage health


def consecutive_failures(log: DataFrame) -> DataFrame:
    """Failures since the last success of each stage.

    Only the run at the end matters: find the last success per stage, count failures after it. Two
    plain aggregates instead of a sort of all rows of a stage; the broadcast is one row per stage.
    """
    rows = log.filter(c("stage").isin(STAGES)).withColumn("pos", time_key(c("ts"), c("seq")))
    last_ok = rows.groupBy("stage").agg(F.max(F.when(c("ok"), c("pos"))).alias("last_ok"), F.max("ts").alias("last_updated"))
    after = (
        rows.filter(~c("ok"))
        .join(F.broadcast(last_ok), "stage")
        .filter(c("last_ok").isNull() | (c("pos") > c("last_ok")))
        .groupBy("stage")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return last_ok.join(F.broadcast(after), "stage", "left").select(
        "stage", "last_updated", F.coalesce("n", F.lit(0)).alias("consecutive_failures")
    )


def health_state(healthy: Column, failures: Column) -> Column:
    return F.when(healthy, "Healthy").when(failures >= 10, "Critical").when(failures >= 5, "Degraded").otherwise("Warning")


def stage_health(log: DataFrame) -> DataFrame:
    f = c("consecutive_failures")
    healthy = c("is_healthy")
    return consecutive_failures(log).withColumn("is_healthy", f < 5).withColumns(
        {
            "health_status": health_state(healthy, f),
            "health_score": F.when(healthy, 100.0).otherwise(
                F.greatest(F.lit(10.0), F.lit(100.0) - F.least(f * 10.0, F.lit(90.0)))
            ),
            "requires_attention": ~healthy & (f >= 5),
            "trend": F.when(healthy, "Improving").when(f <= 2, "Stable").otherwise("Declining"),
        }
    )


def stage_funnel(log: DataFrame, as_of: Column, period: timedelta = timedelta(minutes=5)) -> DataFrame:
    """How many events each stage passed on, where they get stuck, and a verdict: one row.

    Counts, errors and throughput come from one aggregate without a key; stage health adds one row
    per stage.
    """
    start = as_of - span(period)
    minutes = period.total_seconds() / 60
    aggs = []
    for s in STAGES:
        here = c("stage") == s
        aggs += [
            F.count_if(here & c("ok")).alias(f"{s}_events"),
            F.count_if(here & ~c("ok")).alias(f"{s}_errors"),
            (F.count_if(here & c("ok") & (c("ts") > start) & (c("ts") <= as_of)) / F.lit(minutes)).alias(f"{s}_throughput"),
        ]
    out = log.agg(*aggs)
    healthy = stage_health(log).agg(F.coalesce(F.bool_and("is_healthy"), F.lit(True)).alias("h")).scalar()
    ev, tp = [c(f"{s}_events") for s in STAGES], [c(f"{s}_throughput") for s in STAGES]
    received, completed = ev[0], ev[-1]
    out = out.withColumns(
        {
            "total_errors": sum((c(f"{s}_errors") for s in STAGES[1:]), c(f"{STAGES[0]}_errors")),
            "success_rate": percent(completed, received, 100.0),
            "efficiency": percent(completed, received, 100.0),
            "events_in_progress": F.greatest(F.lit(0).cast("bigint"), received - completed),
            "avg_throughput": (tp[0] + tp[1] + tp[2]) / 3.0,
            "stages_healthy": healthy,
        }
    )
    low = F.least(*tp)
    out = out.withColumns(
        {
            "error_rate": percent(c("total_errors"), received),
            "bottleneck": ladder([(low == tp[i], s) for i, s in enumerate(STAGES[:-1])], STAGES[-1]),
            "utilization": F.least(F.lit(100.0), c("avg_throughput") / 1000.0 * 100.0),
        }
    )
    ok = c("stages_healthy") & (c("error_rate") < 5.0)
    return out.withColumn(
        "health_status",
        ladder([(ok, "Healthy"), (c("error_rate") > 20.0, "Critical"), (c("error_rate") > 10.0, "Degraded")], "Warning"),
    )


def stage_flow(log: DataFrame, as_of: Column, period: timedelta = timedelta(minutes=5)) -> DataFrame:
    """Share of events that reach the next stage and time spent per stage, within the period: one row."""
    rows = log.filter(c("ok") & (c("ts") > as_of - span(period)) & (c("ts") <= as_of))
    aggs = []
    for s in STAGES:
        here = c("stage") == s
        aggs += [
            F.count_if(here).alias(f"{s}_events"),
            F.coalesce(F.sum(F.when(here, c("processing_ms"))), F.lit(0)).alias(f"{s}_ms_sum"),
        ]
    out = rows.agg(*aggs)
    ev = [c(f"{s}_events") for s in STAGES]
    ms = [c(f"{s}_avg_ms") for s in STAGES]

    def clamp(x: Column) -> Column:
        return F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))

    out = out.withColumns({f"{s}_avg_ms": ratio(c(f"{s}_ms_sum"), c(f"{s}_events")) for s in STAGES}).withColumns(
        {
            "source_to_process_pct": clamp(percent(ev[1], ev[0])),
            "process_to_store_pct": clamp(percent(ev[2], ev[1])),
            "end_to_end_pct": clamp(percent(ev[2], ev[0])),
            "total_ms": ms[0] + ms[1] + ms[2],
            "slowest_stage": ladder([((ms[0] >= ms[1]) & (ms[0] >= ms[2]), STAGES[0]), (ms[1] >= ms[2], STAGES[1])], STAGES[2]),
            "fastest_stage": ladder([((ms[0] <= ms[1]) & (ms[0] <= ms[2]), STAGES[0]), (ms[1] <= ms[2], STAGES[1])], STAGES[2]),
        }
    )
    e2e, total = c("end_to_end_pct"), c("total_ms")
    out = out.withColumns(
        {
            "flow_efficiency": ladder([(e2e >= 95.0, "Excellent"), (e2e >= 85.0, "Good"), (e2e >= 70.0, "Fair"), (e2e >= 50.0, "Poor")], "Critical"),
            "processing_speed": ladder(
                [(total <= 100, "Very Fast"), (total <= 500, "Fast"), (total <= 1000, "Moderate"), (total <= 2000, "Slow")], "Very Slow"
            ),
            "events_per_second": ratio(ev[0] * 1000.0, total),
        }
    )
    line = F.format_string(
        "%s flow at %s speed: %.1f%% arrive, %d ms in all",
        c("flow_efficiency"), c("processing_speed"), e2e, F.floor(total).cast("bigint"),
    )
    return out.withColumn("flow_summary", line).drop(*[f"{s}_ms_sum" for s in STAGES])


# ------------------------------------------------------------------------ errors


def severity(message: Column) -> Column:
    m = F.lower(message)

    def has(*words: str) -> Column:
        a, b = words
        return F.contains(m, F.lit(a)) | F.contains(m, F.lit(b))

    return ladder(
        [(has("timeout", "connection"), "High"), (has("validation", "format"), "Medium"), (has("retry", "temporary"), "Low")], "Medium"
    )


def short_message(message: Column) -> Column:
    return F.when(F.length(message) <= 50, message).otherwise(F.concat(F.substring(message, 1, 47), F.lit("...")))


def error_group(stage: Column, event_type: Column, message: Column) -> Column:
    """Stage, type and message with every number masked."""
    return F.concat(stage, F.lit(":"), event_type, F.lit(":"), F.regexp_replace(message, r"[0-9]+", "X"))


def error_rows(log: DataFrame) -> DataFrame:
    return log.filter(~c("ok") & c("error_message").isNotNull())


def error_details(log: DataFrame, as_of: Column) -> DataFrame:
    age = (micros(as_of) - micros(c("ts"))) / F.lit(60_000_000)
    return error_rows(log).select(
        "seq", "stage", "event_type", "user_id", "ts",
        severity(c("error_message")).alias("severity"),
        short_message(c("error_message")).alias("short_message"),
        error_group(c("stage"), c("event_type"), c("error_message")).alias("group_id"),
        F.floor(age).cast("bigint").alias("age_minutes"),
        (c("ts") > as_of - span(timedelta(minutes=5))).alias("is_recent"),
    )


def error_counts(log: DataFrame, *by: str) -> DataFrame:
    """Errors by stage, type, user, group or any of their combinations; a missing user is left out."""
    rows = error_rows(log).withColumns(
        {
            "group_id": error_group(c("stage"), c("event_type"), c("error_message")),
            "severity": severity(c("error_message")),
            "reason": failure_reason(c("error_message")),
        }
    )
    if "user_id" in by:
        rows = rows.filter(c("user_id").isNotNull())
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def errors_of_user(log: DataFrame, user_id: str) -> DataFrame:
    return error_rows(log).filter(c("user_id") == user_id).select("seq", "stage", "event_type", "error_message", "ts")


def latest_errors(log: DataFrame, per_stage: int = 100) -> DataFrame:
    """The newest errors every stage keeps."""
    return latest_per_key(
        error_rows(log), ["stage"], [F.desc("ts"), F.desc("seq")], per_stage
    )


def recent_errors(log: DataFrame, limit: int = 50) -> DataFrame:
    """An equal quota of newest errors per stage, merged, newest first."""
    return latest_errors(log, limit // len(STAGES)).drop("rank_in_key").orderBy(F.desc("ts"), F.desc("seq")).limit(limit)


# ----------------------------------------------------- samples: trend, resources


def performance_score(cpu: Column, memory: Column, rate: Column) -> Column:
    zero, top = F.lit(0.0), F.lit(100.0)
    return (F.greatest(zero, top - cpu) + F.greatest(zero, top - memory) + F.least(top, rate * 10.0)) / 3.0


def performance_level(score: Column) -> Column:
    bands = ladder([(score >= 80, "EXCELLENT"), (score >= 60, "GOOD"), (score >= 40, "FAIR"), (score >= 20, "POOR")], "CRITICAL")
    return F.when(score.isNotNull(), bands)


def sample_trend(samples: DataFrame, ranges: int | None = None) -> DataFrame:
    """Score of every sample and its direction against the one before."""
    rows = samples.select(
        "seq", "ts", "throughput", "cpu_usage", "memory_usage",
        performance_score(c("cpu_usage"), c("memory_usage"), c("throughput")).alias("score"),
    )
    out = running(rows, [], [c("ts"), c("seq")], [Running("previous_score", c("score"), "lag")], ranges)
    diff = c("score") - c("previous_score")
    trend = F.when(diff.isNotNull(), ladder([(F.abs(diff) < 5.0, "STABLE"), (diff > 0, "IMPROVING")], "DECLINING"))
    return out.select(
        "seq", "ts", "score", performance_level(c("score")).alias("level"), "previous_score", trend.alias("trend"),
        ((c("cpu_usage") < 80.0) & (c("memory_usage") < 85.0) & (c("throughput") > 0.0)).alias("is_healthy"),
    )


def performance_trend(
    log: DataFrame, samples: DataFrame, as_of: Column, period: timedelta = timedelta(hours=1), minutes: int = 5
) -> DataFrame:
    """Throughput and mean resource use in consecutive buckets of the period, empty ones included."""
    start = as_of - span(period)
    size = minutes * 60
    n_buckets = int(period.total_seconds()) // size
    inside = (c("ts") > start) & (c("ts") <= as_of)
    counted = log.filter(inside).groupBy(_bucket(c("ts"), start, size).alias("bucket")).agg(F.count(F.lit(1)).alias("events"))
    used = samples.filter(inside).groupBy(_bucket(c("ts"), start, size).alias("bucket")).agg(
        (F.sum("cpu_usage") / F.count("cpu_usage")).alias("cpu_usage"),
        (F.sum("memory_usage") / F.count("memory_usage")).alias("memory_usage"),
    )
    calendar = log.sparkSession.range(n_buckets).select(c("id").alias("bucket"))
    out = calendar.join(counted, "bucket", "left").join(used, "bucket", "left")
    rate = F.coalesce("events", F.lit(0)) / F.lit(float(size))
    score = performance_score(c("cpu_usage"), c("memory_usage"), c("throughput"))
    return (
        out.withColumn("throughput", rate)
        .select(
            "bucket",
            (start + F.make_dt_interval(mins=(c("bucket") * minutes).cast("int"))).alias("bucket_start"),
            F.coalesce("events", F.lit(0)).alias("events"), "throughput", "cpu_usage", "memory_usage",
            score.alias("score"), performance_level(score).alias("level"),
        )
    )


def resource_state(samples: DataFrame, memory_total_mb: float) -> DataFrame:
    """Memory in MB, health and the tightest constraint of every sample."""
    cpu, mem, disk = c("cpu_usage"), c("memory_usage"), c("disk_usage")
    used = mem / 100.0 * memory_total_mb
    constraint = ladder(
        [
            (cpu > 90.0, "CPU_CRITICAL"), (mem > 90.0, "MEMORY_CRITICAL"), (disk > 95.0, "DISK_CRITICAL"),
            (cpu > 75.0, "CPU_HIGH"), (mem > 80.0, "MEMORY_HIGH"), (disk > 85.0, "DISK_HIGH"),
        ],
        "NONE",
    )
    return samples.select(
        "seq", "ts", "cpu_usage", "memory_usage", "disk_usage",
        used.alias("memory_used_mb"), (F.lit(memory_total_mb) - used).alias("memory_available_mb"),
        ((cpu < 80.0) & (mem < 85.0) & (disk < 90.0)).alias("is_healthy"),
        constraint.alias("constraint"),
    )


def memory_percent(used: Column, total: Column) -> Column:
    """Share of memory in use, 0 when the total is unknown."""
    return percent(used, total)


def resource_counts(samples: DataFrame, memory_total_mb: float) -> DataFrame:
    return resource_state(samples, memory_total_mb).groupBy("constraint").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_healthy").alias("healthy")
    )


def performance_summary(log: DataFrame, samples: DataFrame, as_of: Column, period: timedelta = timedelta(minutes=5)) -> DataFrame:
    """Throughput, latency and resources together: one row with one verdict."""
    newest = samples.agg(F.max_by(F.struct("cpu_usage", "memory_usage", "disk_usage"), F.struct("ts", "seq")).alias("s")).select("s.*")
    r = newest.withColumn("ok", (c("cpu_usage") < 80.0) & (c("memory_usage") < 85.0) & (c("disk_usage") < 90.0))
    lat = latency(processing_metrics(log))
    out = throughput(log, as_of, period).select("events_per_second", "peak_throughput", c("is_healthy").alias("throughput_healthy"))
    out = out.withColumns(
        {
            "average_ms": lat.select("average_ms").scalar(),
            "latency_healthy": lat.select("is_healthy").scalar(),
            "cpu_usage": r.select("cpu_usage").scalar(),
            "memory_usage": r.select("memory_usage").scalar(),
            "resources_healthy": r.select("ok").scalar(),
        }
    )
    ok = c("throughput_healthy") & c("latency_healthy") & c("resources_healthy")
    return out.withColumns(
        {
            "is_healthy": ok,
            "status": F.when(ok, "all measures in bounds").otherwise("some measures out of bounds"),
        }
    )


# ----------------------------------------------------------------------- retries

# Database error codes and state classes -> action.
CODE_ACTIONS = {1040: "RETRY_WITH_BACKOFF", 1205: "RETRY", 1213: "RETRY_WITH_RANDOM_DELAY", 1062: "STOP", 1146: "ESCALATE"}
STATE_ACTIONS = {"08": "RESTART", "40": "RETRY"}
RETRY_DELAY_MS = 100


def retry_plan(errors: DataFrame) -> DataFrame:
    """What to do about each database error, and how long to wait first."""
    action = ladder(
        [(c("error_code") == k, v) for k, v in CODE_ACTIONS.items()]
        + [(c("sql_state").startswith(k), v) for k, v in STATE_ACTIONS.items()],
        "RESTART",
    )
    a = c("action")
    delay = (
        F.when(a.isin("RETRY", "RETRY_WITH_RANDOM_DELAY"), F.lit(RETRY_DELAY_MS))
        .when(a == "RETRY_WITH_BACKOFF", F.lit(RETRY_DELAY_MS) * F.pow(F.lit(2.0), c("attempt")))
        .otherwise(F.lit(0))
    )
    return errors.withColumn("action", action).withColumns(
        {"is_retryable": a.startswith("RETRY"), "delay_ms": delay.cast("bigint")}
    )


def retry_counts(errors: DataFrame) -> DataFrame:
    return retry_plan(errors).groupBy("action").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_retryable").alias("retryable"), F.sum("delay_ms").alias("total_delay_ms")
    )


# ------------------------------------------------------------------- job history


def job_family(job_id: Column) -> Column:
    return F.regexp_replace(job_id, r"_?[0-9]+$", "")


def job_health(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Stuck jobs, failures of the last hour, verdict: one row."""
    running_ = c("status") == "RUNNING"
    recent = ~running_ & (c("start_time") > as_of - span(timedelta(hours=1)))
    out = jobs.agg(
        F.count_if(running_ & (c("start_time") < as_of - span(timedelta(hours=2)))).alias("stuck_jobs"),
        F.count_if(recent).alias("recent_jobs"),
        F.count_if(recent & (c("status") == "FAILED")).alias("recent_failures"),
    ).withColumn("failure_rate", ratio(c("recent_failures"), c("recent_jobs")))
    return out.withColumn("is_healthy", (c("stuck_jobs") == 0) & (c("failure_rate") <= 0.5))


def latest_runs(jobs: DataFrame) -> DataFrame:
    """The newest finished run of every job family."""
    newest = F.max_by(F.struct("job_id", "start_time", "end_time", "status"), F.struct("start_time", "job_id"))
    return jobs.filter(c("status") != "RUNNING").groupBy(job_family(c("job_id")).alias("family")).agg(newest.alias("r")).select("family", "r.*")


def latest_run_of(jobs: DataFrame, family: str) -> DataFrame:
    """The newest finished run whose id starts with ``family``."""
    newest = F.max_by(F.struct("job_id", "start_time", "end_time", "status"), F.struct("start_time", "job_id"))
    rows = jobs.filter((c("status") != "RUNNING") & c("job_id").startswith(family))
    return rows.agg(newest.alias("r")).filter(c("r").isNotNull()).select("r.*")


def kept_jobs(jobs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return jobs.filter(c("start_time") >= as_of - span(timedelta(days=days)))
