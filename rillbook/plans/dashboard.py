"""All sections of the activity dashboard, each an independent DataFrame; nothing runs here.

The sections built on counts share ``type_counts``. At the caller's choice it is a stored partial
(see :func:`rillbook.operators.state.user_type_counts`), so that a refresh reads a few rows per user
instead of all events.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame

from rillbook.functions.clock import as_of as clock
from rillbook.operators import activity, journal, monitoring, state


def dashboard(
    events: DataFrame,
    stage_log: DataFrame,
    samples: DataFrame,
    journal_rows: DataFrame,
    type_counts: DataFrame | None = None,
    as_of=None,
    period: timedelta = timedelta(minutes=5),
    limit: int = 10,
) -> dict[str, DataFrame]:
    counts = state.user_type_counts(events) if type_counts is None else type_counts
    now, log_now = clock(events, as_of), clock(stage_log, as_of)
    return {
        "overview": state.totals(counts),
        "event_types": activity.type_breakdown(counts),
        "user_activity": activity.user_activity(journal_rows),
        "recent_events": activity.recent_activity(counts, 2 * limit),
        "hourly": activity.hourly_series(events, now),
        "top_users": activity.top_users(counts, limit),
        "performance": monitoring.performance_summary(stage_log, samples, log_now, period),
        "performance_trend": monitoring.performance_trend(stage_log, samples, log_now),
        "stage_status": monitoring.stage_funnel(stage_log, log_now, period),
        "stage_health": monitoring.stage_health(stage_log),
        "stage_flow": monitoring.stage_flow(stage_log, log_now, period),
        "recent_errors": monitoring.recent_errors(stage_log, 50),
        "journal": journal.summary_totals(journal_rows),
    }
