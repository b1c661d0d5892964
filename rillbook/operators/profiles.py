"""Enriched user profiles and lookups of user attributes."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from rillbook.functions.clock import span
from rillbook.functions.text import ladder, ratio
from rillbook.operators.quality import engagement_valid
from rillbook.operators.state import with_rates
from rillbook.schemas import DEFAULT_CONTACTABLE, ENGAGEMENT_COUNTERS

MAX_LOOKUP_KEYS = 100
CACHE_AGE = timedelta(minutes=30)


def enriched_profiles(users: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """Totals, rates, scores, tier and rules for every user of ``users`` (column ``user_id``).

    Scores (their formulas are a choice of this package, the thresholds are given):
    engagement = 100 x mean of the three rates, each capped at 1;
    activity = 100 - 100 x days/30, not below 0; frequency = 20 x events per active day, at most 100;
    overall = their mean; tiers HIGH from 80, MEDIUM from 50, LOW below, INACTIVE without events.

    Events are counted per user and day first: active days need no distinct aggregate.
    """
    counters = [F.count_if(F.col("event_type") == t).alias(c) for t, c in ENGAGEMENT_COUNTERS.items()]
    daily = events.filter(engagement_valid()).groupBy("user_id", F.to_date("ts").alias("day")).agg(
        *counters, F.max("ts").alias("last_ts")
    )
    per_user = daily.groupBy("user_id").agg(
        *[F.sum(c).alias(c) for c in ENGAGEMENT_COUNTERS.values()],
        F.max("last_ts").alias("last_activity"),
        F.count(F.lit(1)).alias("active_days"),
    )
    c = F.col
    rates = with_rates(per_user).withColumns(
        {
            "email_click_through_rate": ratio(c("email_clicks"), c("email_opens")),
            "days_since_last_activity": F.datediff(as_of.cast("date"), c("last_activity").cast("date")).cast("bigint"),
            "avg_events_per_day": ratio(c("total_events"), c("active_days")),
        }
    )
    one = F.lit(1.0)
    capped = sum((F.least(c(r), one) for r in ("sms_response_rate", "call_completion_rate")), F.least(c("email_open_rate"), one))
    scored = rates.withColumns(
        {
            "engagement_score": capped * 100.0 / 3.0,
            "activity_score": F.greatest(F.lit(0.0), F.lit(100.0) - c("days_since_last_activity") * 100.0 / 30.0),
            "frequency_score": F.least(F.lit(100.0), c("avg_events_per_day") * 20.0),
        }
    ).withColumn("overall_score", (c("engagement_score") + c("activity_score") + c("frequency_score")) / 3.0)
    joined = users.select("user_id").join(scored, "user_id", "left")

    def filled(name: str, default) -> Column:
        return F.coalesce(c(name), F.lit(default)).alias(name)

    tier = ladder(
        [(c("total_events").isNull(), "INACTIVE"), (c("overall_score") >= 80, "HIGH"), (c("overall_score") >= 50, "MEDIUM")], "LOW"
    )
    out = joined.select(
        "user_id",
        tier.alias("engagement_tier"),
        filled("total_events", 0),
        *[filled(r, 0.0) for r in ("email_open_rate", "email_click_through_rate", "sms_response_rate", "call_completion_rate")],
        filled("engagement_score", 0.0),
        # Fixed values of a user without events.
        filled("activity_score", 20.0),
        filled("frequency_score", 20.0),
        filled("overall_score", 20.0),
        filled("days_since_last_activity", 999),
        filled("active_days", 0),
        F.coalesce("last_activity", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("last_activity"),
        filled("avg_events_per_day", 0.0),
    )
    return out.withColumns(
        {
            "highly_engaged": (c("engagement_tier") == "HIGH") & (c("overall_score") >= 80.0),
            "recently_active": c("days_since_last_activity") <= 7,
            "fatigue_risk": F.when((c("avg_events_per_day") > 5) & (c("overall_score") < 40), 80.0)
            .when((c("avg_events_per_day") > 10) & (c("overall_score") < 60), 60.0)
            .when(c("days_since_last_activity") > 30, 70.0)
            .otherwise(F.greatest(F.lit(0.0), F.lit(100.0) - c("overall_score"))),
        }
    )


def stale(profiles: DataFrame, as_of: Column, max_age: timedelta) -> DataFrame:
    """Profiles computed before ``as_of - max_age`` (column ``computed_at``)."""
    return profiles.filter(F.col("computed_at") < as_of - span(max_age))


def attach_attributes(users: DataFrame, attributes: DataFrame, as_of: Column) -> DataFrame:
    """Rules over profile attributes, joined at read time.

    Both sides are one row per user. The attribute table grows with the users, so no broadcast is
    forced: the size known at run time decides.
    """
    signup = F.col("last_signup_ts") if "last_signup_ts" in attributes.columns else F.lit(None).cast("timestamp_ntz")
    a = attributes.withColumn("last_signup_ts", signup).withColumn("has_attributes", F.lit(True))
    c = F.col
    joined = users.join(a, "user_id", "left")
    recent = F.coalesce(c("last_activity") > as_of - span(timedelta(days=7)), F.lit(False))
    signed_up = F.coalesce(c("last_signup_ts") > as_of - span(timedelta(days=30)), F.lit(False))
    return joined.select(
        *users.columns,
        (c("do_not_email").isNull() | (~c("do_not_email") & (c("disqualified_count") < 3))).alias("is_mailable"),
        F.when(c("area_of_interest").isNotNull(), "Education")
        .when(F.contains(c("inquiry_vertical"), F.lit("Auto")), "Auto")
        .otherwise("General")
        .alias("segment"),
        (recent | signed_up).alias("active_in_either"),
        F.coalesce("has_attributes", F.lit(False)).alias("has_attributes"),
    )


def lookup(model: DataFrame, user_ids: list[str]) -> DataFrame:
    """Engagement rows of at most 100 requested users; unknown ones get empty defaults.

    The key list becomes a filter of the model's scan, and at most that many rows are joined.
    """
    if not 0 < len(user_ids) <= MAX_LOOKUP_KEYS:
        raise ValueError(f"between 1 and {MAX_LOOKUP_KEYS} users can be looked up at once")
    listed = F.array(*[F.lit(u) for u in dict.fromkeys(user_ids)])
    keys = model.sparkSession.range(1).select(F.explode(listed).alias("user_id"))
    found = model.filter(F.col("user_id").isin(user_ids)).withColumn("known", F.lit(True))
    joined = keys.join(found, "user_id", "left")
    counters = list(ENGAGEMENT_COUNTERS.values())
    rates = ["email_open_rate", "sms_response_rate", "call_completion_rate"]
    return joined.select(
        "user_id",
        *[F.coalesce(F.col(x), F.lit(0)).alias(x) for x in counters],
        *[F.coalesce(F.col(x), F.lit(0.0)).alias(x) for x in rates],
        "last_activity",
        F.lit(DEFAULT_CONTACTABLE).alias("contactable_status"),
        F.coalesce("known", F.lit(False)).alias("known"),
    )


def cached_copy(model: DataFrame, computed_at: Column) -> DataFrame:
    """A snapshot of the read model that knows its age."""
    return model.withColumn("computed_at", computed_at)


def fresh_copy(copy: DataFrame, as_of: Column, max_age: timedelta = CACHE_AGE) -> DataFrame:
    return copy.filter(F.col("computed_at") >= as_of - span(max_age))
