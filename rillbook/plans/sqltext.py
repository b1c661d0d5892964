"""Pieces of SQL shared by the checks, written for the checking engine."""

from rillbook.schemas import ENGAGEMENT_COUNTERS, EVENT_TYPES


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


DOMAIN = in_list(EVENT_TYPES)
ENGAGED = in_list(ENGAGEMENT_COUNTERS)
BASE_VALID = (
    "(coalesce(regexp_matches(user_id, '[^\\x00-\\x20]'), FALSE) AND event_id IS NOT NULL AND ts IS NOT NULL "
    f"AND coalesce(event_type IN {DOMAIN}, FALSE))"
)
CHANNEL = (
    "CASE WHEN event_type LIKE 'EMAIL\\_%' ESCAPE '\\' THEN 'EMAIL' WHEN event_type LIKE 'SMS\\_%' ESCAPE '\\' THEN 'SMS' "
    "WHEN event_type LIKE 'CALL\\_%' ESCAPE '\\' THEN 'CALL' WHEN event_type IS NOT NULL THEN 'OTHER' END"
)

#: Six counters and the last engagement per user.
ENGAGEMENT = f"""
engagement AS (
  SELECT user_id,
    count(*) FILTER (event_type = 'EMAIL_OPEN') AS email_opens, count(*) FILTER (event_type = 'EMAIL_CLICK') AS email_clicks,
    count(*) FILTER (event_type = 'SMS_REPLY') AS sms_replies, count(*) FILTER (event_type = 'SMS_DELIVERY') AS sms_deliveries,
    count(*) FILTER (event_type = 'CALL_COMPLETED') AS calls_completed, count(*) FILTER (event_type = 'CALL_MISSED') AS calls_missed,
    max(ts) FILTER (event_type IN {ENGAGED}) AS last_activity
  FROM comm_events WHERE {BASE_VALID} GROUP BY user_id)
"""

RATES = """
rates AS (
  SELECT *, CASE WHEN sms_deliveries > 0 THEN email_opens::DOUBLE / sms_deliveries::DOUBLE ELSE 0.0::DOUBLE END AS email_open_rate,
    CASE WHEN sms_deliveries > 0 THEN sms_replies::DOUBLE / sms_deliveries::DOUBLE ELSE 0.0::DOUBLE END AS sms_response_rate,
    CASE WHEN calls_completed + calls_missed > 0 THEN calls_completed::DOUBLE / (calls_completed + calls_missed)::DOUBLE ELSE 0.0::DOUBLE END AS call_completion_rate,
    email_opens + email_clicks AS email_count, sms_replies + sms_deliveries AS sms_count, calls_completed + calls_missed AS call_count,
    email_opens + email_clicks + sms_replies + sms_deliveries + calls_completed + calls_missed AS total_events
  FROM engagement)
"""

TYPE_COUNTS = """
type_counts AS (
  SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
  FROM comm_events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL)
"""

DISPLAY_ID = """CASE WHEN {id} IS NULL THEN 'Unknown'
    WHEN regexp_full_match(replace({id}, 'PersistentUserActor|', ''), 'user\\w+') THEN replace({id}, 'PersistentUserActor|', '')
    WHEN length(replace({id}, 'PersistentUserActor|', '')) > 20
      THEN left(replace({id}, 'PersistentUserActor|', ''), 8) || '...' || right(replace({id}, 'PersistentUserActor|', ''), 4)
    ELSE replace({id}, 'PersistentUserActor|', '') END"""

EVENT_LINE = """'User ' || {user} || ' ' || CASE {type} WHEN 'UserEventProcessed' THEN 'processed an event' WHEN 'DROP' THEN 'dropped an item'
    WHEN 'EMAIL' THEN 'sent an email' WHEN 'SMS' THEN 'sent an SMS' WHEN 'CALL' THEN 'made a call' WHEN 'PICKUP' THEN 'picked up an item'
    WHEN 'DELIVERY' THEN 'completed delivery' ELSE 'performed ' || {type} END"""
