"""The run-history views of `views.py` as SQL over the driver tables, for the SQL twins."""

from pagetide.plans.views import AS_OF, ERRORS

_ERR = "[" + ", ".join(f"'{e}'" for e in ERRORS) + "]"

EV = "ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"

RUNS = EV + f""",
run0 AS (SELECT *, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'queued' ELSE 'success' END AS status,
  CASE WHEN k % 4 = 1 THEN k % 3 + 1 ELSE 0 END AS calls FROM ev),
runs AS (SELECT event_id AS run_id, 'task-' || event_id AS task_id, 't' || (user_id % 5) AS tenant_id,
  'https://site' || (user_id % 20) || '.example.com/p/' || user_id AS url,
  'site' || (user_id % 20) || '.example.com' AS domain,
  'b-' || strftime(ts, '%Y-%m-%d') AS batch_group_id, strftime(ts, '%Y-%m-%d') AS day,
  CASE WHEN k % 2 = 0 THEN '' ELSE 'batch-' || strftime(ts, '%Y-%m-%d') END AS parent_task_id,
  status, ts AS created_at,
  CASE WHEN status <> 'queued' THEN ts + to_seconds(CAST(k % 60 AS DOUBLE)) END AS completed_at,
  floor(value * 8) / 8 AS elapsed_ms,
  CASE WHEN status = 'success' THEN (k % 65) / 64.0::DOUBLE ELSE 0.0::DOUBLE END AS quality_score,
  CASE WHEN status = 'failed' THEN {_ERR}[k % 8 + 1] ELSE '' END AS error,
  k, user_id, value,
  CASE WHEN status = 'success' THEN CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) END AS price,
  CASE WHEN status = 'success' AND k % 3 <> 0 THEN CAST(k % 4 AS VARCHAR) END AS stock,
  CASE WHEN status = 'success' THEN 's' || (k % 2) END AS seller,
  CASE WHEN status = 'success' AND k % 4 <> 1 THEN CAST(k % 5 AS VARCHAR) END AS rating,
  CASE WHEN status = 'success' THEN CASE WHEN k % 6 = 0 THEN '' ELSE 'n' || (k % 3) END END AS note,
  ['rule', 'llm', 'fallback', 'specialized_rule'][k % 4 + 1] AS strategy,
  CASE WHEN k % 4 = 0 THEN 'lp' || (user_id % 20) ELSE '' END AS profile_id,
  CASE WHEN status = 'success' THEN CASE WHEN k % 10 IN (3, 4) THEN 'partial_success' WHEN k % 10 = 5 THEN 'validation_failed' ELSE 'success' END ELSE '' END AS vstatus,
  CASE WHEN status = 'success' AND k % 2 = 0 THEN (k % 9) / 8.0::DOUBLE END AS completeness,
  CASE WHEN status = 'queued' THEN 0 ELSE calls END AS calls,
  CASE WHEN status = 'queued' THEN 0 ELSE calls * (k + 100) END AS prompt_tokens,
  CASE WHEN status = 'queued' THEN 0 ELSE calls * (k % 7 + 20) END AS completion_tokens,
  CASE WHEN status = 'queued' THEN 0 ELSE calls * (k + 100) + calls * (k % 7 + 20) END AS total_tokens,
  CASE WHEN status = 'queued' THEN 0 ELSE (calls * (k + 100) + calls * (k % 7 + 20)) / 1048576.0::DOUBLE END AS cost,
  CASE WHEN status <> 'queued' AND k % 3 = 0 THEN floor(value * 8) / 8 * 2 ELSE 0.0::DOUBLE END AS playwright_ms,
  CASE WHEN status = 'queued' THEN 0 ELSE k % 3 END AS retries,
  CASE WHEN status = 'queued' OR k % 10 = 0 THEN '' ELSE 'tpl' || (k % 10) END AS template_id,
  CASE WHEN status = 'queued' THEN '' ELSE 'mon' || (user_id % 50) END AS monitor_id
  FROM run0)"""

# Filled and total fields of a run.  A failed run has no `data` object, so the four plain keys of
# its payload count: page_type, extraction_strategy, learned_profile_id (may be blank), strategy_details.
_FIELDS = ("price", "stock", "seller", "rating", "note")
FIELD_COUNT = "CASE WHEN status = 'failed' THEN 4 ELSE " + " + ".join(
    f"({c} IS NOT NULL)::INT" for c in _FIELDS) + " END"
FILLED_COUNT = "CASE WHEN status = 'failed' THEN 3 + (profile_id <> '')::INT ELSE " + " + ".join(
    f"(coalesce({c}, '') <> '')::INT" for c in _FIELDS) + " END"

FAILURE_CATEGORY = """CASE WHEN status <> 'failed' THEN NULL
  WHEN error LIKE '%404%' THEN 'not_found' WHEN error LIKE '%connect_timeout%' THEN 'connect_timeout'
  WHEN error LIKE '%429%' THEN 'rate_limit' WHEN error LIKE '%403%' THEN 'blocked'
  WHEN error LIKE '%captcha%' THEN 'anti_bot_or_shell' WHEN error LIKE '%schema%' THEN 'quality'
  WHEN error LIKE '%dns%' THEN 'network' ELSE 'other' END"""

COARSE_CLASS = """CASE WHEN error LIKE '%timeout%' THEN 'timeout' WHEN error LIKE '%429%' THEN 'rate_limit'
  WHEN error LIKE '%403%' THEN 'auth' WHEN error LIKE '%challenge%' THEN 'anti_bot'
  WHEN error LIKE '%schema%' THEN 'quality' WHEN error LIKE '%network%' THEN 'network' ELSE 'other' END"""

BUCKET = """CASE WHEN status = 'success' THEN CASE vstatus WHEN 'partial_success' THEN 'partial_success'
    WHEN 'validation_failed' THEN 'validation_failed' ELSE 'full_success' END
  WHEN regexp_matches(error, '404|timeout|429|403|captcha|network') THEN 'fetch_failed' ELSE 'failed' END"""

SCORE = """CASE WHEN status = 'queued' THEN -1.0 WHEN completeness IS NOT NULL THEN least(completeness, 1.0)
  ELSE ((price IS NOT NULL)::INT + (stock IS NOT NULL)::INT + (rating IS NOT NULL)::INT + (coalesce(note, '') <> '')::INT) / 4.0::DOUBLE END"""

METRICS = RUNS + f""",
metrics AS (SELECT *, {FAILURE_CATEGORY} AS failure_category, {FIELD_COUNT} AS field_count, {FILLED_COUNT} AS filled_field_count,
  created_at AS updated_at FROM runs)"""

TEMPLATES = """templates AS (SELECT 't' || (c_custkey % 5) AS tenant_id, 'tpl' || (c_custkey // 5) AS template_id,
  'Template ' || c_mktsegment AS name, lower(c_mktsegment) AS page_type, c_custkey % 3 AS use_count FROM customer)"""

FEEDBACK = """feedback AS (SELECT 't' || (doc_id % 5) AS tenant_id, 'tpl' || (doc_id % 12) AS template_id, source || '.example.com' AS site_domain,
  lang AS field_name, CASE WHEN toxic = 1 THEN 'missing' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS feedback_status
  FROM labels JOIN documents USING (doc_id))"""

REVIEWS = """reviews AS (SELECT doc_id AS review_id, 't' || (doc_id % 5) AS tenant_id, 'task-' || (doc_id // 10) AS task_id,
  'u' || (doc_id % 2) AS reviewer_user_id, quality = 1 AS confirmed, (doc_id % 9) / 8.0::DOUBLE AS accuracy_score,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(doc_id % 7 AS DOUBLE)) AS updated_at FROM labels)"""

PLANS = """plan0 AS (SELECT *, greatest(CAST(floor(s_acctbal / 10) AS BIGINT), 1) AS base FROM supplier),
plans AS (SELECT 't' || (s_suppkey * 2) AS tenant_id, 'plan-' || s_nationkey AS plan_name, base * 3 AS monthly_task_limit,
  base * 5 AS monthly_url_limit, base % 40 + 20 AS monitor_limit, base * 400 AS monthly_token_limit, base % 100 + 1 AS export_limit,
  CASE WHEN s_suppkey % 3 = 1 THEN 'allow' ELSE 'reject' END AS overage_policy FROM plan0)"""

MONITORS = """mon0 AS (SELECT *, c_custkey AS key, TIMESTAMP '2024-01-25 00:00:00' AS base_time FROM customer),
monitors AS (SELECT key, 't' || (key % 5) AS tenant_id, 'mon' || key AS monitor_id, c_name AS name,
  'https://site' || (key % 20) || '.example.com/p/' || key AS url, c_mktsegment AS scenario_label,
  CASE WHEN key % 4 = 0 THEN 'email' ELSE 'webhook' END AS channel_type, 'channel ' || (key % 3) AS channel_name,
  'https://hook' || (key % 7) || '.example.com' AS target, CASE WHEN key % 2 = 0 THEN '' ELSE 'key' || (key % 5) END AS secret,
  key % 5 <> 0 AS channel_enabled, key % 2 = 0 AS digest_enabled, key % 24 AS digest_hour,
  'lp' || (key % 20) AS last_learned_profile_id, 'task-' || (key * 3) AS last_task_id,
  CASE WHEN key % 4 <> 0 THEN base_time + to_minutes(CAST(key % 720 AS BIGINT)) END AS last_notification_at,
  key % 9 <> 0 AS schedule_enabled, CASE WHEN key % 11 = 0 THEN base_time END AS schedule_paused_at,
  base_time + to_minutes(CAST(floor(c_acctbal) AS BIGINT) % 1440) AS schedule_next_run_at,
  CASE WHEN key % 4 = 1 THEN 'worker-1' ELSE '' END AS schedule_claimed_by,
  CASE WHEN key % 4 = 1 THEN base_time + to_hours(CAST(key % 24 AS BIGINT)) END AS schedule_lease_until,
  key % 200 AS schedule_interval_minutes, base_time AS updated_at FROM mon0)"""

NOTIFICATIONS = EV + f""",
notes AS (SELECT event_id AS notification_id, 't' || (user_id % 5) AS tenant_id, 'mon' || user_id AS monitor_id,
  'task-' || (event_id // 3) AS task_id, 'https://hook' || (user_id % 7) || '.example.com' AS target,
  CASE WHEN k % 3 = 0 THEN 'daily_digest' ELSE 'monitor_alert' END AS event_type,
  ['sent', 'failed', 'retry_pending', 'skipped'][k % 4 + 1] AS status, k % 3 + 1 AS attempt_no, 3 AS max_attempts,
  CASE WHEN k % 4 = 2 THEN ts + to_minutes(CAST(k AS BIGINT)) END AS next_retry_at, ts AS created_at,
  CASE WHEN k % 2 = 0 THEN 'auto' ELSE 'manual' END AS triggered_by,
  CASE WHEN k % 4 = 1 THEN {_ERR}[k % 8 + 1] ELSE '' END AS error_message FROM ev)"""

FUNNEL = EV + """,
funnel AS (SELECT event_id, 't' || (user_id % 5) AS tenant_id, event_type AS stage,
  CASE WHEN k % 2 = 0 THEN 'template' ELSE 'actor' END AS package_type,
  CASE WHEN k % 10 = 0 THEN '' ELSE 'pkg' || (k % 25) END AS package_id, ts AS created_at FROM ev)"""

AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"


def with_(*ctes: str) -> str:
    """WITH clause; the event CTE is emitted once however many views use it."""
    text = ",\n".join(ctes)
    head, sep, tail = text.partition(EV)
    if sep:
        text = EV + ",\n" + (head + tail.replace(EV + ",\n", "").replace(EV, "")).strip(",\n ")
    return "WITH " + text.replace(",\n,", ",") + "\n"
