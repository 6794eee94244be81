"""Whole-table queries over monitors, notifications, profiles, usage and growth drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetide.functions import classify, labels as LB
from pagetide.operators import changes, growth, kpi, monitors as M, notify as N, profiles as PR, usage as UG
from pagetide.operators import extract as X
from pagetide.plans import sql_views as S
from pagetide.plans import views as V
from pagetide.plans.registry import query, stamp
from pagetide.plans.run_queries import _PAIRS

_FMT = "'%Y-%m-%d %H:%M:%S'"
_DUE = f"""due AS (SELECT * FROM monitors WHERE schedule_enabled AND schedule_paused_at IS NULL AND schedule_next_run_at <= {S.AS_OF_SQL}
  AND (schedule_claimed_by = '' OR schedule_lease_until IS NULL OR schedule_lease_until <= {S.AS_OF_SQL}))"""


@query("due_monitors", S.with_(S.MONITORS, _DUE) + "SELECT monitor_id, tenant_id FROM due")
def due_monitors(spark, sf):
    return M.due_monitors(V.monitors(spark, sf), V.as_of()).select("monitor_id", "tenant_id")


_BUSY = "SELECT 1 FROM runs r WHERE r.tenant_id = due.tenant_id AND r.task_id = due.last_task_id AND r.status IN ('pending', 'queued', 'running')"


@query("startable_monitors", S.with_(S.RUNS, S.MONITORS, _DUE) + f"SELECT monitor_id, tenant_id, last_task_id FROM due WHERE NOT EXISTS ({_BUSY})")
def startable_monitors(spark, sf):
    due = M.due_monitors(V.monitors(spark, sf), V.as_of())
    return M.startable_monitors(due, V.runs(spark, sf)).select("monitor_id", "tenant_id", "last_task_id")


@query("busy_monitors", S.with_(S.RUNS, S.MONITORS, _DUE) + f"SELECT count(*) AS skipped FROM due WHERE EXISTS ({_BUSY})")
def busy_monitors(spark, sf):
    due = M.due_monitors(V.monitors(spark, sf), V.as_of())
    return M.busy_monitors(due, V.runs(spark, sf)).agg(F.count("*").alias("skipped"))


@query("first_due_monitors", S.with_(S.MONITORS, _DUE) + f"SELECT monitor_id, strftime(schedule_next_run_at, {_FMT}) AS next_run FROM due ORDER BY schedule_next_run_at, updated_at, monitor_id LIMIT 20")
def first_due_monitors(spark, sf):
    due = M.due_monitors(V.monitors(spark, sf), V.as_of())
    return M.first_due(due, 20).select("monitor_id", stamp("schedule_next_run_at").alias("next_run"))


@query("monitor_schedules", S.with_(S.MONITORS) + f"""SELECT monitor_id, strftime(schedule_next_run_at + to_minutes(CAST(least(greatest(CASE WHEN schedule_interval_minutes = 0 THEN 60 ELSE schedule_interval_minutes END, 5), 10080) AS BIGINT)), {_FMT}) AS following_run,
  CASE WHEN NOT schedule_enabled THEN 'disabled' WHEN schedule_paused_at IS NOT NULL THEN 'paused' ELSE 'active' END AS schedule_status,
  CASE WHEN schedule_claimed_by = '' THEN 'idle' WHEN schedule_lease_until <= {S.AS_OF_SQL} THEN 'expired' ELSE 'claimed' END AS claim_status FROM monitors""")
def monitor_schedules(spark, sf):
    return V.monitors(spark, sf).select(
        "monitor_id", stamp(M.next_run_at(F.col("schedule_next_run_at"), F.col("schedule_interval_minutes"))).alias("following_run"),
        M.schedule_status(F.col("schedule_enabled"), F.col("schedule_paused_at")).alias("schedule_status"),
        M.claim_status(F.col("schedule_claimed_by"), F.col("schedule_lease_until"), V.as_of()).alias("claim_status"),
    )


@query("quiet_hours", """SELECT c_custkey AS key, CASE WHEN s = e THEN true WHEN s < e THEN h >= s AND h < e ELSE h >= s OR h < e END AS quiet
FROM (SELECT c_custkey, c_custkey % 24 AS s, (c_custkey * 7) % 24 AS e, (c_custkey // 24) % 24 AS h FROM customer)""")
def quiet_hours(spark, sf):
    key = F.col("c_custkey")
    return V.table(spark, sf, "customer").select(
        key.alias("key"), M.in_quiet_hours(F.floor(key / 24) % 24, key % 24, (key * 7) % 24).alias("quiet")
    )


@query("monitor_channels", S.with_(S.MONITORS) + "SELECT tenant_id, monitor_id, 'webhook' AS channel_type, target, channel_name AS name, secret, channel_enabled AS enabled FROM monitors")
def monitor_channels(spark, sf):
    return M.normalize_channels(V.monitors(spark, sf)).select(
        "tenant_id", "monitor_id", "channel_type", "target", "name", "secret", "enabled"
    )


# Alert rows: every successful or failed run, seen as a check of the monitor of its URL.
_ALERTS = _PAIRS + """,
cc AS (SELECT run_id, count(*) AS n, count(*) FILTER (change_type = 'removed') AS removed, count(*) FILTER (field IN ('price', 'stock', 'seller')) AS focused FROM diffs GROUP BY 1),
alerts AS (SELECT r.run_id, r.tenant_id, m.monitor_id, m.key, CASE WHEN r.status = 'failed' THEN 'error' WHEN coalesce(n, 0) > 0 THEN 'changed' ELSE 'stable' END AS alert_level,
  coalesce(n, 0) AS n, coalesce(removed, 0) AS removed, coalesce(focused, 0) AS focused, m.channel_enabled, m.last_notification_at
  FROM runs r JOIN monitors m ON m.tenant_id = r.tenant_id AND m.url = r.url LEFT JOIN cc USING (run_id) WHERE r.status <> 'queued')"""
_ALERTS_SQL = S.with_(S.RUNS, S.MONITORS).rstrip() + _ALERTS


def _alerts(spark, sf):
    runs = V.typed(spark, sf)
    compared = changes.compare_with_previous(runs).select(
        "run_id", F.coalesce("changes", F.array()).alias("changed_fields")
    )
    checks = runs.where(F.col("status").isin("success", "failed")).select("tenant_id", "url", "run_id", "task_id", "status")
    rows = checks.join(compared, "run_id", "left").withColumn(
        "alert_level",
        F.when(F.col("status") == "failed", "error").when(F.size("changed_fields") > 0, "changed").otherwise("stable"),
    ).withColumn("changed_fields", F.coalesce("changed_fields", F.array()))
    monitors = V.monitors(spark, sf).select(
        "tenant_id", "url", "monitor_id", "name", "selected_fields", "profile", "last_notification_at"
    )
    return rows.join(monitors, ["tenant_id", "url"])


@query("alert_severity", _ALERTS_SQL + """
SELECT run_id, monitor_id, alert_level, CASE WHEN alert_level = 'error' THEN 0 ELSE focused END AS focus_count, CASE alert_level WHEN 'error' THEN 'critical' WHEN 'stable' THEN 'low' ELSE
  CASE WHEN removed > 0 OR focused >= 2 OR n >= 4 THEN 'high' WHEN focused > 0 OR n >= 2 THEN 'medium' ELSE 'low' END END AS severity FROM alerts""")
def alert_severity(spark, sf):
    return M.with_severity(_alerts(spark, sf)).select(
        "run_id", "monitor_id", "alert_level", F.size("focus_matches").alias("focus_count"), "severity"
    )


@query("notification_decisions", _ALERTS_SQL + f"""
, d AS (SELECT run_id, monitor_id, alert_level, key, n, channel_enabled, last_notification_at, key % 24 AS qs, (key * 7) % 24 AS qe, 12 AS h, key % 4 * 30 AS cool, key % 3 AS min_n, (key % 5) / 8.0::DOUBLE AS min_r FROM alerts),
e AS (SELECT *, CASE WHEN NOT channel_enabled THEN 'no' WHEN alert_level = 'error' AND key % 2 = 1 THEN ''
  WHEN NOT (CASE key % 3 WHEN 0 THEN alert_level IN ('changed', 'error') WHEN 1 THEN alert_level = 'changed' ELSE false END) THEN 'no'
  WHEN key % 8 = 0 AND alert_level <> 'error' THEN 'no'
  WHEN key % 6 = 0 AND (CASE WHEN qs = qe THEN true WHEN qs < qe THEN h >= qs AND h < qe ELSE h >= qs OR h < qe END) THEN 'no'
  WHEN cool > 0 AND last_notification_at IS NOT NULL AND alert_level <> 'error' AND {S.AS_OF_SQL} < last_notification_at + to_minutes(CAST(cool AS BIGINT)) THEN 'no'
  WHEN alert_level = 'changed' AND min_n > 0 AND n < min_n THEN 'no' WHEN alert_level = 'changed' AND min_r > 0 AND n / 3.0::DOUBLE < min_r THEN 'no' ELSE '' END AS deny FROM d)
SELECT run_id, monitor_id, deny = '' AS send FROM e""")
def notification_decisions(spark, sf):
    return M.decide_notifications(_alerts(spark, sf), V.as_of()).select("run_id", "monitor_id", "send")


@query("alert_texts", _ALERTS_SQL + """
SELECT run_id, monitor_id, CASE WHEN alert_level = 'error' THEN c_mktsegment || ' 本次巡检失败，暂时无法产出更新结论。'
  WHEN alert_level = 'stable' THEN c_mktsegment || ' 本次未发现 ' || CASE key % 3 WHEN 0 THEN 'price,stock' WHEN 1 THEN '价格' ELSE '关键字段' END || ' 的明显变化，可继续自动巡检。' ELSE '' END AS quiet_summary,
  'monitor_alert' AS event FROM alerts JOIN customer ON c_custkey = key WHERE alert_level <> 'changed'""")
def alert_texts(spark, sf):
    return _alert_texts(M.with_business_text(M.with_severity(_alerts(spark, sf))).where(F.col("alert_level") != "changed"))


@query("all_alert_texts")
def all_alert_texts(spark, sf):
    """As alert_texts, with the alerts of changed pages."""
    return _alert_texts(M.with_business_text(M.with_severity(_alerts(spark, sf))))


def _alert_texts(rows):
    return M.alert_payloads(rows, keep=["run_id", "business_summary"]).select(
        "run_id", "monitor_id", F.col("business_summary").alias("quiet_summary"), F.get_json_object("payload", "$.event").alias("event")
    )


# ---------------------------------------------------------------- notifications


@query("filtered_notifications", S.with_(S.NOTIFICATIONS) + "SELECT notification_id, target FROM notes WHERE monitor_id = 'mon7' AND status = 'failed' AND event_type = 'monitor_alert' AND tenant_id = 't2' AND created_at >= TIMESTAMP '2024-01-10 00:00:00'")
def filtered_notifications(spark, sf):
    after = F.lit("2024-01-10 00:00:00").cast("timestamp")
    return N.filter_events(
        V.notification_events(spark, sf), monitor_id="mon7", status="failed", event_type="monitor_alert", tenant_id="t2", created_after=after
    ).select("notification_id", "target")


@query("latest_notifications", S.with_(S.NOTIFICATIONS) + "SELECT notification_id, status FROM notes ORDER BY created_at DESC, notification_id DESC LIMIT 100")
def latest_notifications(spark, sf):
    return N.latest_events(V.notification_events(spark, sf), 100).select("notification_id", "status")


@query("due_retries", S.with_(S.NOTIFICATIONS) + f"SELECT notification_id, strftime(next_retry_at, {_FMT}) AS next_retry_at FROM notes WHERE status = 'retry_pending' AND next_retry_at <= {S.AS_OF_SQL}")
def due_retries(spark, sf):
    return N.due_retries(V.notification_events(spark, sf), V.as_of()).select("notification_id", stamp("next_retry_at").alias("next_retry_at"))


@query("first_due_retries", S.with_(S.NOTIFICATIONS) + f"SELECT notification_id FROM notes WHERE status = 'retry_pending' AND next_retry_at <= {S.AS_OF_SQL} ORDER BY next_retry_at, created_at, notification_id LIMIT 10")
def first_due_retries(spark, sf):
    return N.first_due_retries(N.due_retries(V.notification_events(spark, sf), V.as_of()), 10).select("notification_id")


@query("retry_times", S.with_(S.NOTIFICATIONS) + f"SELECT notification_id, CASE WHEN attempt_no < 3 THEN strftime(created_at + to_minutes(CAST([1, 5, 30][attempt_no] AS BIGINT)), {_FMT}) END AS retry_at FROM notes")
def retry_times(spark, sf):
    return V.notification_events(spark, sf).select(
        "notification_id", stamp(N.next_retry_at(F.col("attempt_no"), F.col("max_attempts"), F.col("created_at"))).alias("retry_at")
    )


@query("retry_chain", S.with_(S.NOTIFICATIONS) + """SELECT notification_id, row_number() OVER w AS chain_no, lag(notification_id) OVER w AS retry_of FROM notes
WINDOW w AS (PARTITION BY tenant_id, task_id, target ORDER BY notification_id)""")
def retry_chain(spark, sf):
    return N.retry_chain(V.notification_events(spark, sf)).select("notification_id", "chain_no", "retry_of")


_WINDOW = f"w AS (SELECT * FROM notes WHERE created_at >= {S.AS_OF_SQL} - INTERVAL 24 HOUR AND created_at <= {S.AS_OF_SQL})"


@query("digest_summary", S.with_(S.NOTIFICATIONS, _WINDOW) + """SELECT tenant_id, count(*) AS total_notifications, count(*) FILTER (event_type = 'monitor_alert') AS monitor_alert_notifications,
  count(*) FILTER (event_type = 'daily_digest') AS digest_notifications, count(DISTINCT monitor_id) FILTER (event_type = 'monitor_alert') AS unique_monitors, count(*) FILTER (status = 'sent') AS sent_count,
  count(*) FILTER (status = 'failed') AS failed_count, count(*) FILTER (status = 'retry_pending') AS retry_pending_count, count(*) FILTER (triggered_by = 'manual') AS manual_resend_count, CAST(0 AS BIGINT) AS auto_retry_count FROM w GROUP BY 1""")
def digest_summary(spark, sf):
    return N.digest_summary(V.notification_events(spark, sf), V.as_of())


_DIGEST_ROWS = f"""dm AS (SELECT w.tenant_id, w.monitor_id, any_value(m.name) AS name, any_value(m.url) AS url, count(*) AS notification_count, count(*) FILTER (status = 'failed') AS failed_count,
  count(*) FILTER (status = 'retry_pending') AS retry_pending_count, arg_max(status, notification_id) AS latest_notification_status, strftime(max(created_at), {_FMT}) AS latest_notification_at
  FROM w JOIN monitors m ON m.tenant_id = w.tenant_id AND m.monitor_id = w.monitor_id WHERE event_type = 'monitor_alert' GROUP BY 1, 2)"""


@query("digest_monitors", S.with_(S.NOTIFICATIONS, _WINDOW, S.MONITORS, _DIGEST_ROWS) + "SELECT * FROM dm")
def digest_monitors(spark, sf):
    return N.digest_monitors(V.notification_events(spark, sf), V.monitors(spark, sf), V.as_of()).withColumn(
        "latest_notification_at", stamp("latest_notification_at")
    )


@query("top_digest_monitors", S.with_(S.NOTIFICATIONS, _WINDOW, S.MONITORS, _DIGEST_ROWS) + "SELECT monitor_id, failed_count, notification_count FROM dm ORDER BY failed_count DESC, retry_pending_count DESC, notification_count DESC, name, monitor_id LIMIT 8")
def top_digest_monitors(spark, sf):
    rows = N.digest_monitors(V.notification_events(spark, sf), V.monitors(spark, sf), V.as_of())
    return N.top_digest_monitors(rows).select("monitor_id", "failed_count", "notification_count")


@query("recent_failures", S.with_(S.NOTIFICATIONS, _WINDOW) + "SELECT notification_id, status FROM w WHERE status IN ('failed', 'retry_pending') ORDER BY created_at DESC, notification_id DESC LIMIT 8")
def recent_failures(spark, sf):
    return N.recent_failures(V.notification_events(spark, sf), V.as_of()).select("notification_id", "status")


_MEMBERS = "mem AS (SELECT tenant_id, monitor_id, key, 'webhook' AS channel_type, target, secret, channel_name AS name, digest_enabled, digest_hour FROM monitors WHERE channel_enabled)"
_TARGETS = """tg AS (SELECT tenant_id, channel_type, target, coalesce(arg_min(secret, monitor_id) FILTER (secret <> ''), '') AS secret, arg_min(name, monitor_id) AS name, count(DISTINCT monitor_id) AS monitors,
  bool_or(digest_enabled) AS digest_enabled, coalesce(min(digest_hour) FILTER (digest_enabled), min(digest_hour)) AS digest_hour FROM mem GROUP BY 1, 2, 3)"""


@query("digest_members", S.with_(S.MONITORS, _MEMBERS) + "SELECT tenant_id, monitor_id, target, digest_hour FROM mem WHERE digest_enabled AND digest_hour = 12")
def digest_members(spark, sf):
    return N.digest_members(V.monitors(spark, sf), enabled_only=True, due_hour=12).select("tenant_id", "monitor_id", "target", "digest_hour")


@query("digest_targets", S.with_(S.MONITORS, _MEMBERS, _TARGETS) + "SELECT tenant_id, channel_type, target, secret, name, monitors, digest_enabled, CAST(digest_hour AS BIGINT) AS digest_hour FROM tg")
def digest_targets(spark, sf):
    return N.digest_targets(N.digest_members(V.monitors(spark, sf)))


@query("unsent_targets", S.with_(S.NOTIFICATIONS, S.MONITORS, _MEMBERS, _TARGETS) + """SELECT tenant_id, target FROM tg WHERE NOT EXISTS (SELECT 1 FROM notes n WHERE n.tenant_id = tg.tenant_id AND n.target = tg.target
  AND event_type = 'daily_digest' AND created_at >= TIMESTAMP '2024-01-30 00:00:00')""")
def unsent_targets(spark, sf):
    events = V.notification_events(spark, sf)
    as_of = F.lit("2024-01-30 23:30:00").cast("timestamp")
    return N.unsent_targets(N.digest_targets(N.digest_members(V.monitors(spark, sf))), events, as_of).select("tenant_id", "target")


@query("delivery_outcomes", S.with_(S.NOTIFICATIONS) + """SELECT tenant_id, task_id, count(*) AS channels, count(*) FILTER (status = 'sent') AS sent, CASE WHEN count(*) FILTER (status = 'retry_pending') > 0 THEN 'retry_pending'
  WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (status = 'sent') > 0 THEN 'sent' ELSE 'skipped' END AS status FROM notes GROUP BY 1, 2""")
def delivery_outcomes(spark, sf):
    return N.delivery_outcomes(V.notification_events(spark, sf), "tenant_id", "task_id").select("tenant_id", "task_id", "channels", "sent", "status")


# ---------------------------------------------------------------- usage


_PRICES = "CASE c.conv_id % 4 WHEN 0 THEN (p * 0.15::DOUBLE + o * 0.6::DOUBLE) / 1000000 WHEN 1 THEN (p * 2.0::DOUBLE + o * 8.0::DOUBLE) / 1000000 ELSE 0 END"


@query("model_usage", f"""WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' OR trim(text) = '' THEN 0 ELSE greatest(length(text) // 4, 1) END AS p, CASE WHEN role <> 'assistant' OR trim(text) = '' THEN 0 ELSE greatest(length(text) // 4, 1) END AS o, length(text) % 64 / 8.0::DOUBLE AS ms FROM conversations)
SELECT ['gpt-4o-mini', 'gpt-4.1', 'deepseek-chat', 'other-model'][conv_id % 4 + 1] AS model, count(*) AS total_calls, sum(ms) AS total_time_ms, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(o) AS BIGINT) AS completion_tokens, CAST(sum(p + o) AS BIGINT) AS total_tokens,
  round(sum({_PRICES}), 6) AS estimated_cost_usd, count(*) FILTER (turn % 2 = 0) AS api_usage_calls, CAST(0 AS BIGINT) AS auth_error_calls, count(*) FILTER (turn % 2 <> 0) AS estimated_usage_calls,
  round(sum(ms) / count(*), 2) AS avg_time_ms, round(count(*) FILTER (turn % 2 = 0) / count(*)::DOUBLE, 4) AS api_usage_ratio FROM c GROUP BY 1""")
def model_usage(spark, sf):
    from pagetide.functions.text import token_estimate

    calls = V.model_calls(spark, sf).select(
        "model", "source", "elapsed_ms", token_estimate(F.col("prompt_text")).alias("prompt_tokens"),
        token_estimate(F.col("completion_text")).alias("completion_tokens"),
    )
    return UG.usage_totals(calls, "model")


# ---------------------------------------------------------------- profiles

_PROFILES = """pf AS (SELECT p_partkey AS key, 'lp-' || printf('%08d', p_partkey) AS profile_id, 'site' || (p_partkey % 40) || '.example.com' AS domain, ['/p', '/p/' || (p_partkey % 150), '/'][p_partkey % 3 + 1] AS path_prefix,
  [['price', 'stock'], ['name', 'price', 'brand'], ['title', 'content'], ['stock', 'seller', 'rating', 'note']][(p_partkey // 7) % 4 + 1] AS fields, p_partkey % 6 AS llm_success_count, p_partkey % 11 AS rule_success_count,
  p_partkey % 4 AS rule_failure_count, (p_partkey % 9) / 8.0::DOUBLE AS last_completeness, p_partkey % 10 <> 0 AS is_active, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(p_partkey % 1000 AS BIGINT)) AS updated_at FROM part)"""
_RISK = "CASE WHEN NOT is_active THEN 'paused' WHEN rule_failure_count >= greatest(2, rule_success_count + 1) OR last_completeness < 0.35 THEN 'high' WHEN rule_failure_count > 0 OR last_completeness < 0.6 THEN 'medium' ELSE 'low' END"


@query("matched_profiles", "WITH " + _PROFILES + """,
u AS (SELECT c_custkey AS key, 'site' || (c_custkey % 40) || '.example.com' AS host, '/p/' || (c_custkey % 150) AS prefix, [['price', 'stock'], ['name', 'price'], ['content', 'missing', 'other']][c_custkey % 3 + 1] AS wanted FROM customer),
s AS (SELECT u.key, profile_id, len(list_intersect(wanted, fields)) / len(wanted)::DOUBLE AS overlap, CASE WHEN path_prefix = prefix THEN 1.0 ELSE 0.4 END AS bonus FROM u JOIN pf ON pf.domain = u.host AND pf.is_active),
b AS (SELECT key, profile_id, overlap * 2 + bonus AS score, row_number() OVER (PARTITION BY key ORDER BY overlap * 2 + bonus DESC, profile_id) AS rn FROM s WHERE overlap >= 0.5)
SELECT u.key, b.profile_id, round(CAST(b.score AS DOUBLE), 4) AS match_score FROM u LEFT JOIN b ON b.key = u.key AND b.rn = 1""")
def matched_profiles(spark, sf):
    key = F.col("c_custkey")
    wanted = F.array(
        F.array(F.lit("price"), F.lit("stock")), F.array(F.lit("name"), F.lit("price")), F.array(F.lit("content"), F.lit("missing"), F.lit("other"))
    )
    urls = V.table(spark, sf, "customer").select(
        key.alias("key"), F.concat(F.lit("https://Site"), key % 40, F.lit(".example.com:8080/p/"), key % 150, F.lit("/x")).alias("url"),
        F.element_at(wanted, (key % 3 + 1).cast("int")).alias("selected_fields"),
    )
    return PR.match_profiles(urls, V.profiles(spark, sf)).select("key", "profile_id", F.round("match_score", 4).alias("match_score"))


@query("profile_risk", S.with_(_PROFILES) + f"""SELECT profile_id, {_RISK} AS risk_level, round(rule_success_count / greatest(rule_success_count + rule_failure_count, 1)::DOUBLE, 4) AS stability_rate,
  CASE WHEN NOT is_active THEN 'paused' WHEN rule_success_count >= 8 AND rule_success_count / greatest(rule_success_count + rule_failure_count, 1)::DOUBLE >= 0.8 THEN 'strong'
   WHEN rule_success_count >= 3 AND rule_success_count / greatest(rule_success_count + rule_failure_count, 1)::DOUBLE >= 0.6 THEN 'warming' ELSE 'learning' END AS memory_strength,
  CASE {_RISK} WHEN 'paused' THEN 1 WHEN 'high' THEN 2 + CASE WHEN len(fields) >= 4 THEN 1 ELSE 0 END ELSE greatest((rule_failure_count > 0)::INT + (last_completeness < 0.6)::INT + (rule_success_count = 0)::INT, 1) END AS action_count FROM pf""")
def profile_risk(spark, sf):
    return V.profiles(spark, sf).withColumn("risk_level", PR.risk_level()).select(
        "profile_id", "risk_level", PR.stability_rate().alias("stability_rate"), PR.memory_strength().alias("memory_strength"),
        F.size(PR.risk_actions()).alias("action_count"),
    )


@query("risky_profiles", S.with_(_PROFILES) + f"SELECT profile_id FROM pf WHERE is_active AND {_RISK} = 'high'")
def risky_profiles(spark, sf):
    return PR.risky_active(V.profiles(spark, sf)).select("profile_id")


@query("profile_stats", S.with_(_PROFILES) + """SELECT count(*) AS total_profiles, count(*) FILTER (is_active) AS active_profiles, count(*) FILTER (NOT is_active) AS disabled_profiles,
  count(*) FILTER (rule_success_count > 0) AS rule_success_profiles, count(*) FILTER (llm_success_count > 0) AS llm_learned_profiles FROM pf""")
def profile_stats(spark, sf):
    return PR.profile_stats(V.profiles(spark, sf))


@query("ranked_profiles", S.with_(_PROFILES) + "SELECT profile_id FROM pf ORDER BY is_active DESC, rule_success_count DESC, llm_success_count DESC, updated_at, profile_id LIMIT 20")
def ranked_profiles(spark, sf):
    return PR.ranked_profiles(V.profiles(spark, sf)).select("profile_id")


_ATTEMPTS = S.EV + """,
att AS (SELECT event_id AS attempt_id, 'lp' || (user_id % 20) AS profile_id, ['rule', 'llm', 'fallback'][k % 3 + 1] AS strategy, event_type <> 'error' AS success, (k % 9) / 8.0::DOUBLE AS completeness, 'https://h/' || user_id AS url, ts FROM ev)"""


@query("profile_counters", "WITH " + _ATTEMPTS + f""" SELECT profile_id, count(*) FILTER (strategy = 'llm' AND success) AS llm_success_count, count(*) FILTER (strategy = 'rule' AND success) AS rule_success_count,
  count(*) FILTER (strategy = 'rule' AND NOT success) AS rule_failure_count, arg_max(CASE WHEN strategy = 'rule' AND NOT success THEN 'rule_fallback' ELSE strategy END, (ts, attempt_id)) AS last_strategy,
  arg_max(completeness, (ts, attempt_id)) AS last_completeness, arg_max(url, (ts, attempt_id)) AS last_matched_url, strftime(max(ts), {_FMT}) AS last_used_at FROM att GROUP BY 1""")
def profile_counters(spark, sf):
    return PR.profile_counters(V.profile_attempts(spark, sf)).withColumn("last_used_at", stamp("last_used_at"))


@query("profile_monitor_hits", S.with_(S.MONITORS) + "SELECT profile_id, coalesce(monitor_hits, 0) AS monitor_hits FROM (SELECT DISTINCT 'lp' || (p_partkey % 25) AS profile_id FROM part) LEFT JOIN (SELECT last_learned_profile_id AS profile_id, count(*) AS monitor_hits FROM monitors GROUP BY 1) USING (profile_id)")
def profile_monitor_hits(spark, sf):
    profiles = V.table(spark, sf, "part").select(F.concat(F.lit("lp"), F.col("p_partkey") % 25).alias("profile_id")).distinct()
    return PR.with_monitor_hits(profiles, V.monitors(spark, sf))


@query("profile_activity", S.with_(S.RUNS, S.MONITORS).rstrip() + _PAIRS + """,
ch AS (SELECT DISTINCT run_id FROM diffs)
SELECT r.tenant_id, r.profile_id, count(*) AS task_hits, count(*) FILTER (strategy = 'rule') AS rule_hits, CAST(0 AS BIGINT) AS llm_hits, CAST(0 AS BIGINT) AS fallback_hits, count(ch.run_id) AS changed_hits,
  (SELECT count(*) FROM monitors m WHERE m.tenant_id = r.tenant_id AND m.last_learned_profile_id = r.profile_id) AS monitor_links
FROM runs r LEFT JOIN ch USING (run_id) WHERE r.profile_id <> '' AND r.status <> 'queued' AND r.parent_task_id = '' GROUP BY 1, 2""")
def profile_activity(spark, sf):
    runs = V.typed(spark, sf)
    return PR.profile_activity(runs, changes.compare_with_previous(runs), V.monitors(spark, sf))


@query("learned_profiles", S.with_(S.RUNS, """g AS (SELECT *, CASE WHEN profile_id <> '' THEN 'rule' ELSE strategy END AS st, 'site' || (user_id % 20) || '.example.com' AS host, '/p/' || user_id AS prefix,
  ((price IS NOT NULL)::INT + (stock IS NOT NULL)::INT + (rating IS NOT NULL)::INT + (coalesce(note, '') <> '')::INT) AS filled FROM runs WHERE status = 'success')""") + """
SELECT host AS domain, prefix AS path_prefix, count(*) FILTER (strategy = 'llm') AS llm_success_count, count(*) FILTER (strategy = 'rule') AS rule_success_count, arg_max(filled, run_id) / 4.0::DOUBLE AS last_completeness
FROM g WHERE strategy <> 'fallback' AND filled >= 2 AND filled / 4.0 >= 0.6 GROUP BY 1, 2""")
def learned_profiles(spark, sf):
    none_yet = V.profiles(spark, sf).where(F.col("domain") == "no-such-host")
    return _learned(spark, sf, none_yet).select("domain", "path_prefix", "llm_success_count", "rule_success_count", "last_completeness")


@query("merged_profiles")
def merged_profiles(spark, sf):
    """What the runs teach, merged into the profiles that exist."""
    return _learned(spark, sf, V.profiles(spark, sf)).select("domain", "path_prefix", "llm_success_count", "rule_success_count", "last_completeness")


def _learned(spark, sf, existing):
    results = V.typed(spark, sf).where(F.col("status") == "success").select(
        F.col("run_id").alias("result_id"), "url", F.col("doc.page_type").alias("page_type"), F.col("doc.selected_fields").alias("selected_fields"),
        F.col("entries").alias("data"), F.col("doc.extraction_strategy").alias("strategy"), F.col("created_at").alias("finished_at"),
    )
    return PR.learn_profiles(results, existing)


_ANNOTATIONS = """an AS (SELECT l.doc_id AS annotation_id, r.tenant_id, r.task_id, r.url, r.domain, r.profile_id, r.price, r.stock, r.status, l.doc_id AS key,
  CASE WHEN quality = 1 THEN 'correct' WHEN toxic = 1 THEN 'missing' ELSE 'incorrect' END AS fs FROM labels l JOIN runs r ON r.run_id = l.doc_id * 3)"""


@query("feedback_rows", S.with_(S.RUNS, _ANNOTATIONS) + """SELECT annotation_id, tenant_id, domain AS site_domain, 'price' AS field_name, fs AS feedback_status, price AS original_value, CASE WHEN key % 2 = 0 THEN CAST(key AS VARCHAR) END AS corrected_value FROM an
UNION ALL SELECT annotation_id, tenant_id, domain, 'stock', 'correct', stock, NULL FROM an""")
def feedback_rows(spark, sf):
    return PR.explode_feedback(V.annotations(spark, sf), V.typed(spark, sf)).select(
        "annotation_id", "tenant_id", "site_domain", "field_name", "feedback_status", "original_value", "corrected_value"
    )


@query("repair_suggestions", S.with_(S.RUNS, _ANNOTATIONS) + """SELECT annotation_id, CASE WHEN key % 2 = 0 THEN 'price' WHEN status = 'queued' THEN '' ELSE 'price,stock,rating,note' END AS suggested_fields,
  CASE WHEN key % 2 = 0 THEN '价格' WHEN status = 'queued' THEN '' ELSE '价格,stock,rating,note' END AS suggested_labels, CASE WHEN key % 3 = 0 THEN 'applied' ELSE 'suggested' END AS status FROM an""")
def repair_suggestions(spark, sf):
    return PR.repair_suggestions(V.annotations(spark, sf), V.typed(spark, sf)).select(
        "annotation_id", F.array_join("suggested_fields", ",").alias("suggested_fields"), F.array_join("suggested_labels", ",").alias("suggested_labels"), "status"
    )


@query("repaired_profiles", S.with_(S.RUNS, _ANNOTATIONS, """lp AS (SELECT DISTINCT 'lp' || (p_partkey % 20) AS profile_id FROM part),
q AS (SELECT profile_id, count(*) AS annotations, count(*) FILTER (key % 3 = 0) AS repairs FROM an WHERE profile_id <> '' AND status <> 'queued' GROUP BY 1)""") + """
SELECT profile_id, coalesce(annotations, 0) AS manual_annotation_count, coalesce(repairs, 0) AS auto_repair_count, CASE WHEN coalesce(repairs, 0) > 0 THEN 0 ELSE 5 END AS rule_failure_count,
  CASE WHEN coalesce(repairs, 0) > 0 THEN 0.8::DOUBLE ELSE 0.25::DOUBLE END AS last_completeness, coalesce(repairs, 0) > 0 AS is_active FROM lp LEFT JOIN q USING (profile_id)""")
def repaired_profiles(spark, sf):
    profiles = V.table(spark, sf, "part").select(F.concat(F.lit("lp"), F.col("p_partkey") % 20).alias("profile_id")).distinct().select(
        "profile_id", F.array(F.lit("x")).alias("selected_fields"), F.lit("/").alias("path_prefix"), F.lit(5).alias("rule_failure_count"),
        F.lit(0.25).alias("last_completeness"), F.lit(False).alias("is_active"),
    )
    suggestions = PR.repair_suggestions(V.annotations(spark, sf), V.typed(spark, sf))
    return PR.apply_repairs(profiles, suggestions).select(
        "profile_id", "manual_annotation_count", "auto_repair_count", "rule_failure_count", "last_completeness", "is_active"
    )


# ---------------------------------------------------------------- growth and detail


@query("growth_drafts", S.with_(S.RUNS, S.MONITORS, S.TEMPLATES).rstrip() + _PAIRS + """,
cc AS (SELECT run_id, count(*) AS n FROM diffs GROUP BY 1), h AS (SELECT tenant_id, url, count(*) AS total_runs FROM runs GROUP BY 1, 2),
tc AS (SELECT 't' || (c_custkey % 5) AS tenant_id, 'https://site' || (c_custkey % 20) || '.example.com/p/' || c_custkey AS url, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT p.run_id, 'product' AS scene, h.total_runs, p.prev_id IS NOT NULL AS has_previous, coalesce(cc.n, 0) AS changed_count, coalesce(tc.n, 0) AS existing_template_count, coalesce(tc.n, 0) AS existing_monitor_count
FROM prev p JOIN h ON h.tenant_id = p.tenant_id AND h.url = p.url LEFT JOIN cc ON cc.run_id = p.run_id LEFT JOIN tc ON tc.tenant_id = p.tenant_id AND tc.url = p.url WHERE p.status = 'success' AND p.vstatus <> 'partial_success'""")
def growth_drafts(spark, sf):
    runs = V.typed(spark, sf)
    return growth.growth_drafts(
        changes.compare_with_previous(runs, keep=growth.DRAFT_COLUMNS), runs, V.templates(spark, sf), V.monitors(spark, sf)
    ).select("run_id", "scene", "total_runs", "has_previous", "changed_count", "existing_template_count", "existing_monitor_count")


@query("scene_scores", S.with_(S.RUNS) + """SELECT run_id, 'product' AS scene, CASE WHEN status = 'queued' THEN 3 ELSE 5 + 3 + 2 + 1 + 1 + CASE WHEN status = 'success' THEN 1 + (stock IS NOT NULL)::INT ELSE 0 END END AS scene_score FROM runs""")
def scene_scores(spark, sf):
    return growth.best_scene(V.typed(spark, sf).withColumn("changed", F.lit(False))).select("run_id", "scene", "scene_score")


@query("run_details", S.with_(S.RUNS).rstrip() + _PAIRS + f""",
cc AS (SELECT run_id, count(*) AS n FROM diffs GROUP BY 1), h AS (SELECT tenant_id, url, count(*) AS total_runs, count(*) FILTER (status = 'success') AS success_runs FROM runs GROUP BY 1, 2)
SELECT p.run_id, p.domain, {S.BUCKET} AS bucket, h.total_runs, h.success_runs, CASE WHEN p.status = 'success' THEN coalesce(cc.n, 0) END AS changed_count FROM prev p JOIN h ON h.tenant_id = p.tenant_id AND h.url = p.url LEFT JOIN cc ON cc.run_id = p.run_id""")
def run_details(spark, sf):
    runs = V.typed(spark, sf)
    summaries = changes.change_summary(changes.compare_with_previous(runs))
    return growth.run_details(runs, summaries).select("run_id", "domain", "bucket", "total_runs", "success_runs", "changed_count")


@query("recent_history", S.with_(S.RUNS) + "SELECT tenant_id, url, run_id, status, rank FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, url ORDER BY run_id DESC) AS rank FROM runs) WHERE rank <= 10")
def recent_history(spark, sf):
    return growth.recent_history(V.runs(spark, sf)).select("tenant_id", "url", "run_id", "status", "rank")


@query("evaluation_failures", "WITH " + S.EV + f" SELECT CASE WHEN event_type = 'error' THEN {S._ERR}[k % 8 + 1] ELSE 'unknown' END AS reason, count(*) AS n FROM ev WHERE event_type NOT IN ('purchase', 'click') GROUP BY 1")
def evaluation_failures(spark, sf):
    return kpi.evaluation_failures(V.evaluation_records(spark, sf))


@query("field_labels", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '价格' WHEN 1 THEN 'own ' || p_partkey ELSE 'list price' END AS label, CASE p_partkey % 2 WHEN 0 THEN '商品页' ELSE 'pricing' END AS page_type FROM part")
def field_labels(spark, sf):
    key = F.col("p_partkey")
    own = F.when(key % 3 == 1, F.create_map(F.lit("price"), F.concat(F.lit("own "), key))).otherwise(F.create_map().cast("map<string,string>"))
    name = F.when(key % 3 == 2, "list_price").otherwise("price")
    return V.table(spark, sf, "part").select(
        "p_partkey", LB.field_label(name, own).alias("label"), LB.page_type_label(F.when(key % 2 == 0, "Product ").otherwise("pricing")).alias("page_type")
    )


@query("feedback_synonyms", "SELECT p_partkey, ['correct', 'incorrect', 'missing', 'unsure', 'unknown'][p_partkey % 5 + 1] AS status FROM part")
def feedback_synonyms(spark, sf):
    texts = F.array(*[F.lit(t) for t in (" Right", "错误", "EMPTY", "unsure", "  ")])
    return V.table(spark, sf, "part").select(
        "p_partkey", classify.feedback_status(F.element_at(texts, (F.col("p_partkey") % 5 + 1).cast("int"))).alias("status")
    )


@query("learned_rule_reuse", "SELECT p_partkey AS page_id, 'rule' AS strategy, 'USD ' || p_size AS price, p_brand AS brand FROM part")
def learned_rule_reuse(spark, sf):
    """X11: pages whose URL matches a profile are extracted by the profile's own field plan."""
    key = F.col("p_partkey")
    pages = V.wide_table(spark, sf, "part").select(
        key.alias("page_id"), F.concat(F.lit("https://h"), key % 9, F.lit(".example.com/a/b/"), key).alias("url"),
        F.concat(F.lit("Price: USD "), "p_size", F.lit("\nBrand: "), "p_brand", F.lit("\nplain words only here")).alias("text"),
        F.array().cast("array<string>").alias("selected_fields"), F.expr(X.EMPTY_MAP).alias("hints"),
    )
    plans = V.table(spark, sf, "part").select(
        F.concat(F.lit("lp-h"), key % 9).alias("profile_id"), F.concat(F.lit("h"), key % 9, F.lit(".example.com")).alias("domain"),
    ).distinct().select(
        "profile_id", "domain", F.lit("/a/b").alias("path_prefix"), F.array(F.lit("price"), F.lit("brand")).alias("selected_fields"), F.lit(True).alias("is_active")
    )
    matched = PR.match_profiles(pages, plans).join(
        plans.select("profile_id", F.struct("profile_id", F.lit("product").alias("page_type"), F.col("selected_fields")).alias("profile")), "profile_id", "left"
    )
    d = F.col("result.data")
    return X.cascade(X.with_lines(matched)).select(
        "page_id", "result.strategy", F.element_at(d, "price").alias("price"), F.element_at(d, "brand").alias("brand")
    )
