"""Monitors: schedule, due set, alert severity, channels and notification policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.blank import is_blank_array
from pagetide.functions.labels import alert_label
from pagetide.functions.text import split_keywords

# ---- Fixed values
MIN_INTERVAL, MAX_INTERVAL, DEFAULT_INTERVAL = 5, 60 * 24 * 7, 60
CHANNEL_TYPES = ("webhook", "slack", "teams", "discord")
DEFAULT_NOTIFY_ON = ("changed", "error")
ACTIVE_STATUSES = ("pending", "queued", "running")
QUIET_START, QUIET_END, DIGEST_HOUR = 22, 8, 9
LEGACY_CHANNEL_NAME = "默认 Webhook"
DENIALS = {
    "no_channel": "未配置通知通道，已跳过发送",
    "not_matched": "当前告警未命中 notify_on 规则",
    "digest_only": "当前监控已启用仅 Digest 模式，实时通知已跳过",
    "quiet_hours": "当前处于静默时段，实时通知已跳过",
    "cooldown": "当前处于通知冷却时间内，实时通知已跳过",
}
ERROR_ACTIONS = (
    "先手动重跑一次，确认页面是否卡在加载态或触发风控。",
    "如果连续失败，建议切换抓取模式或重新学习该站点记忆。",
    "建议先分析页面并沉淀站点记忆，降低后续恢复成本。",
)
STABLE_ACTIONS = (
    "当前页面表现稳定，可继续保留自动巡检。",
    "如果这是重点页面，建议补上通知通道。",
    "如需对团队同步，可直接导出摘要而不是手动整理原始字段。",
)
CHANGED_ACTIONS = {
    "unfocused": "优先复核本次变化字段，确认不是页面噪声。",
    "urgent": "建议立即导出变化摘要，并同步给负责人或相关团队。",
    "calm": "建议补一次人工复核，再决定是否升级通知。",
    "no_channel": "建议补上通知通道，避免后续关键变化遗漏。",
}
DEFAULT_SCENARIO = "页面变化监控"
# ---- end of fixed values


# ---------------------------------------------------------------- schedule


def schedule_interval(minutes: Column) -> Column:
    """minutes held in 5..10080; 60 when missing or zero."""
    given = F.when((minutes.isNull()) | (minutes == 0), DEFAULT_INTERVAL).otherwise(minutes)
    return F.least(F.greatest(given, F.lit(MIN_INTERVAL)), F.lit(MAX_INTERVAL)).cast("int")


def next_run_at(base: Column, minutes: Column) -> Column:
    """base time plus the held interval."""
    return base + F.make_interval(mins=schedule_interval(minutes))


def schedule_status(enabled: Column, paused_at: Column) -> Column:
    return F.when(~F.coalesce(enabled, F.lit(False)), "disabled").when(paused_at.isNotNull(), "paused").otherwise("active")


def claim_status(claimed_by: Column, lease_until: Column, as_of: Column) -> Column:
    return (
        F.when(F.trim(F.coalesce(claimed_by, F.lit(""))) == "", "idle")
        .when(lease_until <= as_of, "expired")
        .otherwise("claimed")
    )


def in_quiet_hours(hour: Column, start: Column, end: Column) -> Column:
    """wraps midnight; equal hours mean always."""
    return (
        F.when(start == end, True)
        .when(start < end, (hour >= start) & (hour < end))
        .otherwise((hour >= start) | (hour < end))
    )


def due_monitors(monitors: DataFrame, as_of: Column) -> DataFrame:
    """Enabled, not paused, next run reached, and no live claim."""
    free = (
        (F.coalesce("schedule_claimed_by", F.lit("")) == "")
        | F.col("schedule_lease_until").isNull()
        | (F.col("schedule_lease_until") <= as_of)
    )
    return monitors.where(
        F.col("schedule_enabled")
        & F.col("schedule_paused_at").isNull()
        & (F.col("schedule_next_run_at") <= as_of)
        & free
    )


def _busy_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.lower("status").isin(*ACTIVE_STATUSES)).select(
        "tenant_id", F.col("task_id").alias("last_task_id")
    )


def startable_monitors(due: DataFrame, runs: DataFrame) -> DataFrame:
    """Due monitors whose last run is not still active."""
    return due.join(_busy_runs(runs), ["tenant_id", "last_task_id"], "left_anti")


def busy_monitors(due: DataFrame, runs: DataFrame) -> DataFrame:
    """Due monitors skipped because their last run is active."""
    return due.join(_busy_runs(runs), ["tenant_id", "last_task_id"], "left_semi")


def first_due(due: DataFrame, n: int) -> DataFrame:
    """K05."""
    return due.orderBy("schedule_next_run_at", "updated_at", "monitor_id").limit(n)


# ---------------------------------------------------------------- channels and profile defaults


def normalize_channels(monitors: DataFrame) -> DataFrame:
    """One row per distinct (type, target) of a monitor, first position kept.

    Unknown types become webhook; a later duplicate supplies a missing secret or name and can
    enable the channel.  A legacy `webhook_url` of the profile counts as the last channel.
    """
    profile = monitors.schema["profile"].dataType.fieldNames()
    listed = F.transform(
        F.coalesce("profile.channels", F.array()),
        lambda c: F.struct(
            F.lower(F.trim(F.coalesce(c["channel_type"], F.lit("webhook")))).alias("channel_type"),
            F.trim(F.coalesce(c["name"], F.lit(""))).alias("name"),
            F.trim(F.coalesce(c["target"], F.lit(""))).alias("target"),
            F.trim(F.coalesce(c["secret"], F.lit(""))).alias("secret"),
            F.coalesce(c["enabled"], F.lit(True)).alias("enabled"),
        ),
    )
    if "webhook_url" in profile:
        legacy = F.array(
            F.struct(
                F.lit("webhook").alias("channel_type"), F.lit(LEGACY_CHANNEL_NAME).alias("name"),
                F.trim(F.coalesce("profile.webhook_url", F.lit(""))).alias("target"),
                F.trim(F.coalesce("profile.webhook_secret", F.lit(""))).alias("secret")
                if "webhook_secret" in profile else F.lit("").alias("secret"),
                F.lit(True).alias("enabled"),
            )
        )
        listed = F.concat(listed, legacy)
    rows = monitors.select("tenant_id", "monitor_id", F.posexplode(listed).alias("position", "c")).where(
        F.col("c.target") != ""
    )
    kind = F.when(F.col("c.channel_type").isin(*CHANNEL_TYPES), F.col("c.channel_type")).otherwise("webhook")
    first_text = lambda name: F.min_by(
        F.col("c." + name), F.when(F.col("c." + name) != "", F.col("position"))
    )
    return rows.groupBy("tenant_id", "monitor_id", kind.alias("channel_type"), F.col("c.target").alias("target")).agg(
        F.min("position").alias("position"),
        F.coalesce(first_text("name"), F.lit("")).alias("name"),
        F.coalesce(first_text("secret"), F.lit("")).alias("secret"),
        F.max("c.enabled").alias("enabled"),
    )


def has_channel() -> Column:
    """True when the profile has an enabled channel with a target."""
    return F.exists(
        F.coalesce("profile.channels", F.array()),
        lambda c: (F.trim(F.coalesce(c["target"], F.lit(""))) != "") & F.coalesce(c["enabled"], F.lit(True)),
    )


def profile_with_defaults() -> Column:
    """The profile with its defaults filled in."""
    p = F.col("profile")

    def held(value: Column, low, high) -> Column:
        return F.least(F.greatest(value, F.lit(low)), F.lit(high))

    notify_on = F.filter(
        F.transform(F.coalesce(p["notify_on"], F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))),
        lambda x: x != "",
    )
    return F.struct(
        F.when(F.size(notify_on) > 0, notify_on)
        .otherwise(F.array(*[F.lit(x) for x in DEFAULT_NOTIFY_ON]))
        .alias("notify_on"),
        F.coalesce(p["always_notify_error"], F.lit(True)).alias("always_notify_error"),
        F.coalesce(p["digest_enabled"], F.lit(False)).alias("digest_enabled"),
        held(F.coalesce(p["digest_hour"], F.lit(DIGEST_HOUR)), 0, 23).alias("digest_hour"),
        F.coalesce(p["digest_only"], F.lit(False)).alias("digest_only"),
        F.coalesce(p["quiet_hours_enabled"], F.lit(False)).alias("quiet_hours_enabled"),
        held(F.coalesce(p["quiet_hours_start"], F.lit(QUIET_START)), 0, 23).alias("quiet_hours_start"),
        held(F.coalesce(p["quiet_hours_end"], F.lit(QUIET_END)), 0, 23).alias("quiet_hours_end"),
        F.greatest(F.coalesce(p["notification_cooldown_minutes"], F.lit(0)), F.lit(0)).alias("notification_cooldown_minutes"),
        F.greatest(F.coalesce(p["min_change_count"], F.lit(0)), F.lit(0)).alias("min_change_count"),
        held(F.coalesce(p["min_change_ratio"], F.lit(0.0)), 0.0, 1.0).alias("min_change_ratio"),
        F.trim(F.coalesce(p["alert_focus"], F.lit(""))).alias("alert_focus"),
        F.trim(F.coalesce(p["scenario_label"], F.lit(""))).alias("scenario_label"),
        F.when(has_channel(), "ready").otherwise("pending_channel").alias("notification_setup_status"),
    )


# ---------------------------------------------------------------- severity and policy
# The functions below read alert rows: a monitor's columns plus `alert_level` and
# `changed_fields` ARRAY<STRUCT<field, label, change_type>>.


def focus_terms(labels: Column | None = None) -> Column:
    """Lower-cased focus keywords, then field names and their labels."""
    names = F.transform(F.coalesce("selected_fields", F.array().cast("array<string>")), lambda f: F.lower(F.trim(f)))
    parts = [split_keywords(F.lower("profile.alert_focus")), names]
    if labels is not None:
        parts.append(F.transform(F.map_values(labels), lambda v: F.lower(F.trim(v))))
    return F.filter(F.array_distinct(F.concat(*parts)), lambda t: t != "")


def focus_matches(terms: Column) -> Column:
    """Labels of the changed fields that contain, or are contained in, a focus term."""

    def hit(change: Column) -> Column:
        label, field = F.lower(F.trim(change["label"])), F.lower(F.trim(change["field"]))
        return F.exists(
            terms, lambda t: label.contains(t) | field.contains(t) | t.contains(label) | t.contains(field)
        )

    return F.array_distinct(F.transform(F.filter(F.col("changed_fields"), hit), lambda c: F.trim(c["label"])))


def with_severity(alerts: DataFrame) -> DataFrame:
    """Add `focus_matches` and `severity` (critical, high, medium, low)."""
    changed = F.coalesce(F.size("changed_fields"), F.lit(0))
    removed = F.size(F.filter("changed_fields", lambda c: c["change_type"] == "removed"))
    focused = F.size("focus_matches")
    return (
        alerts.withColumn("_terms", focus_terms(F.col("field_labels") if "field_labels" in alerts.columns else None))
        .withColumn("focus_matches", focus_matches(F.col("_terms")))
        .withColumn(
            "severity",
            F.when(F.col("alert_level") == "error", "critical")
            .when(F.coalesce("alert_level", F.lit("")) != "changed", "low")
            .when((removed > 0) | (focused >= 2) | (changed >= 4), "high")
            .when((focused > 0) | (changed >= 2), "medium")
            .otherwise("low"),
        )
        .drop("_terms")
    )


def notification_decision(as_of: Column) -> Column:
    """STRUCT<send, reason>; the rules are tried in order, hour 0 is midnight."""
    p, level = F.col("settings"), F.lower(F.trim(F.coalesce("alert_level", F.lit(""))))
    changed = F.greatest(F.coalesce(F.size("changed_fields"), F.lit(0)), F.lit(0))
    ratio = F.when(
        is_blank_array(F.col("selected_fields")), (changed > 0).cast("double")
    ).otherwise(changed / F.size("selected_fields"))
    cooling = (
        (p["notification_cooldown_minutes"] > 0)
        & F.col("last_notification_at").isNotNull()
        & (level != "error")
        & (as_of < F.col("last_notification_at") + F.make_interval(mins=p["notification_cooldown_minutes"]))
    )

    def verdict(send: bool, reason) -> Column:
        text = reason if isinstance(reason, Column) else F.lit(reason)
        return F.struct(F.lit(send).alias("send"), text.alias("reason"))

    few = F.concat(F.lit("变化字段数 "), changed, F.lit(" 未达到阈值 "), p["min_change_count"], F.lit("，已跳过实时通知"))
    percent = lambda v: F.format_string("%.0f%%", v * 100)
    thin = F.concat(F.lit("变化占比 "), percent(ratio), F.lit(" 未达到阈值 "), percent(p["min_change_ratio"]), F.lit("，已跳过实时通知"))
    return (
        F.when(~has_channel(), verdict(False, DENIALS["no_channel"]))
        .when((level == "error") & p["always_notify_error"], verdict(True, ""))
        .when(~F.array_contains(p["notify_on"], level), verdict(False, DENIALS["not_matched"]))
        .when(p["digest_only"] & (level != "error"), verdict(False, DENIALS["digest_only"]))
        .when(
            p["quiet_hours_enabled"] & in_quiet_hours(F.hour(as_of), p["quiet_hours_start"], p["quiet_hours_end"]),
            verdict(False, DENIALS["quiet_hours"]),
        )
        .when(cooling, verdict(False, DENIALS["cooldown"]))
        .when((level == "changed") & (p["min_change_count"] > 0) & (changed < p["min_change_count"]), verdict(False, few))
        .when((level == "changed") & (p["min_change_ratio"] > 0) & (ratio < p["min_change_ratio"]), verdict(False, thin))
        .otherwise(verdict(True, ""))
    )


def decide_notifications(alerts: DataFrame, as_of: Column) -> DataFrame:
    """C06 for a table of alert rows: add `send` and `reason`."""
    return (
        alerts.withColumn("settings", profile_with_defaults())
        .withColumn("_d", notification_decision(as_of))
        .select("*", "_d.send", "_d.reason")
        .drop("_d", "settings")
    )


def with_business_text(alerts: DataFrame) -> DataFrame:
    """Add `business_summary` and `recommended_actions`; reads the columns of `with_severity`."""
    scenario = F.coalesce(F.when(F.trim("profile.scenario_label") != "", F.trim("profile.scenario_label")), F.lit(DEFAULT_SCENARIO))
    focus = F.coalesce(F.when(F.trim("profile.alert_focus") != "", F.trim("profile.alert_focus")), F.lit("关键字段"))
    matches = F.array_join("focus_matches", "、")
    focused, changed = F.size("focus_matches") > 0, F.size("changed_fields")
    level = F.col("alert_level")
    summary = (
        F.when(level == "error", F.concat(scenario, F.lit(" 本次巡检失败，暂时无法产出更新结论。")))
        .when(level == "stable", F.concat(scenario, F.lit(" 本次未发现 "), focus, F.lit(" 的明显变化，可继续自动巡检。")))
        .when(focused, F.concat(scenario, F.lit(" 检测到 "), matches, F.lit(" 等关键字段发生变化，适合立即输出变化简报。")))
        .when(changed > 0, F.concat(scenario, F.lit(" 本次发现 "), changed, F.lit(" 项字段变化，建议尽快复核。")))
        .otherwise(F.concat(scenario, F.lit(" 已完成巡检，本次暂无可执行变化结论。")))
    )
    goal = (
        F.trim("profile.business_goal")
        if "business_goal" in alerts.schema["profile"].dataType.fieldNames()
        else F.lit("")
    )
    kept = lambda *xs: F.array_compact(F.array(*xs))
    # A site with a learned profile or a memory needs no advice to build one.
    known_site = F.lit(False)
    for name in ("learned_profile_id", "last_learned_profile_id", "site_memory"):
        if name in alerts.columns:
            known_site = known_site | (F.coalesce(F.col(name).cast("string"), F.lit("")) != "")
    actions = (
        F.when(level == "error", kept(*[F.lit(a) for a in ERROR_ACTIONS[:2]], F.when(~known_site, F.lit(ERROR_ACTIONS[2]))))
        .when(
            level == "changed",
            kept(
                F.when(focused, F.concat(F.lit("优先核对 "), matches, F.lit(" 是否影响当前业务判断。"))).otherwise(CHANGED_ACTIONS["unfocused"]),
                F.when(goal != "", F.concat(F.lit("建议围绕“"), goal, F.lit("”同步本次变化结论。"))),
                F.when(F.col("severity").isin("high", "critical"), CHANGED_ACTIONS["urgent"]).otherwise(CHANGED_ACTIONS["calm"]),
                F.when(~has_channel(), CHANGED_ACTIONS["no_channel"]),
            ),
        )
        .otherwise(kept(F.lit(STABLE_ACTIONS[0]), F.when(~has_channel(), STABLE_ACTIONS[1]), F.lit(STABLE_ACTIONS[2])))
    )
    return alerts.withColumn("business_summary", summary).withColumn("recommended_actions", actions)


def alert_payloads(alerts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The JSON body of each alert, beside the columns of alerts named in keep."""
    body = F.struct(
        F.lit("monitor_alert").alias("event"),
        F.struct("monitor_id", "name", "url", "profile.scenario_label", "profile.alert_focus", "profile.notify_on").alias("monitor"),
        F.struct(
            F.col("alert_level").alias("level"), alert_label(F.col("alert_level")).alias("level_label"), "severity",
            "business_summary", "recommended_actions", F.size("changed_fields").alias("changed_fields_count"), "changed_fields",
        ).alias("alert"),
        F.struct("task_id", "status").alias("task"),
    )
    return alerts.select("tenant_id", "monitor_id", "task_id", *keep, F.to_json(body).alias("payload"))
