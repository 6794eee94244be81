"""Notification events: filters, retries, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.operators.kpi import n_if
from pagetide.operators.monitors import normalize_channels
from pagetide.operators.ordered import DEFAULT_SPAN, position_in_key, previous_where

# ---- Fixed values
RETRY_DELAYS_MINUTES = (1, 5, 30)
ALERT_EVENT, DIGEST_EVENT = "monitor_alert", "daily_digest"
STATUS_PRECEDENCE = ("retry_pending", "failed", "sent")
# ---- end of fixed values


def filter_events(
    events: DataFrame,
    *,
    monitor_id: str = "",
    status: str = "",
    task_id: str = "",
    event_type: str = "",
    created_after: Column | None = None,
    tenant_id: str | None = None,
) -> DataFrame:
    """Every given condition narrows the log."""
    wanted = {
        "monitor_id": monitor_id, "status": status, "task_id": task_id, "event_type": event_type,
        "tenant_id": "" if tenant_id in (None, "*") else tenant_id,
    }
    for name, value in wanted.items():
        if value:
            events = events.where(F.col(name) == value)
    return events if created_after is None else events.where(F.col("created_at") >= created_after)


def latest_events(events: DataFrame, n: int) -> DataFrame:
    """K01 for events."""
    return events.orderBy(F.desc("created_at"), F.desc("notification_id")).limit(n)


def due_retries(events: DataFrame, as_of: Column) -> DataFrame:
    """P13."""
    return events.where((F.col("status") == "retry_pending") & (F.col("next_retry_at") <= as_of))


def first_due_retries(due: DataFrame, n: int) -> DataFrame:
    """K06."""
    return due.orderBy("next_retry_at", "created_at", "notification_id").limit(n)


def next_retry_at(attempt_no: Column, max_attempts: Column, as_of: Column) -> Column:
    """1, 5, then 30 minutes after a failed attempt; NULL at the last one."""
    attempt = F.greatest(F.coalesce(attempt_no, F.lit(1)), F.lit(1))
    delays = F.array(*[F.lit(m) for m in RETRY_DELAYS_MINUTES])
    minutes = F.element_at(delays, F.least(attempt, F.lit(len(RETRY_DELAYS_MINUTES))).cast("int"))
    last = F.greatest(F.coalesce(max_attempts, F.lit(1)), F.lit(1))
    return F.when(attempt < last, as_of + F.make_interval(mins=minutes))


def retry_chain(events: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Position of each event among those of the same run and target, and the event before it."""
    keys = ["tenant_id", "task_id", "target"]
    numbered = position_in_key(events, keys, "notification_id", "chain_no", span)
    return previous_where(numbered, keys, "notification_id", None, "notification_id", "retry_of", span)


def _status_counts() -> list[Column]:
    return [
        n_if(F.col("status") == "sent").alias("sent_count"),
        n_if(F.col("status") == "failed").alias("failed_count"),
        n_if(F.col("status") == "retry_pending").alias("retry_pending_count"),
        n_if(F.col("triggered_by") == "manual").alias("manual_resend_count"),
        n_if(F.col("triggered_by") == "retry").alias("auto_retry_count"),
    ]


def in_window(events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Events of the trailing window."""
    start = as_of - F.make_interval(hours=F.lit(max(hours, 1)))
    return events.where((F.col("created_at") >= start) & (F.col("created_at") <= as_of))


def digest_summary(events: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Totals of the trailing window per tenant."""
    alert = F.col("event_type") == ALERT_EVENT
    return in_window(events, as_of, hours).groupBy("tenant_id").agg(
        F.count("*").alias("total_notifications"),
        n_if(alert).alias("monitor_alert_notifications"),
        n_if(F.col("event_type") == DIGEST_EVENT).alias("digest_notifications"),
        F.countDistinct(F.when(alert & (F.col("monitor_id") != ""), F.col("monitor_id"))).alias("unique_monitors"),
        *_status_counts(),
    )


def digest_monitors(events: DataFrame, monitors: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Alert counts and latest alert of each monitor in the window.

    Events are aggregated per monitor before the join.
    """
    alerts = in_window(events, as_of, hours).where(F.col("event_type") == ALERT_EVENT)
    counted = alerts.groupBy("tenant_id", "monitor_id").agg(
        F.count("*").alias("notification_count"),
        n_if(F.col("status") == "failed").alias("failed_count"),
        n_if(F.col("status") == "retry_pending").alias("retry_pending_count"),
        F.max_by(F.struct("status", "created_at"), F.struct("created_at", "notification_id")).alias("latest"),
    )
    return counted.join(
        monitors.select("tenant_id", "monitor_id", "name", "url"), ["tenant_id", "monitor_id"]
    ).select(
        "tenant_id", "monitor_id", "name", "url", "notification_count", "failed_count", "retry_pending_count",
        F.col("latest.status").alias("latest_notification_status"),
        F.col("latest.created_at").alias("latest_notification_at"),
    )


def top_digest_monitors(rows: DataFrame, n: int = 8) -> DataFrame:
    """K08."""
    return rows.orderBy(
        F.desc("failed_count"), F.desc("retry_pending_count"), F.desc("notification_count"), "name", "monitor_id"
    ).limit(n)


def recent_failures(events: DataFrame, as_of: Column, hours: int = 24, n: int = 8) -> DataFrame:
    """Newest failed or waiting events of the window."""
    return latest_events(
        in_window(events, as_of, hours).where(F.col("status").isin("failed", "retry_pending")), n
    )


def digest_members(monitors: DataFrame, enabled_only: bool = False, due_hour: int | None = None) -> DataFrame:
    """One row per monitor and enabled channel; the member list of each digest target."""
    chosen = monitors.withColumn("_hour", F.coalesce("profile.digest_hour", F.lit(9)))
    if enabled_only:
        chosen = chosen.where(F.coalesce("profile.digest_enabled", F.lit(False)))
    if due_hour is not None:
        chosen = chosen.where(F.col("_hour") == due_hour)
    facts = chosen.select(
        "tenant_id", "monitor_id", F.col("_hour").alias("digest_hour"),
        F.coalesce("profile.digest_enabled", F.lit(False)).alias("digest_enabled"),
    )
    channels = normalize_channels(chosen.drop("_hour")).where("enabled")
    return channels.join(facts, ["tenant_id", "monitor_id"])


def digest_targets(members: DataFrame) -> DataFrame:
    """One row per (tenant, type, target): first non-blank secret and name, members, hour.

    The members stay the long table `digest_members`: a popular target may have any number.
    """
    first_text = lambda name: F.coalesce(
        F.min_by(name, F.when(F.col(name) != "", F.col("monitor_id"))), F.lit("")
    )
    return members.groupBy("tenant_id", "channel_type", "target").agg(
        first_text("secret").alias("secret"),
        first_text("name").alias("name"),
        F.countDistinct("monitor_id").alias("monitors"),
        F.max("digest_enabled").alias("digest_enabled"),
        F.coalesce(F.min(F.when(F.col("digest_enabled"), F.col("digest_hour"))), F.min("digest_hour")).alias("digest_hour"),
    )


def unsent_targets(targets: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """Targets that got no digest since midnight."""
    sent = events.where(
        (F.col("event_type") == DIGEST_EVENT)
        & (F.col("created_at") >= F.date_trunc("day", as_of))
        & (F.trim("target") != "")
    ).select("tenant_id", F.lower(F.trim("channel_type")).alias("channel_type"), F.trim("target").alias("target"))
    return targets.join(sent, ["tenant_id", "channel_type", "target"], "left_anti")


def delivery_outcomes(results: DataFrame, *keys: str) -> DataFrame:
    """One status per group of channel results: waiting before failed before sent, else skipped."""
    counts = {s: n_if(F.col("status") == s).alias(s) for s in (*STATUS_PRECEDENCE, "skipped")}
    summed = results.groupBy(*keys).agg(F.count("*").alias("channels"), *counts.values())
    status = F.when(F.lit(False), "")
    for name in STATUS_PRECEDENCE:
        status = status.when(F.col(name) > 0, name)
    return summed.withColumn("status", status.otherwise("skipped")).withColumn(
        "message",
        F.concat(
            F.lit("通知共 "), "channels", F.lit(" 个通道，成功 "), "sent", F.lit("，失败 "), "failed",
            F.lit("，待重试 "), "retry_pending", F.lit("，跳过 "), "skipped",
        ),
    )
