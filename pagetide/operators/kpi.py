"""Dashboards as aggregations over whole run-history tables.

Every report is one or two map-side-combined aggregations.  A group is never collected
into one task: lists that the report shows are separate long tables or bounded top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions.blank import ratio, truthy
from pagetide.functions.classify import coarse_failure_class
from pagetide.functions.urls import extract_domain
from pagetide.operators.ordered import top_per_key
from pagetide.operators.runs import (
    bucket,
    field_valid_score,
    in_month,
    rescue_attempted,
    rescue_succeeded,
    with_observability,
)

# ---- Fixed values
TRIAL_PLAN = {
    "plan_name": "trial", "monthly_task_limit": 1000, "monthly_url_limit": 3000,
    "monitor_limit": 50, "monthly_token_limit": 1000000, "export_limit": 200,
    "max_concurrency": 3, "overage_policy": "reject",
}
USAGE_COUNTERS = (
    "tasks_created", "urls_submitted", "monitors_created", "exports_count", "total_tokens",
    "model_cost_usd", "playwright_elapsed_ms", "retry_count",
)
RESULT_BUCKETS = ("full_success", "partial_success", "fetch_failed", "validation_failed", "failed")
FEEDBACK_KINDS = ("correct", "incorrect", "missing", "unknown")
NEAR_QUOTA, NEAR_QUOTA_DANGER = 0.8, 0.95
HIGH_FAILURE, HIGH_FAILURE_RUNS = 0.3, 3
INACTIVE_DAYS = 14
TREND_DROP, TREND_RUNS, TREND_DAYS = 0.2, 3, 7
SCORE_WEIGHTS = (0.6, 0.3, 0.1)
# ---- end of fixed values


def n_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _is(status: str) -> Column:
    return F.col("status") == status


# ---------------------------------------------------------------- runs


def run_stats(runs: DataFrame) -> DataFrame:
    """Counts by state and success rate of root runs, per tenant."""
    return (
        runs.where(F.col("parent_task_id") == "")
        .groupBy("tenant_id")
        .agg(
            F.count("*").alias("total"),
            n_if(_is("success")).alias("success"),
            n_if(_is("failed")).alias("failed"),
            n_if(_is("running")).alias("running"),
            n_if(F.col("status").isin("pending", "queued")).alias("pending"),
        )
        .withColumn("success_rate", ratio(F.col("success"), F.col("total")))
    )


def url_history(runs: DataFrame) -> DataFrame:
    """Run counts, first sight and last success of every URL."""
    return (
        runs.groupBy("tenant_id", "url")
        .agg(
            F.count("*").alias("total_runs"),
            n_if(_is("success")).alias("success_runs"),
            n_if(_is("failed")).alias("failed_runs"),
            F.min("created_at").alias("first_seen_at"),
            F.max(F.when(_is("success"), F.col("completed_at"))).alias("last_success_at"),
            F.max_by("task_id", F.when(_is("success"), F.col("run_id"))).alias("last_success_task_id"),
        )
        .withColumn("has_history", F.col("total_runs") > 1)
    )


def status_by_day(runs: DataFrame) -> DataFrame:
    """Runs per tenant, day and status."""
    return runs.groupBy("tenant_id", F.to_date("created_at").alias("day"), "status").agg(
        F.count("*").alias("runs")
    )


def failure_histogram(metrics: DataFrame, n: int = 8) -> DataFrame:
    """The n most frequent failure categories of each tenant."""
    counted = (
        metrics.where(_is("failed"))
        .groupBy("tenant_id", "failure_category")
        .agg(F.count("*").alias("runs"))
    )
    return top_per_key(counted, ["tenant_id"], [F.desc("runs"), F.asc("failure_category")], n)


def coarse_failures(runs: DataFrame) -> DataFrame:
    """A04 on the six-way classes."""
    return (
        runs.where(_is("failed"))
        .groupBy("tenant_id", coarse_failure_class(F.col("error")).alias("failure_class"))
        .agg(F.count("*").alias("runs"))
    )


def batch_rollup(runs: DataFrame) -> DataFrame:
    """State, progress, mean quality and last error of each batch from its children."""
    children = runs.where(F.col("parent_task_id") != "")
    failed_with_text = _is("failed") & (F.coalesce("error", F.lit("")) != "")
    sums = children.groupBy("tenant_id", "parent_task_id").agg(
        F.count("*").alias("total"),
        n_if(_is("success")).alias("success"),
        n_if(_is("failed")).alias("failed"),
        n_if(_is("running")).alias("running"),
        n_if(_is("queued")).alias("queued"),
        F.coalesce(F.avg(F.when(F.col("quality_score") > 0, F.col("quality_score"))), F.lit(0.0)).alias("quality_score"),
        F.sum(F.coalesce("elapsed_ms", F.lit(0.0))).alias("elapsed_ms"),
        F.max_by("error", F.when(failed_with_text, F.col("run_id"))).alias("last_error"),
    )
    done = F.col("success") + F.col("failed")
    busy = (F.col("running") > 0) | (F.col("completed") > 0)
    share = F.round(F.col("completed") / F.greatest("total", F.lit(1)) * 100, 1)
    return (
        sums.withColumn("completed", done)
        .withColumn("pending", F.greatest(F.col("total") - done - F.col("running") - F.col("queued"), F.lit(0)))
        .withColumn(
            "status",
            F.when(F.col("completed") >= F.col("total"), F.when(F.col("failed") > 0, "failed").otherwise("success"))
            .when(busy, "running")
            .when(F.col("queued") > 0, "queued")
            .otherwise("pending"),
        )
        .withColumn(
            "progress_percent",
            F.when(F.col("completed") >= F.col("total"), share)
            .when(busy, F.greatest(share, F.lit(6.0)))
            .otherwise(F.greatest(share, F.lit(2.0))),
        )
        .withColumn(
            "error",
            F.when(
                F.col("last_error").isNotNull(),
                F.concat(F.lit("批量任务中有 "), "failed", F.lit(" 个 URL 失败；最近错误："), "last_error"),
            ).otherwise(""),
        )
        .drop("last_error")
    )


def batch_urls(runs: DataFrame) -> DataFrame:
    """The URL list of each batch, one row per child; `run_id` is the position."""
    return runs.where(F.col("parent_task_id") != "").select(
        "tenant_id", "parent_task_id", "run_id", "url"
    )


def daily_overview(typed: DataFrame) -> DataFrame:
    """Result-bucket KPIs per tenant and day."""
    score = field_valid_score()
    facts = with_observability(typed).select(
        "tenant_id", F.to_date("created_at").alias("day"), "status",
        bucket().alias("bucket"), score.alias("score"),
        rescue_attempted().alias("tried"), rescue_succeeded().alias("rescued"),
        F.col("runtime.content_ready").alias("ready"),
        ((F.col("usage.total_calls") > 0) & _is("success")).alias("model_success"),
    )
    sums = facts.groupBy("tenant_id", "day").agg(
        F.count("*").alias("tasks"),
        n_if(_is("success")).alias("success"),
        *[n_if(F.col("bucket") == b).alias(b) for b in RESULT_BUCKETS],
        F.sum(F.when(F.col("score") >= 0, F.col("score"))).alias("score_sum"),
        n_if(F.col("score") >= 0).alias("scored"),
        n_if(F.col("tried")).alias("tried"),
        n_if(F.col("rescued")).alias("rescued"),
        n_if(F.col("ready")).alias("ready"),
        n_if(F.col("model_success")).alias("model_success"),
    )
    fetched = F.col("tasks") - F.col("fetch_failed")
    return sums.select(
        "tenant_id", "day", "tasks", *RESULT_BUCKETS,
        ratio(F.col("success"), F.col("tasks")).alias("success_rate"),
        ratio(fetched, F.col("tasks")).alias("fetch_success_rate"),
        ratio(F.col("ready"), fetched).alias("content_ready_rate"),
        ratio(F.col("full_success") + F.col("partial_success"), fetched).alias("extraction_success_rate"),
        ratio(F.coalesce("score_sum", F.lit(0.0)), F.col("scored")).alias("field_valid_rate"),
        ratio(F.col("rescued"), F.col("tried")).alias("rescue_success_rate"),
        ratio(F.col("model_success"), F.col("success")).alias("model_success_rate"),
    )


def daily_usage(metrics: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """The eight additive counters per tenant and day.

    `metrics` is one row per run; `events` optionally adds monitor and export events with
    columns tenant_id, created_at, monitors_created, exports_count.
    """
    from_runs = metrics.select(
        "tenant_id", F.to_date("updated_at").alias("usage_date"),
        F.lit(1).alias("tasks_created"), F.lit(1).alias("urls_submitted"),
        F.lit(0).alias("monitors_created"), F.lit(0).alias("exports_count"),
        "total_tokens", F.col("estimated_cost_usd").alias("model_cost_usd"),
        "playwright_elapsed_ms", "retry_count",
    )
    if events is not None:
        from_events = events.select(
            "tenant_id", F.to_date("created_at").alias("usage_date"), "monitors_created", "exports_count"
        )
        from_runs = from_runs.unionByName(from_events, allowMissingColumns=True)
    return from_runs.groupBy("tenant_id", "usage_date").agg(
        *[F.sum(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))).alias(c) for c in USAGE_COUNTERS]
    )


def tenant_universe(*tables: DataFrame) -> DataFrame:
    """Distinct non-blank tenants of several tables; each is deduplicated before the union."""
    parts = [t.select("tenant_id").where(F.trim("tenant_id") != "").distinct() for t in tables]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()


def with_plan(tenants: DataFrame, plans: DataFrame) -> DataFrame:
    """J12 part: plan of each tenant, trial limits where it has none."""
    joined = tenants.join(plans, "tenant_id", "left")
    return joined.select(
        *tenants.columns, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in TRIAL_PLAN.items()]
    )


def monthly_usage(
    tenants: DataFrame, usage_daily: DataFrame, plans: DataFrame, monitors: DataFrame, as_of: Column
) -> DataFrame:
    """Month-to-date totals of each tenant and their five usage/limit ratios."""
    month = usage_daily.where(in_month(F.col("usage_date"), as_of))
    totals = month.groupBy("tenant_id").agg(*[F.sum(c).alias(c) for c in USAGE_COUNTERS])
    monitor_counts = monitors.groupBy("tenant_id").agg(F.count("*").alias("monitor_count"))
    base = with_plan(
        tenants.join(totals, "tenant_id", "left").join(monitor_counts, "tenant_id", "left"), plans
    ).na.fill(0, [*USAGE_COUNTERS, "monitor_count"])
    shares = {
        "tasks_ratio": ("tasks_created", "monthly_task_limit"),
        "urls_ratio": ("urls_submitted", "monthly_url_limit"),
        "monitors_ratio": ("monitor_count", "monitor_limit"),
        "tokens_ratio": ("total_tokens", "monthly_token_limit"),
        "exports_ratio": ("exports_count", "export_limit"),
    }
    return (
        base.withColumn("model_cost_usd", F.round("model_cost_usd", 6))
        .withColumn("playwright_elapsed_ms", F.round("playwright_elapsed_ms", 2))
        .withColumns({name: ratio(F.col(a), F.col(b)) for name, (a, b) in shares.items()})
        .withColumn("max_usage_ratio", F.greatest(*shares))
        .withColumn("near_quota", F.col("max_usage_ratio") >= NEAR_QUOTA)
    )


def quota_violations(monthly: DataFrame, requests: DataFrame) -> DataFrame:
    """C11: which limits a requested event would exceed.

    `requests`: request_id, tenant_id, event_type, amount, urls, tokens.
    """
    event, amount = F.col("event_type"), F.col("amount")
    creates = event.isin("task_create", "batch_create")
    checks = F.array(
        *[
            F.struct(F.lit(limit).alias("limit_name"), used.alias("used_after"), F.col(limit).cast("long").alias("limit_value"))
            for limit, used in (
                ("monthly_task_limit", F.when(creates, F.col("tasks_created") + amount)),
                ("monthly_url_limit", F.when(creates, F.col("urls_submitted") + F.greatest("urls", "amount"))),
                ("monitor_limit", F.when(event == "monitor_create", F.col("monitor_count") + amount)),
                ("export_limit", F.when(event == "export", F.col("exports_count") + amount)),
                ("monthly_token_limit", F.when(F.col("tokens") > 0, F.col("total_tokens") + F.col("tokens"))),
            )
        ]
    )
    exceeded = F.filter(checks, lambda c: (c["limit_value"] > 0) & (c["used_after"] > c["limit_value"]))
    return (
        requests.join(monthly.where(F.lower("overage_policy") == "reject"), "tenant_id")
        .select("request_id", "tenant_id", "event_type", F.explode(exceeded).alias("x"))
        .select("request_id", "tenant_id", "event_type", "x.*")
    )


def tenant_run_stats(runs: DataFrame) -> DataFrame:
    """Root-run counts and last run per tenant."""
    return (
        runs.where(F.col("parent_task_id") == "")
        .groupBy("tenant_id")
        .agg(
            F.count("*").alias("total_count"),
            n_if(_is("success")).alias("success_count"),
            n_if(_is("failed")).alias("failed_count"),
            F.max("created_at").alias("last_task_at"),
        )
    )


# ---------------------------------------------------------------- templates


def template_trend(metrics: DataFrame, as_of: Column) -> DataFrame:
    """Success of the last seven days against the seven before, per template."""
    day, today = F.to_date("updated_at"), F.to_date(as_of)
    recent = day >= F.date_sub(today, TREND_DAYS)
    previous = (day >= F.date_sub(today, 2 * TREND_DAYS)) & ~recent
    return (
        metrics.where(F.col("template_id") != "")
        .groupBy("tenant_id", "template_id")
        .agg(
            n_if(recent & _is("success")).alias("recent_success"),
            n_if(recent).alias("recent_total"),
            n_if(previous & _is("success")).alias("previous_success"),
            n_if(previous).alias("previous_total"),
        )
        .withColumn("recent_rate", ratio(F.col("recent_success"), F.col("recent_total"), None))
        .withColumn("previous_rate", ratio(F.col("previous_success"), F.col("previous_total"), None))
        .withColumn(
            "dropped",
            (F.col("recent_total") >= TREND_RUNS)
            & (F.col("previous_total") >= TREND_RUNS)
            & (F.col("previous_rate") - F.col("recent_rate") >= TREND_DROP),
        )
    )


def top_templates(metrics: DataFrame, templates: DataFrame, n: int = 10) -> DataFrame:
    """Templates with most successes in each tenant, with their names."""
    counted = (
        metrics.where(_is("success") & (F.col("template_id") != ""))
        .groupBy("tenant_id", "template_id")
        .agg(F.count("*").alias("success_count"))
    )
    named = counted.join(
        templates.select("tenant_id", "template_id", "name", "page_type"),
        ["tenant_id", "template_id"], "left",
    ).select(
        "tenant_id", "template_id",
        F.coalesce("name", "template_id").alias("template_name"),
        F.coalesce("page_type", F.lit("")).alias("page_type"), "success_count",
    )
    return top_per_key(named, ["tenant_id"], [F.desc("success_count"), F.asc("template_id")], n)


def top_templates_overall(metrics: DataFrame, templates: DataFrame, n: int = 10) -> DataFrame:
    """A14 over all tenants: template ids are counted together whatever their tenant."""
    counted = (
        metrics.where(_is("success") & (F.col("template_id") != ""))
        .groupBy("tenant_id", "template_id")
        .agg(F.count("*").alias("n"))
        .join(templates.select("tenant_id", "template_id", "name"), ["tenant_id", "template_id"], "left")
    )
    return (
        counted.groupBy("template_id", F.coalesce("name", "template_id").alias("template_name"))
        .agg(F.sum("n").alias("success_count"))
        .orderBy(F.desc("success_count"), "template_id", "template_name")
        .limit(n)
    )


def feedback_counts(feedback: DataFrame, *keys: str) -> DataFrame:
    """Feedback rows per kind; a status outside the four kinds counts as unknown."""
    kind = F.when(F.col("feedback_status").isin(*FEEDBACK_KINDS), F.col("feedback_status")).otherwise("unknown")
    return feedback.groupBy(*keys).agg(*[n_if(kind == k).alias(k) for k in FEEDBACK_KINDS])


def template_scores(templates: DataFrame, metrics: DataFrame, feedback: DataFrame) -> DataFrame:
    """Quality score of each template known to any of the three tables."""
    keys = ["tenant_id", "template_id"]
    has_id = F.trim("template_id") != ""
    runs = metrics.where(has_id).groupBy(*keys).agg(
        F.count("*").alias("total_count"),
        n_if(_is("success")).alias("success_count"),
        n_if(_is("failed")).alias("failed_count"),
        *[F.sum(c).alias(c) for c in ("field_count", "filled_field_count", "empty_field_count")],
    )
    marks = feedback_counts(feedback.where(has_id), *keys)
    names = templates.where(has_id).select(*keys, "name")
    counts = [c for c in (*runs.columns, *marks.columns) if c not in keys]
    joined = names.join(runs, keys, "full_outer").join(marks, keys, "full_outer").na.fill(0, counts)
    success, hits = (
        ratio(F.col("success_count"), F.col("total_count"), None),
        ratio(F.col("filled_field_count"), F.col("field_count"), None),
    )
    votes = sum((F.col(k) for k in FEEDBACK_KINDS[1:]), F.col(FEEDBACK_KINDS[0]))
    correct, missing = ratio(F.col("correct"), votes, None), ratio(F.col("missing"), votes, None)
    w_success, w_correct, w_present = SCORE_WEIGHTS
    return joined.select(
        *keys, F.coalesce("name", "template_id").alias("name"), *counts,
        votes.alias("field_feedback_count"),
        F.round(success, 4).alias("success_rate"),
        F.round(hits, 4).alias("field_hit_rate"),
        F.round(correct, 4).alias("field_correct_rate"),
        F.round(missing, 4).alias("field_missing_rate"),
        F.round(success * w_success + correct * w_correct + (1.0 - missing) * w_present, 4).alias("quality_score"),
    )


def ranked_templates(scores: DataFrame, n: int = 100) -> DataFrame:
    """K03."""
    return top_per_key(
        scores, ["tenant_id"], [F.desc("quality_score"), F.desc("total_count"), F.asc("template_id")], n
    )


def template_failures(metrics: DataFrame) -> DataFrame:
    """A10: failures by category (a map of at most 22 keys) and the most recent one, per template."""
    category = F.coalesce(F.when(F.col("failure_category") != "", F.col("failure_category")), F.lit("unknown"))
    counted = (
        metrics.where(_is("failed") & (F.col("template_id") != ""))
        .groupBy("tenant_id", "template_id", category.alias("category"))
        .agg(F.count("*").alias("n"), F.max(F.struct("updated_at", "run_id")).alias("last"))
    )
    return counted.groupBy("tenant_id", "template_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("failure_trend"),
        F.max_by("category", "last").alias("recent_category"),
        F.max("last.updated_at").alias("recent_at"),
    )


def template_diagnostics(typed: DataFrame) -> DataFrame:
    """Six run-time indicators summed per template."""
    run, details = F.col("doc._runtime_metrics"), F.col("doc.strategy_details")
    template = F.trim("doc._execution_context.template_id")
    zero = F.lit(0)
    return (
        typed.where(template != "")
        .groupBy("tenant_id", template.alias("template_id"))
        .agg(
            n_if(F.size(details["source_fields"]) > 0).alias("structured_hit_count"),
            n_if(truthy(details["normalization_version"])).alias("normalized_count"),
            n_if(F.col("doc.extraction_strategy") == "specialized_rule").alias("specialized_rule_count"),
            F.sum(F.coalesce(run["fetch_json_response_count"], zero)).alias("json_response_count"),
            n_if(truthy(run["mobile_ua_fallback"])).alias("mobile_fallback_count"),
            n_if((run["static_html_length"] > 0) & (run["dynamic_html_length"] > 0)).alias("html_compare_count"),
        )
    )


# ---------------------------------------------------------------- governance


def quality_dashboard(runs: DataFrame, reviews: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per tenant; a rate without any base row is NULL."""
    of_runs = runs.groupBy("tenant_id").agg(
        F.count("*").alias("runs"),
        n_if(_is("success")).alias("ok"),
        F.avg(F.when(F.col("quality_score") > 0, F.col("quality_score"))).alias("avg_quality"),
    )
    of_reviews = reviews.groupBy("tenant_id").agg(
        F.count("*").alias("reviews"),
        n_if(F.col("confirmed")).alias("confirmed"),
        F.avg(F.when(F.col("accuracy_score") > 0, F.col("accuracy_score"))).alias("accuracy"),
    )
    of_templates = templates.groupBy("tenant_id").agg(
        F.count("*").alias("templates"), n_if(F.col("use_count") > 0).alias("reused")
    )
    joined = of_runs.join(of_reviews, "tenant_id", "left").join(of_templates, "tenant_id", "left")
    return joined.select(
        "tenant_id",
        ratio(F.col("ok"), F.col("runs")).alias("extraction_success_rate"),
        F.round(F.coalesce("avg_quality", F.lit(0.0)), 4).alias("avg_quality_score"),
        F.round("accuracy", 4).alias("field_accuracy_rate"),
        F.round(F.col("confirmed") / F.col("reviews"), 4).alias("manual_confirmation_rate"),
        ratio(F.coalesce("reviews", F.lit(0)), F.col("runs")).alias("manual_review_coverage"),
        F.round(F.col("reused") / F.col("templates"), 4).alias("template_reuse_rate"),
    )


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The last review of each (tenant, run, reviewer), accuracy held in 0..1."""
    keys = ["tenant_id", "task_id", "reviewer_user_id"]
    value = F.struct(
        "confirmed",
        F.least(F.greatest(F.coalesce("accuracy_score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("accuracy_score"),
        "updated_at",
    )
    return (
        reviews.groupBy(*keys)
        .agg(F.max_by(value, F.struct("updated_at", "review_id")).alias("v"))
        .select(*keys, "v.*")
    )


def cost_dashboard(typed: DataFrame) -> DataFrame:
    """Tokens, cost, browser time and retries per tenant."""
    return (
        with_observability(typed)
        .groupBy("tenant_id")
        .agg(
            F.count("*").alias("total_tasks"),
            F.sum("usage.total_tokens").alias("total_tokens"),
            F.round(F.sum("usage.estimated_cost_usd"), 6).alias("total_model_cost_usd"),
            F.round(F.avg("usage.estimated_cost_usd"), 6).alias("avg_cost_per_task_usd"),
            F.round(F.sum("runtime.playwright_elapsed_ms"), 2).alias("total_playwright_elapsed_ms"),
            F.sum("runtime.retry_count").alias("total_retry_count"),
            F.round(F.sum("runtime.retry_cost_usd"), 6).alias("total_retry_cost_usd"),
        )
    )


def batch_costs(typed: DataFrame, n: int = 20) -> DataFrame:
    """The n most expensive batch groups of each tenant."""
    costs = (
        with_observability(typed)
        .where(F.col("batch_group_id") != "")
        .groupBy("tenant_id", "batch_group_id")
        .agg(
            F.count("*").alias("task_count"),
            F.round(F.sum("usage.estimated_cost_usd"), 6).alias("total_cost_usd"),
            F.sum("usage.total_tokens").alias("total_tokens"),
        )
    )
    return top_per_key(costs, ["tenant_id"], [F.desc("total_cost_usd"), F.asc("batch_group_id")], n)


# ---------------------------------------------------------------- insights


def domain_leaderboard(runs: DataFrame, n: int = 5) -> DataFrame:
    """Domains with most runs."""
    return (
        runs.groupBy(extract_domain(F.col("url")).alias("domain"))
        .agg(
            F.count("*").alias("total"),
            n_if(_is("success")).alias("success"),
            F.max_by("task_id", "run_id").alias("latest_task_id"),
        )
        .withColumn("success_rate", ratio(F.col("success"), F.col("total")))
        .orderBy(F.desc("total"), "domain")
        .limit(n)
    )


def watchlist(runs: DataFrame) -> DataFrame:
    """URLs seen at least twice and whether their history is enough for a monitor."""
    grouped = runs.groupBy("url").agg(
        F.count("*").alias("total_runs"),
        n_if(_is("success")).alias("success_runs"),
        F.max_by(F.struct("task_id", "status", "quality_score"), "run_id").alias("latest"),
    )
    return grouped.where(F.col("total_runs") >= 2).select(
        "url", extract_domain(F.col("url")).alias("domain"), "total_runs", "success_runs",
        F.col("latest.task_id").alias("latest_task_id"),
        F.col("latest.status").alias("latest_status"),
        F.col("latest.quality_score").alias("latest_quality"),
        ((F.col("total_runs") >= 3) & (F.col("success_runs") >= 2)).alias("monitor_ready"),
    )


def strategy_usage(typed: DataFrame) -> DataFrame:
    """rule/fallback/profile hits, model usage and the cost saved by rule runs, per tenant."""
    cost = F.col("usage.estimated_cost_usd")
    strategy = F.trim("doc.extraction_strategy")
    sums = (
        with_observability(typed)
        .groupBy("tenant_id")
        .agg(
            n_if(strategy == "rule").alias("rule_based_tasks"),
            n_if(strategy == "fallback").alias("fallback_tasks"),
            n_if(F.trim("doc.learned_profile_id") != "").alias("learned_profile_hits"),
            *[
                F.sum(F.col("usage." + c)).alias(c)
                for c in ("total_calls", "prompt_tokens", "completion_tokens", "total_tokens",
                          "api_usage_calls", "estimated_usage_calls")
            ],
            F.sum(cost).alias("cost"),
            n_if(cost > 0).alias("costed"),
        )
    )
    saved = F.when(F.col("costed") > 0, F.col("cost") / F.col("costed") * F.col("rule_based_tasks")).otherwise(0.0)
    return (
        sums.withColumn(
            "api_usage_ratio",
            ratio(F.col("api_usage_calls"), F.col("api_usage_calls") + F.col("estimated_usage_calls")),
        )
        .withColumn("estimated_cost_usd", F.round("cost", 6))
        .withColumn("estimated_saved_cost_usd", F.round(saved, 6))
        .drop("cost", "costed")
    )


def scenario_histogram(monitors: DataFrame, n: int = 5) -> DataFrame:
    """Monitors per scenario label."""
    return (
        monitors.where(F.trim("profile.scenario_label") != "")
        .groupBy(F.trim("profile.scenario_label").alias("label"))
        .agg(F.count("*").alias("monitors"))
        .orderBy(F.desc("monitors"), "label")
        .limit(n)
    )


# ---------------------------------------------------------------- funnel, feedback, profiles


def filter_funnel(events: DataFrame, tenant_id: str | None = None, stage: str = "", package_id: str = "") -> DataFrame:
    """P08."""
    for name, value in (("tenant_id", tenant_id), ("stage", stage), ("package_id", package_id)):
        if value and value != "*":
            events = events.where(F.col(name) == value)
    return events


def funnel_summary(events: DataFrame) -> DataFrame:
    """Events per package and stage."""
    package = F.coalesce(
        F.when(F.col("package_id") != "", F.col("package_id")), F.concat("package_type", F.lit(":unknown"))
    )
    return events.groupBy("tenant_id", package.alias("package"), "stage").agg(F.count("*").alias("events"))


def top_packages(summary: DataFrame, n: int = 10) -> DataFrame:
    """Packages with most events; stages as a map (the stage names are few)."""
    totals = summary.groupBy("tenant_id", "package").agg(
        F.sum("events").alias("events"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "events")))).alias("stages"),
    )
    return top_per_key(totals, ["tenant_id"], [F.desc("events"), F.asc("package")], n)


def field_quality_memory(
    feedback: DataFrame, template_id: str = "", site_domain: str = ""
) -> DataFrame:
    """Feedback per field, optionally for one template or site."""
    if template_id.strip():
        feedback = feedback.where(F.col("template_id") == template_id.strip())
    if site_domain.strip():
        feedback = feedback.where(F.col("site_domain") == site_domain.strip().lower())
    return feedback_counts(feedback.where(F.trim("field_name") != ""), "tenant_id", "field_name")


def evaluation_report(records: DataFrame, *keys: str) -> DataFrame:
    """Success rates, field validity and latency of labelled evaluation records."""
    sums = records.groupBy(*keys).agg(
        F.count("*").alias("n"),
        n_if(F.col("fetch_success")).alias("fetched"),
        n_if(F.col("content_ready")).alias("ready"),
        n_if(F.col("success")).alias("ok"),
        n_if(F.col("llm_used")).alias("model"),
        n_if(F.col("llm_used") & F.col("success")).alias("model_ok"),
        F.avg(F.when(F.col("success"), F.col("field_valid_rate"))).alias("valid"),
        F.avg("elapsed_ms").alias("latency"),
    )
    return sums.select(
        *keys, F.col("n").alias("samples"),
        ratio(F.col("fetched"), F.col("n")).alias("fetch_success_rate"),
        ratio(F.col("ready"), F.col("fetched")).alias("content_ready_rate"),
        ratio(F.col("ok"), F.col("fetched")).alias("extraction_success_on_fetched_pages"),
        ratio(F.col("model_ok"), F.col("model")).alias("llm_success_rate"),
        F.round(F.coalesce("valid", F.lit(0.0)), 4).alias("field_valid_rate_on_success"),
        F.round(F.coalesce("latency", F.lit(0.0)), 2).alias("avg_latency"),
    )


def evaluation_failures(records: DataFrame) -> DataFrame:
    """Unsuccessful records by reason."""
    reason = F.coalesce(F.when(F.col("failure_reason") != "", F.col("failure_reason")), F.lit("unknown"))
    return records.where(~F.col("success")).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def slowest_samples(records: DataFrame, n: int = 10) -> DataFrame:
    """K07."""
    return records.orderBy(F.desc("elapsed_ms"), "url").limit(n)


def proxy_counters(attempts: DataFrame) -> DataFrame:
    """Success and failure counts, last use and current state of each proxy endpoint."""
    return attempts.groupBy("tenant_id", "proxy_id").agg(
        n_if(F.col("success")).alias("success_count"),
        n_if(~F.col("success")).alias("failure_count"),
        F.max("used_at").alias("last_used_at"),
        F.max_by(
            F.when(F.col("success"), "ready").otherwise("degraded"), F.struct("used_at", "attempt_id")
        ).alias("status"),
    )


def ranked_proxies(endpoints: DataFrame, tags: list[str], n: int) -> DataFrame:
    """Enabled endpoints matching a tag, or all enabled ones of a tenant when none matches."""
    wanted = [t.strip() for t in tags if t.strip()]
    enabled = endpoints.where("enabled")
    if wanted:
        match = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in wanted]))
        any_match = (
            enabled.groupBy("tenant_id").agg(F.max(match).alias("_tenant_match"))
        )
        enabled = (
            enabled.join(any_match, "tenant_id")
            .where(match | ~F.col("_tenant_match"))
            .drop("_tenant_match")
        )
    order = [F.asc("failure_count"), F.desc("success_count"), F.asc_nulls_first("last_used_at"), F.asc("proxy_id")]
    return top_per_key(enabled, ["tenant_id"], order, n)


def batch_outcomes(results: DataFrame, *keys: str) -> DataFrame:
    """Success, failed and skipped counts of batch items and the success rate."""
    return results.groupBy(*keys).agg(
        F.count("*").alias("total"),
        n_if(_is("success")).alias("success"),
        n_if(_is("failed")).alias("failed"),
        n_if(_is("skipped")).alias("skipped"),
    ).withColumn("success_rate", ratio(F.col("success"), F.col("total")))


def alert_levels(alerts: DataFrame) -> DataFrame:
    """Alerts per level."""
    level = F.lower(F.trim("level"))
    return alerts.agg(
        F.count("*").alias("total"),
        n_if(level == "critical").alias("critical"),
        n_if(level == "warning").alias("warning"),
    )


# ---------------------------------------------------------------- customer success


def failure_watch(stats: DataFrame) -> DataFrame:
    return stats.withColumn(
        "failure_rate", ratio(F.col("failed_count"), F.col("total_count"), None)
    ).withColumn(
        "high_failure",
        (F.col("total_count") >= HIGH_FAILURE_RUNS) & (F.col("failure_rate") >= HIGH_FAILURE),
    )


def tenant_alerts(monthly: DataFrame, stats: DataFrame, trend: DataFrame, as_of: Column) -> DataFrame:
    """Near quota, high failure, inactivity and template drops, as one alert table."""

    def percent(rate: Column) -> Column:
        return F.format_string("%.1f%%", rate * 100)

    def alert(kind: str, title: str, severity: Column, template: Column, message: Column, action: str) -> list[Column]:
        return [
            F.col("tenant_id"), F.lit(kind).alias("type"), severity.alias("severity"),
            template.alias("template_id"), F.lit(title).alias("title"), message.alias("message"),
            F.lit(action).alias("recommended_action"),
        ]

    none = F.lit("")
    quota = monthly.where("near_quota").select(*alert(
        "near_quota", "租户接近额度",
        F.when(F.col("max_usage_ratio") < NEAR_QUOTA_DANGER, "warning").otherwise("danger"), none,
        F.concat(F.lit("当前最高额度使用率 "), percent(F.col("max_usage_ratio"))),
        "联系客户确认是否需要扩容、升级套餐或清理无效监控。",
    ))
    failing = failure_watch(stats).where("high_failure").select(*alert(
        "high_failure_rate", "租户失败率偏高", F.lit("danger"), none,
        F.concat(F.lit("失败率 "), percent(F.col("failure_rate")), F.lit("，失败 "), "failed_count", F.lit("/"), "total_count"),
        "优先查看失败自诊断，检查代理池、站点限速、模型配置和模板字段质量。",
    ))
    idle_days = F.date_diff(F.to_date(as_of), F.to_date("last_task_at"))
    idle = stats.where(idle_days >= INACTIVE_DAYS).select(*alert(
        "inactive_tenant", "租户长时间未使用", F.lit("warning"), none,
        F.concat(F.lit("最近 "), idle_days, F.lit(" 天没有新任务")),
        "触达客户确认卡点，推荐从成功模板或监控场景重新激活。",
    ))
    dropping = trend.where("dropped").select(*alert(
        "template_success_rate_drop", "模板成功率下降", F.lit("warning"), F.col("template_id"),
        F.concat(F.lit("近 7 天成功率 "), percent(F.col("recent_rate")), F.lit("，前 7 天 "), percent(F.col("previous_rate"))),
        "检查最近失败原因和字段级反馈，必要时重新标注并修复模板。",
    ))
    return quota.unionByName(failing).unionByName(idle).unionByName(dropping)


def overall_rank(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """K04 and other report heads: the first n rows of a total order."""
    return df.orderBy(*order).limit(n)


def keep_recent(df: DataFrame, keys: list[str], order: list[Column], n: int | None) -> DataFrame:
    """Optional window of the newest n rows per key; None keeps the whole table."""
    if n is None:
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
