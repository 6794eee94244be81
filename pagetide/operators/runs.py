"""Typed run history: parse the JSON payload of each run once, then derive columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.blank import (
    count_filled,
    drop_blank_entries,
    first_text,
    is_blank,
    is_blank_array,
    truthy,
)
from pagetide.functions.classify import (
    failure_diagnosis,
    result_bucket,
    run_failure_category,
)

# Shape of `data_json`.  Nested values of `data` arrive as JSON text.
RUN_DOCUMENT = """
    page_type STRING, data MAP<STRING,STRING>, selected_fields ARRAY<STRING>,
    candidate_fields ARRAY<STRING>, field_labels MAP<STRING,STRING>, formatted_text STRING,
    extraction_strategy STRING, learned_profile_id STRING, failure_category STRING, error STRING,
    strategy_details STRUCT<source_fields: MAP<STRING,STRING>, normalization_version: STRING,
        llm_rescue_trigger: STRING, rule_hint_strategy: STRING,
        llm_completion_attempted: STRING, llm_completion_fallback: STRING>,
    _validation STRUCT<status: STRING, is_valid: BOOLEAN, errors: ARRAY<STRING>,
        warnings: ARRAY<STRING>, missing_fields: ARRAY<STRING>, completeness_score: DOUBLE,
        quality_score: DOUBLE>,
    _llm_usage STRUCT<total_calls: BIGINT, prompt_tokens: BIGINT, completion_tokens: BIGINT,
        total_tokens: BIGINT, estimated_cost_usd: DOUBLE, api_usage_calls: BIGINT,
        estimated_usage_calls: BIGINT, api_usage_ratio: DOUBLE>,
    _extractor_stats STRUCT<total_calls: BIGINT, prompt_tokens: BIGINT, completion_tokens: BIGINT,
        total_tokens: BIGINT, estimated_cost_usd: DOUBLE, api_usage_calls: BIGINT,
        estimated_usage_calls: BIGINT>,
    _runtime_metrics STRUCT<fetcher_type: STRING, fetch_elapsed_ms: DOUBLE,
        playwright_elapsed_ms: DOUBLE, retry_count: BIGINT, retry_cost_usd: DOUBLE,
        total_elapsed_ms: DOUBLE, error_type: STRING, content_ready: STRING,
        failure_reason: STRING, failure_stage: STRING, raw_error: STRING, http_status: BIGINT,
        final_url: STRING, body_size: BIGINT, shell_markers: ARRAY<STRING>,
        preflight_type_mismatch: STRING, fetch_json_response_count: BIGINT,
        mobile_ua_fallback: STRING, static_html_length: BIGINT, dynamic_html_length: BIGINT>,
    _execution_context STRUCT<template_id: STRING, monitor_id: STRING, proxy_pool_size: BIGINT>
"""
# Top-level keys of a run payload that are never extracted fields.
PAYLOAD_KEYS = ("formatted_text", "candidate_fields", "selected_fields", "field_labels")
BOOKKEEPING_KEYS = (
    "_extractor_stats", "_llm_usage", "_runtime_metrics", "_execution_context",
    "selected_fields", "field_labels",
)


def typed_runs(runs: DataFrame) -> DataFrame:
    """Parse `data_json` once into `doc` (struct) and `entries` (the field map as stored).

    A table that is already typed passes through, so the result can be stored and given to any
    operator that takes runs.
    """
    if "doc" in runs.columns:
        return runs
    doc = F.from_json("data_json", RUN_DOCUMENT)
    flat = F.from_json("data_json", "MAP<STRING,STRING>")
    return runs.withColumn("doc", doc).withColumn(
        "entries",
        F.coalesce(
            F.col("doc.data"),
            F.when(F.length("data_json") > 2, flat),
            F.create_map().cast("map<string,string>"),
        ),
    )


def payload_fields() -> Column:
    """The nested `data` map as is; otherwise the flat payload without bookkeeping and blanks."""
    flat = F.map_filter("entries", lambda k, v: ~k.isin(*PAYLOAD_KEYS) & ~is_blank(v))
    return F.when(F.col("doc.data").isNotNull(), F.col("entries")).otherwise(flat)


def project_fields(entries: Column, selected: Column) -> Column:
    """The selected, filled fields as ARRAY<STRUCT<field, value>>, in selection order."""
    pairs = F.transform(
        selected, lambda n: F.struct(n.alias("field"), F.element_at(entries, n).alias("value"))
    )
    return F.filter(pairs, lambda p: ~is_blank(p["value"]))


# ---------------------------------------------------------------- filters


def for_tenant(df: DataFrame, tenant_id: str | None) -> DataFrame:
    """Keep one tenant; None or '*' keeps all."""
    return df if tenant_id in (None, "", "*") else df.where(F.col("tenant_id") == tenant_id)


def root_runs(runs: DataFrame, tenant_id: str | None = None, batch_group_id: str = "") -> DataFrame:
    """Runs that are not children of a batch."""
    roots = for_tenant(runs, tenant_id).where(F.col("parent_task_id") == "")
    return roots.where(F.col("batch_group_id") == batch_group_id) if batch_group_id else roots


def batch_children(runs: DataFrame, parent_task_id: str, tenant_id: str | None = None) -> DataFrame:
    """Children of one batch, oldest first."""
    return (
        for_tenant(runs, tenant_id)
        .where(F.col("parent_task_id") == parent_task_id)
        .orderBy("run_id")
    )


def latest_runs(runs: DataFrame, n: int, tenant_id: str | None = None) -> DataFrame:
    """Newest root runs."""
    return root_runs(runs, tenant_id).orderBy(F.desc("run_id")).limit(n)


def runs_for_url(runs: DataFrame, url: str, tenant_id: str | None = None) -> DataFrame:
    """Every run of a URL."""
    return for_tenant(runs, tenant_id).where(F.col("url") == url)


def runs_for_profile(typed: DataFrame, profile_id: str, tenant_id: str | None = None) -> DataFrame:
    """Root runs produced by one learned profile, from the typed payload."""
    return root_runs(typed, tenant_id).where(F.trim("doc.learned_profile_id") == profile_id)


def in_month(when: Column, as_of: Column) -> Column:
    """Half-open calendar-month window around `as_of`."""
    start = F.date_trunc("month", as_of)
    return (when >= start) & (when < F.add_months(start, 1))


def on_day(when: Column, as_of: Column) -> Column:
    """Same calendar day as `as_of`."""
    start = F.date_trunc("day", as_of)
    return (when >= start) & (when < start + F.expr("INTERVAL 1 DAY"))


# ---------------------------------------------------------------- per-run columns


def _selected() -> Column:
    own = F.col("doc.selected_fields")
    keys = F.filter(F.map_keys("entries"), lambda k: ~k.startswith("_"))
    return F.when(is_blank_array(own), keys).otherwise(own)


def field_valid_score() -> Column:
    """validation completeness in 0..1, else filled/selected, else -1."""
    selected = _selected()
    completeness = F.col("doc._validation.completeness_score")
    share = count_filled(F.col("entries"), selected) / F.greatest(F.size(selected), F.lit(1))
    return (
        F.when(completeness.isNotNull(), F.least(F.greatest(completeness, F.lit(0.0)), F.lit(1.0)))
        .when(is_blank_array(selected), F.lit(-1.0))
        .otherwise(share)
    )


def rescue_attempted() -> Column:
    """a model was asked to repair or complete the rule result."""
    d = F.col("doc.strategy_details")
    return (
        truthy(d["llm_rescue_trigger"])
        | truthy(d["rule_hint_strategy"])
        | truthy(d["llm_completion_attempted"])
    )


def rescue_succeeded() -> Column:
    return (
        rescue_attempted()
        & (F.lower(F.trim("status")) == "success")
        & ~truthy(F.col("doc.strategy_details.llm_completion_fallback"))
    )


def _countable_entries() -> Column:
    return F.map_filter(
        "entries", lambda k, v: ~k.isin(*BOOKKEEPING_KEYS) & ~k.startswith("_")
    )


def field_counts() -> Column:
    """STRUCT<total, filled, empty> over the extracted fields."""
    fields = _countable_entries()
    total = F.size(fields)
    filled = F.size(drop_blank_entries(fields))
    return F.struct(
        total.cast("long").alias("total"),
        filled.cast("long").alias("filled"),
        (total - filled).cast("long").alias("empty"),
    )


def with_observability(typed: DataFrame) -> DataFrame:
    """`usage` and `runtime` structs with defaults; usage falls back to the extractor counters."""
    usage, stats = F.col("doc._llm_usage"), F.col("doc._extractor_stats")
    run = F.col("doc._runtime_metrics")

    def counter(name: str, kind: str = "long") -> Column:
        return F.coalesce(usage[name], stats[name], F.lit(0)).cast(kind).alias(name)

    def own(struct: Column, name: str, kind: str) -> Column:
        return F.coalesce(struct[name], F.lit(0)).cast(kind).alias(name)

    error_head = F.trim(F.substring_index(F.coalesce("error", F.lit("")), ":", 1))
    return typed.withColumn(
        "usage",
        F.struct(
            *[counter(n) for n in ("total_calls", "prompt_tokens", "completion_tokens", "total_tokens")],
            counter("estimated_cost_usd", "double"),
            own(usage, "api_usage_calls", "long"),
            own(usage, "estimated_usage_calls", "long"),
            own(usage, "api_usage_ratio", "double"),
        ),
    ).withColumn(
        "runtime",
        F.struct(
            F.when(is_blank(F.trim(run["fetcher_type"])), "unknown")
            .otherwise(F.trim(run["fetcher_type"]))
            .alias("fetcher_type"),
            own(run, "fetch_elapsed_ms", "double"),
            own(run, "playwright_elapsed_ms", "double"),
            own(run, "retry_count", "long"),
            own(run, "retry_cost_usd", "double"),
            F.coalesce(run["total_elapsed_ms"], "elapsed_ms", F.lit(0.0)).alias("total_elapsed_ms"),
            F.trim("status").alias("status"),
            first_text(F.trim(run["error_type"]), error_head).alias("error_type"),
            truthy(run["content_ready"]).alias("content_ready"),
        ),
    )


def diagnostic_text() -> Column:
    """All failure evidence of a run in one text, for the rule classifiers."""
    run = F.col("doc._runtime_metrics")
    return F.concat_ws(
        " ",
        "error",
        "doc.failure_category",
        run["failure_reason"],
        run["failure_stage"],
        run["raw_error"],
        F.concat(F.lit("http_status="), run["http_status"]),
        F.concat(F.lit("final_url="), run["final_url"]),
        F.concat(F.lit("body_size="), run["body_size"]),
        F.array_join(run["shell_markers"], " "),
        run["preflight_type_mismatch"],
    )


def bucket() -> Column:
    """F23 for a typed run."""
    text = F.concat_ws(
        " ",
        "error",
        "doc.error",
        "doc.failure_category",
        "doc._validation.status",
        F.array_join("doc._validation.errors", " "),
    )
    return result_bucket(F.col("status"), F.col("doc._validation.status"), text)


def diagnosis() -> Column:
    """F22 for a typed run."""
    selected = F.filter(
        F.coalesce("doc.selected_fields", F.array().cast("array<string>")), lambda n: F.trim(n) != ""
    )
    missing = F.size(selected) - count_filled(F.col("entries"), selected)
    return failure_diagnosis(F.col("status"), F.col("error"), missing)


def validation_summary() -> Column:
    """STRUCT summary of the stored validation block, with defaults for a run that has none."""
    v = F.col("doc._validation")
    none = F.array().cast("array<string>")
    selected = F.filter(F.coalesce("doc.selected_fields", none), lambda n: F.trim(n) != "")
    shown = lambda items: F.filter(F.coalesce(items, none), lambda t: F.trim(t) != "")
    missing = F.filter(selected, lambda n: is_blank(F.element_at("entries", n)))
    return F.struct(
        F.trim(F.coalesce(v["status"], F.lit(""))).alias("status"),
        F.coalesce(v["is_valid"], F.lit(True)).alias("is_valid"),
        F.coalesce(v["completeness_score"], F.lit(0.0)).alias("completeness"),
        F.coalesce(v["quality_score"], F.lit(0.0)).alias("quality"),
        shown(v["warnings"]).alias("warnings"),
        shown(v["errors"]).alias("errors"),
        missing.alias("missing_fields"),
    )


def run_metrics(typed: DataFrame) -> DataFrame:
    """one wide row per run.  Only failed runs get a failure category."""
    df = with_observability(typed).withColumn("counts", field_counts())
    context = F.col("doc._execution_context")
    text = lambda c: F.coalesce(c, F.lit(""))
    return df.select(
        "run_id", "tenant_id", "task_id", "status", "schema_name",
        text(F.col("doc.page_type")).alias("page_type"),
        text(context["monitor_id"]).alias("monitor_id"),
        text(context["template_id"]).alias("template_id"),
        F.when(F.col("status") == "failed", run_failure_category(diagnostic_text())).alias("failure_category"),
        F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"),
        F.col("counts.total").alias("field_count"),
        F.col("counts.filled").alias("filled_field_count"),
        F.col("counts.empty").alias("empty_field_count"),
        "usage.total_tokens", "usage.prompt_tokens", "usage.completion_tokens", "usage.estimated_cost_usd",
        text(F.col("doc._runtime_metrics.fetcher_type")).alias("fetcher_type"),
        "runtime.fetch_elapsed_ms", "runtime.playwright_elapsed_ms", "runtime.retry_count",
        F.coalesce(context["proxy_pool_size"], F.lit(0)).alias("proxy_pool_size"),
        F.coalesce("elapsed_ms", F.lit(0.0)).alias("elapsed_ms"),
        F.col("created_at").alias("updated_at"),
    )
