"""Field-level change detection between successive successful runs of a URL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.blank import is_blank
from pagetide.functions.urls import extract_domain
from pagetide.operators.ordered import DEFAULT_SPAN, previous_where
from pagetide.operators.runs import payload_fields, typed_runs

BLANK_DISPLAY = "空"
DISPLAY_WIDTH = 72
# Advice lines of the change report.
STABLE_IMPACT = "当前与上一条成功记录相比没有字段变化。"
STABLE_ACTIONS = (
    "当前页面表现稳定，可继续保留在监控名单中。",
    "如果这是关键业务页面，建议补上通知通道，避免后续变化被忽略。",
)
REVIEW_ACTIONS = (
    "先人工复核变化字段，确认这是业务真实变化而不是页面噪声。",
    "如需长期追踪，建议为该页面配置通知通道，把变化直接推送给业务方。",
)
REMOVED_ACTION = "有字段消失，建议检查目标站点是否改版或字段是否被折叠。"
# ---- end of fixed values


def canonical_text(value: Column) -> Column:
    """JSON objects and lists with sorted keys, other texts unchanged; NULL for a blank."""
    looks_nested = value.startswith("{") | value.startswith("[")
    sorted_json = F.to_json(F.try_parse_json(value))
    return F.when(~is_blank(value), F.coalesce(F.when(looks_nested, sorted_json), value))


def display_value(value: Column) -> Column:
    """text shown for a value: 空 when blank, at most 72 characters."""
    text = canonical_text(value)
    return (
        F.when(text.isNull(), F.lit(BLANK_DISPLAY))
        .when(
            F.length(text) > DISPLAY_WIDTH,
            F.concat(F.substring(text, 1, DISPLAY_WIDTH - 3), F.lit("...")),
        )
        .otherwise(text)
    )


def diff_maps(before: Column, after: Column, labels: Column) -> Column:
    """ARRAY<STRUCT<field, label, change_type, before, after, ...>>, sorted by field."""
    keys = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))

    def values(key: Column) -> Column:
        return F.struct(
            key.alias("field"), F.coalesce(F.element_at(labels, key), key).alias("label"),
            F.when(~F.map_contains_key(before, key), "added")
            .when(~F.map_contains_key(after, key), "removed")
            .otherwise("updated")
            .alias("change_type"),
            F.element_at(before, key).alias("before"), F.element_at(after, key).alias("after"),
        )

    def shown(v: Column) -> Column:
        return F.struct(
            *[v[c].alias(c) for c in ("field", "label", "change_type", "before", "after")],
            display_value(v["before"]).alias("before_text"), display_value(v["after"]).alias("after_text"),
        )

    def told(v: Column) -> Column:
        label, old, new = v["label"], v["before_text"], v["after_text"]
        return v.withField(
            "summary",
            F.when(v["change_type"] == "added", F.concat(label, F.lit(" 新增为 "), new))
            .when(v["change_type"] == "removed", F.concat(label, F.lit(" 已移除，之前为 "), old))
            .otherwise(F.concat(label, F.lit(" 从 "), old, F.lit(" 变为 "), new)),
        )

    pairs = F.transform(keys, values)
    differing = F.filter(
        pairs, lambda v: ~canonical_text(v["before"]).eqNullSafe(canonical_text(v["after"]))
    )
    return F.transform(F.transform(differing, shown), told)


def _snapshots(runs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Only what a comparison needs: the run keys and `state`, its field map and labels.

    The raw payload and the parsed document stay behind, so the shuffle carries small rows.
    """
    empty = F.create_map().cast("map<string,string>")
    state = F.struct(
        "run_id", "task_id", "completed_at", payload_fields().alias("fields"),
        F.coalesce("doc.field_labels", empty).alias("labels"),
    )
    return typed_runs(runs).select("tenant_id", "url", "run_id", "status", state.alias("state"), *keep)


def _open_state(df: DataFrame) -> DataFrame:
    return df.select("*", "state.task_id", "state.completed_at", "state.fields", "state.labels").drop("state")


def with_previous_success(runs: DataFrame, span: int = DEFAULT_SPAN, keep: Sequence[str] = ()) -> DataFrame:
    """Every run with `previous`, the latest successful run of its tenant and URL with a
    smaller id.  `keep` names further columns of the typed run to carry along."""
    return _open_state(
        previous_where(
            _snapshots(runs, keep), ["tenant_id", "url"], "run_id",
            F.col("status") == "success", "state", "previous", span,
        )
    )


def compare_with_previous(runs: DataFrame, span: int = DEFAULT_SPAN, keep: Sequence[str] = ()) -> DataFrame:
    """Successful runs with `changes` against the previous success (NULL when there is none).

    Only successes are compared and only successes can be the earlier side, so the others are
    dropped before the shuffle.
    """
    merged = F.map_zip_with("previous.labels", "labels", lambda k, old, new: F.coalesce(new, old))
    rows = _snapshots(runs.where(F.col("status") == "success"), keep)
    return (
        _open_state(previous_where(rows, ["tenant_id", "url"], "run_id", None, "state", "previous", span))
        .withColumn("has_previous", F.col("previous").isNotNull())
        .withColumn(
            "changes",
            F.when(F.col("has_previous"), diff_maps(F.col("previous.fields"), F.col("fields"), merged)),
        )
        .withColumn("changed_count", F.greatest(F.size("changes"), F.lit(0)))
    )


def explode_changes(compared: DataFrame) -> DataFrame:
    """The change feed: one row per changed field."""
    return compared.select(
        "tenant_id", "url", "run_id", "task_id",
        F.col("previous.run_id").alias("previous_run_id"),
        F.explode("changes").alias("c"),
    ).select("*", "c.*").drop("c")


def _labels_of(kind: str) -> Column:
    return F.transform(
        F.filter("changes", lambda c: c["change_type"] == kind), lambda c: c["label"]
    )


def _listed(prefix: str, labels: Column, suffix: str = "") -> Column:
    return F.when(
        F.size(labels) > 0,
        F.concat(F.lit(prefix), F.array_join(labels, "、"), F.lit(suffix)),
    )


def severity(changed_count: Column) -> Column:
    """C03."""
    return F.when(changed_count >= 4, "high").when(changed_count >= 2, "medium").otherwise("low")


def change_summary(compared: DataFrame) -> DataFrame:
    """C02 + C03: counts by kind, impact text, suggested actions and severity of each comparison."""
    updated, added, removed = (_labels_of(k) for k in ("updated", "added", "removed"))
    impact = F.concat_ws(
        "；",
        _listed("主要变动集中在 ", updated),
        _listed("新增字段 ", added),
        _listed("消失字段 ", removed),
    )
    actions = F.array_compact(
        F.array(
            _listed("优先核对 ", updated, " 这些核心字段是否影响当前判断。"),
            *[F.lit(a) for a in REVIEW_ACTIONS],
            F.when(F.size(removed) > 0, F.lit(REMOVED_ACTION)),
        )
    )
    changed = F.col("changed_count") > 0
    return compared.select(
        "tenant_id", "url", extract_domain(F.col("url")).alias("domain"), "run_id", "task_id",
        F.col("previous.task_id").alias("previous_task_id"),
        "changed_count",
        F.greatest(F.size(added), F.lit(0)).alias("added"),
        F.greatest(F.size(removed), F.lit(0)).alias("removed"),
        F.greatest(F.size(updated), F.lit(0)).alias("updated"),
        F.when(changed, impact).when(F.col("has_previous"), F.lit(STABLE_IMPACT)).otherwise("").alias("impact_summary"),
        F.when(changed, actions)
        .when(F.col("has_previous"), F.array(*[F.lit(a) for a in STABLE_ACTIONS]))
        .otherwise(F.array().cast("array<string>"))
        .alias("suggested_actions"),
        F.transform(F.coalesce("changes", F.array()), lambda c: c["summary"]).alias("summary_lines"),
        F.when(changed, severity(F.col("changed_count"))).alias("severity"),
    )


def monitor_results(runs: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Latest run of each monitor with its alert level: changed, stable or error."""
    compared = compare_with_previous(runs, span).select(
        "run_id", "changed_count", F.col("changes").alias("changed_fields")
    )
    monitored = typed_runs(runs).select(
        "tenant_id", F.col("doc._execution_context.monitor_id").alias("monitor_id"), "run_id",
        "task_id", "url", "status", "error", F.col("doc.extraction_strategy").alias("strategy"),
        F.col("doc.learned_profile_id").alias("profile_id"),
    ).where((F.coalesce("monitor_id", F.lit("")) != "") & F.col("status").isin("success", "failed"))
    latest = monitored.groupBy("tenant_id", "monitor_id").agg(
        F.max_by(F.struct(*[c for c in monitored.columns if c not in ("tenant_id", "monitor_id")]), "run_id").alias("r")
    ).select("tenant_id", "monitor_id", "r.*")
    changed = F.coalesce("changed_count", F.lit(0)) > 0
    return latest.join(compared, "run_id", "left").select(
        "tenant_id", "monitor_id", "task_id", "run_id", "url", "status", "strategy", "profile_id",
        F.when(F.col("status") != "success", "error")
        .when(changed, "changed")
        .otherwise("stable")
        .alias("alert_level"),
        F.when(F.col("status") != "success", F.coalesce(F.when(F.col("error") != "", F.col("error")), F.lit("监控任务失败")))
        .when(changed, F.concat(F.lit("检测到 "), "changed_count", F.lit(" 个字段变化")))
        .otherwise(F.lit("本次检查未发现字段变化"))
        .alias("alert_message"),
        F.coalesce("changed_count", F.lit(0)).alias("changed_count"),
        "changed_fields",
    )
