"""Learned profiles: matching, counters, risk and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.blank import count_filled, is_blank, ratio
from pagetide.functions.classify import feedback_status
from pagetide.functions.labels import field_label
from pagetide.functions.urls import extract_domain, netloc, path_prefix
from pagetide.operators.extract import completeness_of
from pagetide.operators.kpi import n_if

# ---- Fixed values
SAME_PREFIX, OTHER_PREFIX, OVERLAP_WEIGHT, MIN_OVERLAP = 1.0, 0.4, 2.0, 0.5
HIGH_RISK_COMPLETENESS, MEDIUM_RISK_COMPLETENESS = 0.35, 0.6
KEEP_FILLED, KEEP_COMPLETENESS, REPAIRED_COMPLETENESS = 2, 0.6, 0.8
RISK_ACTIONS = {
    "paused": "暂不参与规则复用；确认页面结构稳定后再恢复",
    "reason": "先复核停用原因，再决定是否重新启用",
    "disable": "建议先停用这条学习档案，避免低质量规则继续命中",
    "relearn": "对最近命中的页面重新执行一次 LLM 学习，刷新字段方案",
    "narrow": "优先缩小字段范围，只保留稳定且业务关键的字段",
    "drift": "建议观察最近命中页面，确认是否出现局部结构漂移",
    "complete": "建议补充或精简字段集合，提升规则命中完整度",
    "repeat": "建议先用相同站点多跑几次，确认这条档案是否值得继续沉淀",
    "steady": "保持当前规则复用策略，继续观察命中质量即可",
}
# ---- end of fixed values


def hostname(url: Column) -> Column:
    """Lower-cased host without credentials and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), "^.*@", ""), r":\d*$", ""))


def overlapping(wishes: DataFrame, offers: DataFrame, place: list[str]) -> DataFrame:
    """Pairs of wishes (place, _wanted) and offers (place, _plan, ...) of one place where the plan has at least
    MIN_OVERLAP of the wanted fields, with `_overlap`; both sides distinct, wishes not empty.

    A plan that shares t of a wish's n fields has one of any n - t + 1 of them. So a wish is looked up by its n - t + 1
    rarest fields only, rarest among the plans of the place, in an index of the plans by field. A pair is made at the
    first of these fields that the plan has, and only if the overlap is enough: no other pair leaves the join.
    """
    index = offers.withColumn("_field", F.explode(F.array_distinct("_plan")))
    held = index.groupBy(*place, "_field").agg(F.count("*").alias("_held"))
    asked = wishes.withColumn("_field", F.explode("_wanted")).join(held, [*place, "_field"], "left")
    rarest = asked.groupBy(*place, "_wanted").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_held", F.lit(0)).alias("n"), F.col("_field").alias("f")))).alias("_rare"))
    n = F.size("_wanted")
    first = F.slice(F.transform("_rare", lambda r: r["f"]), F.lit(1), n - F.ceil(n * MIN_OVERLAP).cast("int") + 1)
    looked_up = rarest.select(*place, "_wanted", first.alias("_first")).withColumn("_field", F.explode("_first"))
    w, o = looked_up.alias("w"), index.alias("o")
    overlap = F.size(F.array_intersect("w._wanted", "o._plan")) / F.size("w._wanted")
    once = F.expr("get(filter(w._first, f -> array_contains(o._plan, f)), 0) = w._field")
    same = [F.col(f"w.{c}") == F.col(f"o.{c}") for c in [*place, "_field"]]
    on = same[0]
    for test in [*same[1:], once, overlap >= MIN_OVERLAP]:
        on = on & test
    others = [F.col(f"o.{c}") for c in offers.columns if c not in place]
    return w.join(o, on).select(*[F.col(f"w.{c}") for c in [*place, "_wanted"]], *others, overlap.alias("_overlap"))


def match_profiles(urls: DataFrame, profiles: DataFrame, include_inactive: bool = False) -> DataFrame:
    """The best profile for each (url, selected_fields), as `profile_id` and `match_score`.

    A profile scores by its field overlap and by an equal path prefix.  The two are settled apart:
    the best profile of the same prefix per (host, prefix, wanted fields), and the best of the host
    whatever its prefix per (host, wanted fields).  Both sides of both joins are reduced to distinct
    keys first, so a hot host meets its field plans with its distinct wishes, not with its pages, and
    the wishes meet plans that share enough fields only (`overlapping`).
    """
    wanted = F.array_sort(
        F.array_distinct(F.filter(F.coalesce("selected_fields", F.array().cast("array<string>")), lambda f: F.trim(f) != ""))
    )
    keyed = (
        urls.withColumn("_host", hostname(F.col("url")))
        .withColumn("_prefix", path_prefix(F.col("url")))
        .withColumn("_wanted", wanted)
    )
    live = profiles if include_inactive else profiles.where("is_active")
    plans = live.select(
        F.col("domain").alias("_host"), F.col("path_prefix").alias("_prefix"),
        F.array_sort("selected_fields").alias("_plan"), "profile_id",
    )

    def best(place: list[str], bonus: float, into: str) -> DataFrame:
        wishes = keyed.where(F.col("_host") != "").select(*place, "_wanted").distinct()
        offers = plans.groupBy(*place, "_plan").agg(F.min("profile_id").alias("profile_id"))
        # A wish without fields is met by every plan: only the first profile of the place counts.
        any_plan = wishes.where(F.size("_wanted") == 0).join(offers.groupBy(*place).agg(F.min("profile_id").alias("profile_id")), place)
        scored = (
            overlapping(wishes.where(F.size("_wanted") > 0), offers, place).select(*place, "_wanted", "profile_id", "_overlap")
            .unionByName(any_plan.select(*place, "_wanted", "profile_id", F.lit(1.0).alias("_overlap")))
            .withColumn("score", F.col("_overlap") * OVERLAP_WEIGHT + bonus)
        )
        # Highest score, then the smallest id.
        first = F.min(F.struct((-F.col("score")).alias("s"), "profile_id"))
        return scored.groupBy(*place, "_wanted").agg(first.alias("_f")).select(
            *place, "_wanted", F.struct((-F.col("_f.s")).alias("score"), F.col("_f.profile_id").alias("profile_id")).alias(into)
        )

    near = best(["_host", "_prefix"], SAME_PREFIX, "_near")
    far = best(["_host"], OTHER_PREFIX, "_far")
    pick = (
        F.when(F.col("_near").isNull(), F.col("_far"))
        .when(F.col("_far").isNull() | (F.col("_near.score") > F.col("_far.score")), F.col("_near"))
        .when(F.col("_near.score") < F.col("_far.score"), F.col("_far"))
        .when(F.col("_near.profile_id") <= F.col("_far.profile_id"), F.col("_near"))
        .otherwise(F.col("_far"))
    )
    return (
        keyed.join(near, ["_host", "_prefix", "_wanted"], "left")
        .join(far, ["_host", "_wanted"], "left")
        .withColumn("_best", pick)
        .withColumn("profile_id", F.col("_best.profile_id"))
        .withColumn("match_score", F.col("_best.score"))
        .drop("_host", "_prefix", "_wanted", "_near", "_far", "_best")
    )


def risk_level() -> Column:
    """Paused, high, medium or low, from the counters of a profile row."""
    failures, wins, complete = (
        F.coalesce("rule_failure_count", F.lit(0)), F.coalesce("rule_success_count", F.lit(0)),
        F.coalesce("last_completeness", F.lit(0.0)),
    )
    return (
        F.when(~F.coalesce("is_active", F.lit(True)), "paused")
        .when((failures >= F.greatest(F.lit(2), wins + 1)) | (complete < HIGH_RISK_COMPLETENESS), "high")
        .when((failures > 0) | (complete < MEDIUM_RISK_COMPLETENESS), "medium")
        .otherwise("low")
    )


def risk_actions(disabled_reason: Column | None = None) -> Column:
    """Recommended actions of a profile row that has `risk_level`; a paused one with a reason is told to look at it."""
    say = lambda condition, name: F.when(condition, RISK_ACTIONS[name])
    reason = F.lit(None).cast("string") if disabled_reason is None else say(F.trim(disabled_reason) != "", "reason")
    level = F.col("risk_level")
    watch = F.array_compact(
        F.array(
            say(F.coalesce("rule_failure_count", F.lit(0)) > 0, "drift"),
            say(F.coalesce("last_completeness", F.lit(0.0)) < MEDIUM_RISK_COMPLETENESS, "complete"),
            say(F.coalesce("rule_success_count", F.lit(0)) == 0, "repeat"),
        )
    )
    high = F.array_compact(
        F.array(F.lit(RISK_ACTIONS["disable"]), F.lit(RISK_ACTIONS["relearn"]), say(F.size("selected_fields") >= 4, "narrow"))
    )
    return (
        F.when(level == "paused", F.array_compact(F.array(F.lit(RISK_ACTIONS["paused"]), reason)))
        .when(level == "high", high)
        .when(F.size(watch) > 0, watch)
        .otherwise(F.array(F.lit(RISK_ACTIONS["steady"])))
    )


def stability_rate() -> Column:
    """Share of successful rule runs, 0 without any."""
    wins, losses = F.coalesce("rule_success_count", F.lit(0)), F.coalesce("rule_failure_count", F.lit(0))
    return ratio(wins, wins + losses)


def memory_strength() -> Column:
    """Paused, strong, warming or learning."""
    wins, losses = F.coalesce("rule_success_count", F.lit(0)), F.coalesce("rule_failure_count", F.lit(0))
    rate = ratio(wins, wins + losses, None)
    return (
        F.when(~F.coalesce("is_active", F.lit(True)), "paused")
        .when((wins >= 8) & (rate >= 0.8), "strong")
        .when((wins >= 3) & (rate >= 0.6), "warming")
        .otherwise("learning")
    )


def risky_active(profiles: DataFrame) -> DataFrame:
    """P11."""
    return profiles.where(F.col("is_active") & (risk_level() == "high"))


def profile_stats(profiles: DataFrame) -> DataFrame:
    """A25."""
    return profiles.agg(
        F.count("*").alias("total_profiles"),
        n_if(F.col("is_active")).alias("active_profiles"),
        n_if(~F.col("is_active")).alias("disabled_profiles"),
        n_if(F.col("rule_success_count") > 0).alias("rule_success_profiles"),
        n_if(F.col("llm_success_count") > 0).alias("llm_learned_profiles"),
    )


def profile_counters(attempts: DataFrame) -> DataFrame:
    """Counters of each profile rebuilt from its attempts.

    `attempts`: profile_id, attempt_id, strategy, success, completeness, url, attempted_at.
    """
    strategy = F.lower(F.trim("strategy"))
    rule = strategy.startswith("rule")
    last = F.struct("attempted_at", "attempt_id")
    return attempts.groupBy("profile_id").agg(
        n_if(strategy.startswith("llm") & F.col("success")).alias("llm_success_count"),
        n_if(rule & F.col("success")).alias("rule_success_count"),
        n_if(rule & ~F.col("success")).alias("rule_failure_count"),
        F.max_by(F.when(rule & ~F.col("success"), "rule_fallback").otherwise(F.col("strategy")), last).alias("last_strategy"),
        F.max_by("completeness", last).alias("last_completeness"),
        F.max_by("url", last).alias("last_matched_url"),
        F.max("attempted_at").alias("last_used_at"),
    )


def ranked_profiles(profiles: DataFrame, n: int = 20) -> DataFrame:
    """K09."""
    return profiles.orderBy(
        F.desc("is_active"), F.desc("rule_success_count"), F.desc("llm_success_count"), "updated_at", "profile_id"
    ).limit(n)


def with_monitor_hits(profiles: DataFrame, monitors: DataFrame) -> DataFrame:
    """How many monitors last used each profile."""
    hits = (
        monitors.where(F.trim("last_learned_profile_id") != "")
        .groupBy(F.trim("last_learned_profile_id").alias("profile_id"))
        .agg(F.count("*").alias("monitor_hits"))
    )
    return profiles.join(hits, "profile_id", "left").na.fill(0, ["monitor_hits"])


def profile_activity(typed: DataFrame, compared: DataFrame, monitors: DataFrame) -> DataFrame:
    """Runs by strategy, changed runs and linked monitors of each profile."""
    strategy = F.trim("doc.extraction_strategy")
    runs = typed.where((F.trim("doc.learned_profile_id") != "") & (F.col("parent_task_id") == "")).select(
        "tenant_id", F.trim("doc.learned_profile_id").alias("profile_id"), "run_id", strategy.alias("strategy")
    )
    changed = compared.where(F.col("changed_count") > 0).select("run_id", F.lit(True).alias("changed"))
    hits = runs.join(changed, "run_id", "left").groupBy("tenant_id", "profile_id").agg(
        F.count("*").alias("task_hits"),
        n_if(F.col("strategy") == "rule").alias("rule_hits"),
        n_if(F.col("strategy") == "llm").alias("llm_hits"),
        n_if(F.col("strategy") == "fallback").alias("fallback_hits"),
        n_if(F.col("changed")).alias("changed_hits"),
    )
    links = monitors.groupBy("tenant_id", F.col("last_learned_profile_id").alias("profile_id")).agg(
        F.count("*").alias("monitor_links")
    )
    return hits.join(links, ["tenant_id", "profile_id"], "left").na.fill(0, ["monitor_links"])


def worth_keeping(data: Column, selected: Column, strategy: Column) -> Column:
    """A result good enough to become or update a profile."""
    name = F.lower(F.trim(F.coalesce(strategy, F.lit(""))))
    return (
        ~name.isin("", "fallback")
        & (count_filled(data, selected) >= KEEP_FILLED)
        & (completeness_of(data, selected) >= KEEP_COMPLETENESS)
    )


def learn_profiles(results: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profile rows after the results: matched profiles updated, new (host, prefix, fields) plans added.

    `results`: result_id, url, page_type, selected_fields, data, strategy, finished_at.
    """
    good = results.where(worth_keeping(F.col("data"), F.col("selected_fields"), F.col("strategy")))
    matched = match_profiles(good, profiles, include_inactive=True)
    plan = F.array_join(F.array_sort(F.array_distinct("selected_fields")), ",")
    own_key = F.concat(F.lit("lp-"), F.sha2(F.concat_ws("|", hostname(F.col("url")), path_prefix(F.col("url")), plan), 256))
    last = F.struct("finished_at", "result_id")
    name = F.lower(F.trim("strategy"))
    fresh = (
        matched.withColumn("profile_id", F.coalesce("profile_id", own_key))
        .groupBy("profile_id")
        .agg(
            F.max_by(
                F.struct(
                    hostname(F.col("url")).alias("domain"), path_prefix(F.col("url")).alias("path_prefix"), "page_type", "selected_fields",
                    F.col("strategy").alias("last_strategy"), completeness_of(F.col("data"), F.col("selected_fields")).alias("last_completeness"),
                    F.col("finished_at").alias("updated_at"),
                ), last,
            ).alias("new"),
            n_if(name.startswith("llm")).alias("llm_added"),
            n_if(name.startswith("rule")).alias("rule_added"),
        )
    )
    old = profiles.select(
        "profile_id",
        F.struct(*[c for c in ("domain", "path_prefix", "page_type", "selected_fields", "llm_success_count", "rule_success_count", "rule_failure_count", "last_completeness", "is_active", "updated_at")]).alias("old"),
    )
    pick = lambda c: F.coalesce("new." + c, "old." + c).alias(c)
    added = lambda old_name, more: (F.coalesce("old." + old_name, F.lit(0)) + F.coalesce(more, F.lit(0))).cast("long").alias(old_name)
    return fresh.join(old, "profile_id", "full_outer").select(
        "profile_id", F.coalesce("old.domain", "new.domain").alias("domain"), pick("path_prefix"), pick("page_type"), pick("selected_fields"),
        added("llm_success_count", "llm_added"), added("rule_success_count", "rule_added"),
        F.coalesce("old.rule_failure_count", F.lit(0)).cast("long").alias("rule_failure_count"),
        pick("last_completeness"), F.coalesce("old.is_active", F.lit(True)).alias("is_active"), pick("updated_at"),
    )


# ---------------------------------------------------------------- human feedback


def explode_feedback(annotations: DataFrame, typed: DataFrame) -> DataFrame:
    """One row per annotated field with its status, original and corrected value.

    `annotations`: annotation_id, tenant_id, task_id, template_id, field_feedback MAP, corrected MAP, created_at.
    """
    marks = annotations.select(
        "annotation_id", "tenant_id", "task_id", "template_id", "corrected", "created_at",
        F.explode("field_feedback").alias("field_name", "raw_status"),
    ).where(F.trim("field_name") != "")
    runs = typed.select("tenant_id", "task_id", "url", "entries", F.col("doc.learned_profile_id").alias("profile_id"))
    return marks.join(runs, ["tenant_id", "task_id"]).select(
        "annotation_id", "tenant_id", "task_id", "template_id", "profile_id",
        extract_domain(F.col("url")).alias("site_domain"),
        F.trim("field_name").alias("field_name"), feedback_status(F.col("raw_status")).alias("feedback_status"),
        F.element_at("entries", F.trim("field_name")).alias("original_value"),
        F.element_at("corrected", F.trim("field_name")).alias("corrected_value"), "created_at",
    )


def repair_suggestions(annotations: DataFrame, typed: DataFrame) -> DataFrame:
    """Suggested fields and labels of each annotation: corrected keys, else the run's selection."""
    empty = F.create_map().cast("map<string,string>")
    runs = typed.select(
        "tenant_id", "task_id", "url", F.col("doc.selected_fields").alias("selected_fields"),
        F.coalesce("doc.field_labels", empty).alias("labels"), F.col("doc.learned_profile_id").alias("profile_id"),
    )
    rows = annotations.join(runs, ["tenant_id", "task_id"]).withColumn(
        "suggested_fields",
        F.when(F.size("corrected") > 0, F.array_sort(F.map_keys("corrected"))).otherwise(
            F.filter(F.coalesce("selected_fields", F.array().cast("array<string>")), lambda f: ~is_blank(F.trim(f)))
        ),
    )
    return rows.select(
        "annotation_id", "tenant_id", "task_id", "template_id", "profile_id", "url", "suggested_fields",
        F.transform("suggested_fields", lambda f: field_label(f, F.col("labels"))).alias("suggested_labels"),
        F.when(F.col("apply_auto_repair"), "applied").otherwise("suggested").alias("status"), "created_at",
    )


def apply_repairs(profiles: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Profiles after their latest suggestion; an applied repair resets failures and reactivates."""
    latest = (
        suggestions.where(F.coalesce("profile_id", F.lit("")) != "")
        .groupBy("profile_id")
        .agg(
            F.max_by(F.struct("suggested_fields", "url", "status"), F.struct("created_at", "annotation_id")).alias("s"),
            n_if(F.col("status") == "applied").alias("repairs"),
            F.count("*").alias("annotations"),
        )
    )
    repaired = F.coalesce(F.col("repairs") > 0, F.lit(False))
    return (
        profiles.join(latest, "profile_id", "left")
        .withColumn("selected_fields", F.when(F.size("s.suggested_fields") > 0, F.col("s.suggested_fields")).otherwise(F.col("selected_fields")))
        .withColumn("path_prefix", F.coalesce(path_prefix(F.col("s.url")), "path_prefix") if "path_prefix" in profiles.columns else F.lit("/"))
        .withColumn("rule_failure_count", F.when(repaired, 0).otherwise(F.col("rule_failure_count")))
        .withColumn("last_completeness", F.when(repaired, F.greatest("last_completeness", F.lit(REPAIRED_COMPLETENESS))).otherwise(F.col("last_completeness")))
        .withColumn("is_active", F.col("is_active") | repaired)
        .withColumn("manual_annotation_count", F.coalesce("annotations", F.lit(0)))
        .withColumn("auto_repair_count", F.coalesce("repairs", F.lit(0)))
        .drop("s", "repairs", "annotations")
    )
