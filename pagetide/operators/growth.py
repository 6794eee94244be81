"""Run detail and growth drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.urls import extract_domain
from pagetide.operators.kpi import url_history
from pagetide.operators.ordered import top_per_key
from pagetide.operators.runs import bucket, diagnosis

# ---- Fixed values: per scene the page types, field names and label words that point to it
SCENES = {
    "product": (
        ("product", "sku", "commodity", "goods"),
        ("name", "title", "price", "brand", "availability", "stock", "promotion", "description"),
        ("商品", "价格", "库存", "品牌", "促销", "售价", "规格"),
    ),
    "job": (
        ("job", "jobs", "career", "recruitment", "position"),
        ("title", "job_title", "company", "salary", "salary_range", "location", "requirements", "department", "benefits"),
        ("岗位", "招聘", "薪资", "地点", "要求", "职责", "公司", "福利"),
    ),
    "news": (
        ("news", "article", "announcement", "notice", "policy"),
        ("title", "publish_date", "published_at", "content", "summary", "source", "article"),
        ("新闻", "公告", "政策", "标题", "发布日期", "发布时间", "正文", "摘要"),
    ),
}
SCENE_ORDER = ("product", "job", "news")
PAGE_TYPE_POINTS, SCHEMA_POINTS = 5, 3
DRAFT_INTERVAL_MINUTES = 180
# ---- end of fixed values

DRAFT_COLUMNS = ("doc", "entries", "schema_name")


def scene_scores() -> Column:
    """ARRAY<STRUCT<score, order, scene>> for a typed run with `changed`."""
    selected = F.transform(F.coalesce("doc.selected_fields", F.array().cast("array<string>")), lambda f: F.lower(F.trim(f)))
    keys = F.transform(F.map_keys("entries"), lambda f: F.lower(F.trim(f)))
    labels = F.transform(F.map_values(F.coalesce("doc.field_labels", F.create_map().cast("map<string,string>"))), lambda v: F.lower(F.trim(v)))
    page_type = F.lower(F.trim(F.coalesce("doc.page_type", F.lit(""))))
    schema = F.lower(F.trim("schema_name"))
    terms = F.filter(
        F.array_distinct(F.concat(selected, keys, labels, F.array(F.lower("url"), page_type, schema))), lambda t: t != ""
    )

    def scored(order: int, scene: str) -> Column:
        types, fields, words = SCENES[scene]
        known = lambda f: f.isin(*fields)
        wordy = lambda t: t.rlike("|".join(words))
        points = (
            F.when(page_type.isin(*types), PAGE_TYPE_POINTS).otherwise(0)
            + F.when(schema.isin(*types), SCHEMA_POINTS).otherwise(0)
            + F.size(F.filter(selected, known))
            + F.size(F.filter(keys, known))
            + F.size(F.filter(labels, wordy))
            + F.size(F.filter(terms, wordy))
            + F.when(F.col("changed"), 1).otherwise(0)
        )
        return F.struct(points.alias("score"), F.lit(-order).alias("order"), F.lit(scene).alias("scene"))

    return F.array(*[scored(i, s) for i, s in enumerate(SCENE_ORDER)])


def best_scene(typed: DataFrame) -> DataFrame:
    """Add `scene` and `scene_score`; the first scene wins a tie."""
    top = F.array_max(scene_scores())
    return typed.withColumn("_top", top).withColumn("scene", F.col("_top.scene")).withColumn("scene_score", F.col("_top.score")).drop("_top")


def existing_by_url(urls: DataFrame, templates: DataFrame, monitors: DataFrame) -> DataFrame:
    """How many templates and monitors of the tenant already watch each URL."""
    keys = ["tenant_id", "url"]
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    return (
        urls.join(count(templates, "existing_template_count"), keys, "left")
        .join(count(monitors, "existing_monitor_count"), keys, "left")
        .na.fill(0, ["existing_template_count", "existing_monitor_count"])
    )


def growth_drafts(compared: DataFrame, runs: DataFrame, templates: DataFrame, monitors: DataFrame) -> DataFrame:
    """C14: template and monitor draft of every full success, with its history signals.

    `compared` is the output of `compare_with_previous(runs, keep=DRAFT_COLUMNS)`.
    """
    fields = F.coalesce("doc.selected_fields", F.array().cast("array<string>"))
    eligible = compared.where(
        (F.coalesce("doc._validation.status", F.lit("")) != "partial_success") & (F.size(fields) > 0)
    ).withColumn("changed", F.col("changed_count") > 0)
    history = url_history(runs).select("tenant_id", "url", "total_runs", F.col("has_history").alias("repeat_url"))
    scened = best_scene(eligible).join(history, ["tenant_id", "url"])
    domain = extract_domain(F.col("url"))
    return existing_by_url(scened, templates, monitors).select(
        "tenant_id", "run_id", "task_id", "url", "scene", "scene_score",
        F.concat(domain, F.lit(" "), "scene", F.lit(" 模板")).alias("template_name"),
        F.concat(domain, F.lit(" "), "scene").alias("monitor_name"),
        fields.alias("selected_fields"), F.lit(DRAFT_INTERVAL_MINUTES).alias("schedule_interval_minutes"),
        "repeat_url", "total_runs", "has_previous", "changed", "changed_count",
        "existing_template_count", "existing_monitor_count",
    )


def run_details(typed: DataFrame, summaries: DataFrame) -> DataFrame:
    """Each run with its diagnosis, the history of its URL and its change summary.

    Children and recent history are the long tables `batch_children` and `recent_history`.
    """
    d = diagnosis()
    history = url_history(typed)
    changes = summaries.select("run_id", "previous_task_id", "changed_count", "severity", "impact_summary")
    return (
        typed.select(
            "tenant_id", "run_id", "task_id", "url", "status", "quality_score", "elapsed_ms", extract_domain(F.col("url")).alias("domain"),
            bucket().alias("bucket"), d["category"].alias("failure_category"), d["title"].alias("failure_title"),
        )
        .join(history.select("tenant_id", "url", "total_runs", "success_runs", "failed_runs", "last_success_task_id"), ["tenant_id", "url"])
        .join(changes, "run_id", "left")
    )


def recent_history(runs: DataFrame, n: int = 10) -> DataFrame:
    """The newest n runs of every URL; groups are cut before the shuffle."""
    return top_per_key(
        runs.select("tenant_id", "url", "run_id", "task_id", "status", "quality_score"), ["tenant_id", "url"], [F.desc("run_id")], n
    )
