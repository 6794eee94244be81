"""Sinks and collections."""

from __future__ import annotations

import hashlib
import uuid
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.functions.blank import is_blank


def with_meta(df: DataFrame, source_url: Column, model: Column, confidence: Column, text_length: Column, at: Column) -> DataFrame:
    """Add the `_meta` struct of an extraction."""
    return df.withColumn(
        "_meta",
        F.struct(
            source_url.alias("source_url"), at.alias("extracted_at"), model.alias("extractor_model"),
            text_length.cast("int").alias("raw_text_length"), confidence.cast("double").alias("confidence_score"),
        ),
    )


def append_json(df: DataFrame, path: str) -> None:
    """Append records, `_meta` nested, as JSON lines."""
    df.write.mode("append").json(path)


def flatten_record(df: DataFrame) -> DataFrame:
    """Lists joined with ', ', maps and structs as JSON, `_meta` spread over four columns."""
    columns = []
    for field in df.schema:
        name, kind = field.name, field.dataType
        if name == "_meta":
            columns += [
                F.col("_meta.source_url").alias("_source_url"), F.col("_meta.extracted_at").alias("_extracted_at"),
                F.col("_meta.extractor_model").alias("_model"), F.col("_meta.confidence_score").alias("_confidence"),
            ]
        elif isinstance(kind, T.ArrayType):
            columns.append(F.array_join(F.col(name).cast("array<string>"), ", ").alias(name))
        elif isinstance(kind, (T.MapType, T.StructType)):
            columns.append(F.to_json(F.col(name)).alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def spread_data(df: DataFrame, fields: list[str], data: str = "data") -> DataFrame:
    """Entries of a data map as columns; the field list comes from the schema in use."""
    return df.select(*[c for c in df.columns if c != data], *[F.element_at(data, f).alias(f) for f in fields])


def merge_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both, columns of either."""
    return old.unionByName(new, allowMissingColumns=True)


def write_csv_collection(df: DataFrame, folder: str) -> str:
    """Add records to a CSV collection whose header may grow.

    Every call writes its own part folder with its own header, so nothing old is rewritten; the
    reader unions the parts by column name.
    """
    target = f"{folder.rstrip('/')}/part={datetime.now(UTC):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    flat = flatten_record(df)
    flat.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in flat.columns]).write.option(
        "quoteAll", True
    ).option("escape", '"').csv(target, header=True)
    return target


def read_csv_collection(spark: SparkSession, parts: list[str]) -> DataFrame:
    """Parts of a CSV collection with the union of their columns, '' where a part lacks one."""
    read = lambda p: spark.read.option("multiLine", True).option("escape", '"').csv(p, header=True)
    merged = read(parts[0])
    for part in parts[1:]:
        merged = merge_columns(merged, read(part))
    return merged.na.fill("")


def append_csv(df: DataFrame, folder: str) -> None:
    """Append records to a CSV collection whose header may grow; parts with the same header share a folder.

    The catalogue of headers is the folder's listing, so a collection is planned by its headers, however many appends.
    """
    flat = flatten_record(df)
    header = hashlib.md5("\n".join(flat.columns).encode()).hexdigest()
    texts = flat.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in flat.columns])
    writer = texts.write.mode("append").option("quoteAll", True).option("escape", '"').option("encoding", "UTF-8")
    writer.csv(f"{folder.rstrip('/')}/header={header}", header=True)


def read_csv_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A CSV collection with the columns of all its headers, '' where a part lacks one; one scan for each header."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    reader = lambda: spark.read.option("multiLine", True).option("escape", '"').option("header", True)
    scans = [reader().csv(f"{folder.rstrip('/')}/{n}") for n in sorted(names) if n.startswith("header=")]
    return reduce(merge_columns, scans).na.fill("")


def append_table(df: DataFrame, path: str) -> None:
    """Append to a parquet collection; lists and maps stay native, new columns are new columns."""
    df.write.mode("append").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet collection with the merged columns of all its files."""
    return spark.read.option("mergeSchema", True).parquet(path)


def page_of(df: DataFrame, order: list, limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows offset+1 .. offset+limit of a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def collection_count(spark: SparkSession, df: DataFrame | None) -> DataFrame:
    """Number of rows; 0 for an absent collection."""
    if df is None:
        return spark.range(1).select(F.lit(0).cast("long").alias("rows"))
    return df.agg(F.count("*").alias("rows"))


def markdown_reports(details: DataFrame) -> DataFrame:
    """One Markdown report per run.

    `details`: task_id, url, status, storage_format, domain, created_at, completed_at, elapsed_ms,
    quality_score, has_previous, changed_count, impact_summary, summary_lines, suggested_actions,
    data MAP.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    bullets = lambda items: F.transform(items, lambda i: F.concat(F.lit("- "), i))
    overview = F.array(
        F.concat(F.lit("# 任务报告 - "), text("task_id")), F.lit(""), F.lit("## 任务概览"), F.lit(""),
        F.concat(F.lit("- URL: "), text("url")), F.concat(F.lit("- 状态: "), text("status")),
        F.concat(F.lit("- 存储格式: "), text("storage_format")), F.concat(F.lit("- 域名: "), text("domain")),
        F.concat(F.lit("- 创建时间: "), text("created_at")), F.concat(F.lit("- 完成时间: "), text("completed_at")),
        F.concat(F.lit("- 耗时: "), F.round(F.coalesce("elapsed_ms", F.lit(0.0))).cast("long"), F.lit(" ms")),
        F.concat(F.lit("- 质量分: "), F.format_string("%.1f%%", F.coalesce("quality_score", F.lit(0.0)) * 100)), F.lit(""),
    )
    changed = F.col("changed_count") > 0
    section = lambda title, items: F.when(F.size(items) > 0, F.concat(F.array(F.lit(""), F.lit(title)), bullets(items))).otherwise(F.array().cast("array<string>"))
    changes = F.when(
        F.col("has_previous"),
        F.concat(
            F.array(
                F.lit("## 变化告警"), F.lit(""),
                F.concat(F.lit("- 是否有变化: "), F.when(changed, "是").otherwise("否")),
                F.concat(F.lit("- 变化字段数: "), "changed_count"),
            ),
            F.when(F.col("impact_summary") != "", F.array(F.concat(F.lit("- 影响摘要: "), "impact_summary"))).otherwise(F.array().cast("array<string>")),
            section("### 变化摘要", F.col("summary_lines")), section("### 建议动作", F.col("suggested_actions")), F.array(F.lit("")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    filled = F.filter(F.map_entries("data"), lambda e: e["value"].isNotNull())
    rows = F.array_sort(F.transform(filled, lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), F.when(is_blank(e["value"]), "").otherwise(e["value"]))))
    result = F.when(F.size("data") > 0, F.concat(F.array(F.lit("## 提取结果"), F.lit("")), rows)).otherwise(F.array().cast("array<string>"))
    whole = F.array_join(F.concat(overview, changes, result), "\n")
    return details.select("task_id", F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n")).alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    """The report table (task_id, report), appended."""
    reports.select("task_id", "report").write.mode("append").parquet(path)


def export_reports(reports: DataFrame, task_ids: list[str], path: str) -> None:
    """The reports of a few named runs as Markdown text, one folder per run.

    One folder per run suits a hand-picked export; whole histories go through `write_reports`.
    """
    reports.where(F.col("task_id").isin(task_ids)).select("task_id", "report").write.mode("append").partitionBy(
        "task_id"
    ).text(path, lineSep="")
