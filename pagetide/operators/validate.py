"""Validation and quality of extraction results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.blank import is_blank
from pagetide.functions import urls as U
from pagetide.operators.extract import completeness_of

# ---- Fixed values
REQUIRED_FIELDS = {
    "news": ("title", "content"), "article": ("title", "content"), "job": ("title", "company"),
    "product": ("name", "price"),
}
URL_FORMAT = r'(?i)^https?://[^\s<>"]+$'
DATE_FORMAT = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}"
PRICE_FORMAT = r"^[￥$€£]?\s*[\d,]+(?:\.\d+)?(?:\s*[-~至]\s*[￥$€£]?\s*[\d,]+(?:\.\d+)?)?"
MOJIBAKE_MARKERS = "鍚鍟鍏鐞锟麓涓绻Ãâ"
LOW_DYNAMIC, LOW_FIXED, FAILED_FIXED = 0.5, 0.5, 0.3
ERROR_PENALTY, WARNING_PENALTY = 0.2, 0.05
# ---- end of fixed values


def looks_like_mojibake(text: Column) -> Column:
    """Replacement characters and typical mis-decoded letters."""
    replaced = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    marks = F.length(text) - F.length(F.translate(text, MOJIBAKE_MARKERS, ""))
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return (F.length(F.trim(text)) >= 4) & (
        (replaced + marks >= 2)
        | ((replaced > 0) & (replaced / F.length(text) >= 0.02))
        | (text.contains("Ã") & (letters >= 2))
    )


def format_warnings(field: Column, value: Column) -> Column:
    """ARRAY of format warnings of one field value."""
    name = F.lower(field)
    return F.array_compact(
        F.array(
            F.when(looks_like_mojibake(value), F.concat(F.lit("decode_mojibake_suspected: field '"), field, F.lit("'"))),
            F.when(
                name.contains("url") & ~value.rlike(URL_FORMAT),
                F.concat(F.lit("字段 '"), field, F.lit("' 不是标准 URL: "), value),
            ),
            F.when(
                name.contains("date") & ~value.rlike(DATE_FORMAT),
                F.concat(F.lit("字段 '"), field, F.lit("' 日期格式可能不标准: "), value),
            ),
            F.when(
                (name.contains("price") | name.contains("salary")) & ~F.trim(value).rlike(PRICE_FORMAT),
                F.concat(F.lit("字段 '"), field, F.lit("' 数值格式可能不标准: "), value),
            ),
        )
    )


def missing_fields(data: Column, selected: Column) -> Column:
    """Selected fields without a value, in selection order."""
    return F.filter(F.array_distinct(selected), lambda f: is_blank(F.element_at(data, f)))


def _percent(rate: Column) -> Column:
    return F.format_string("%.1f%%", rate * 100)


def quality_score(completeness: Column, errors: Column, warnings: Column) -> Column:
    """Completeness less the penalties, held in 0..1."""
    raw = completeness - errors * ERROR_PENALTY - warnings * WARNING_PENALTY
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def validate_results(
    df: DataFrame, data: str = "data", selected: str = "selected_fields", page_type: str = "page_type"
) -> DataFrame:
    """V01-V07 for dynamic results: add `validation` STRUCT<status, is_valid, completeness, quality,
    warnings, errors, missing, reason>."""
    values, names = F.col(data), F.col(selected)
    required = F.create_map(
        *[x for t, fs in REQUIRED_FIELDS.items() for x in (F.lit(t), F.array(*[F.lit(f) for f in fs]))]
    )
    rows = (
        df.withColumn("_complete", completeness_of(values, names))
        .withColumn("_any", F.exists(F.map_values(values), lambda v: ~is_blank(v)))
        .withColumn(
            "_required",
            F.filter(
                F.coalesce(F.element_at(required, F.col(page_type)), F.array().cast("array<string>")),
                lambda f: F.array_contains(names, f) & is_blank(F.element_at(values, f)),
            ),
        )
        .withColumn("_missing", F.coalesce(missing_fields(values, names), F.array().cast("array<string>")))
        .withColumn(
            "_formats",
            F.flatten(
                F.transform(
                    F.filter(F.map_entries(values), lambda e: ~is_blank(e["value"])),
                    lambda e: format_warnings(e["key"], e["value"]),
                )
            ),
        )
    )
    complete, required_blank = F.col("_complete"), F.col("_required")
    key_lines = F.transform(required_blank, lambda f: F.concat(F.lit("关键字段 '"), f, F.lit("' 为空")))
    low = (
        F.when(F.col("_any") & (complete < LOW_DYNAMIC), F.concat(F.lit("字段完整度较低 ("), _percent(complete), F.lit(")")))
        .when(~F.col("_any") & (complete >= FAILED_FIXED) & (complete < LOW_FIXED), F.concat(F.lit("数据完整度较低 ("), _percent(complete), F.lit(")")))
    )
    too_low = F.when(~F.col("_any") & (complete < FAILED_FIXED), F.concat(F.lit("数据完整度过低 ("), _percent(complete), F.lit(")")))
    none = F.array().cast("array<string>")
    rows = rows.withColumn(
        "_warnings",
        F.concat(F.array_compact(F.array(low)), F.when(F.col("_any"), key_lines).otherwise(none), "_formats"),
    ).withColumn("_errors", F.concat(F.array_compact(F.array(too_low)), F.when(F.col("_any"), none).otherwise(key_lines)))
    mojibake = F.exists("_formats", lambda w: w.startswith("decode_mojibake_suspected"))
    status = (
        F.when(F.size("_errors") > 0, "failed")
        .when(low.isNotNull() | (F.size("_missing") > 0) | mojibake, "partial_success")
        .otherwise("full_success")
    )
    reason = (
        F.when(F.size("_missing") > 0, "field_missing").when(mojibake, "decode_mojibake_suspected").otherwise("")
    )
    return rows.withColumn(
        "validation",
        F.struct(
            status.alias("status"),
            (F.size("_errors") == 0).alias("is_valid"),
            complete.alias("completeness"),
            quality_score(complete, F.size("_errors"), F.size("_warnings")).alias("quality"),
            F.col("_warnings").alias("warnings"),
            F.col("_errors").alias("errors"),
            F.col("_missing").alias("missing"),
            reason.alias("reason"),
        ),
    ).drop("_complete", "_any", "_required", "_missing", "_formats", "_warnings", "_errors")


def validate_record(df: DataFrame, columns: list[str], required: list[str]) -> DataFrame:
    """V01/V06/V07 for records of a fixed schema: blanks of typed columns count as unfilled."""

    def blank(name: str) -> Column:
        kind = df.schema[name].dataType.typeName()
        col = F.col(name)
        if kind in ("array", "map"):
            return col.isNull() | (F.size(col) == 0)
        return col.isNull() | (col == "") if kind == "string" else col.isNull()

    filled = sum((F.when(blank(c), 0).otherwise(1) for c in columns), F.lit(0))
    complete = filled / F.lit(max(len(columns), 1))
    unmet = F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in required])) if required else F.array().cast("array<string>")
    errors = F.size(unmet) + F.when(complete < FAILED_FIXED, 1).otherwise(0)
    warnings = F.when((complete >= FAILED_FIXED) & (complete < LOW_FIXED), 1).otherwise(0)
    return df.withColumn(
        "validation",
        F.struct(
            F.when(errors > 0, "failed").when(warnings > 0, "partial_success").otherwise("full_success").alias("status"),
            (errors == 0).alias("is_valid"),
            complete.alias("completeness"),
            quality_score(complete, errors, warnings).alias("quality"),
            unmet.alias("missing"),
        ),
    )


def range_checks(df: DataFrame, rating: str = "rating", reviews: str = "review_count", confidence: str = "confidence") -> DataFrame:
    """Add `rejected_by`, the names of the columns outside their range."""
    bounds = ((rating, 0.0, 5.0), (reviews, 0.0, None), (confidence, 0.0, 1.0))
    failed = [
        F.when((F.col(c) < lo) | ((F.col(c) > hi) if hi is not None else F.lit(False)), F.lit(c))
        for c, lo, hi in bounds
        if c in df.columns
    ]
    return df.withColumn("rejected_by", F.array_compact(F.array(*failed)))


def field_evidence(hint_rows: DataFrame) -> DataFrame:
    """the distinct values of each page and field, in order of precedence."""
    value = F.trim("value")
    distinct = (
        hint_rows.where(F.trim("value") != "")
        .groupBy("page_id", "field", value.alias("value"))
        .agg(F.min(F.struct("src", "seq")).alias("at"))
    )
    # One page's values of one field: a handful of hint sources, so the list is bounded by the page.
    ordered = F.array_sort(F.collect_list(F.struct("at", "value")))
    return distinct.groupBy("page_id", "field").agg(
        F.transform(ordered, lambda e: e["value"]).alias("evidence")
    )


def page_type_consistency(
    df: DataFrame, original: str = "original_url", final: str = "final_url", selected: str = "selected_fields",
    hints: str = "hints", repair_reason: str = "repair_reason", title: str = "title",
) -> DataFrame:
    """add `expected_type`, `type_mismatch` and `type_mismatch_reason`."""
    first, last = F.col(original), F.col(final)
    expected = U.expected_page_type(first, F.col(selected))
    evidence = F.lit(False)
    for page_type, fields in U.TYPE_EVIDENCE.items():
        seen = F.arrays_overlap(F.map_keys(hints), F.array(*[F.lit(f) for f in fields]))
        evidence = evidence | ((F.col("expected_type") == page_type) & seen)
    preflight = U.page_type_mismatch(first, last, F.col(title))
    moved = (U.host(first) != "") & (U.host(last) != "") & (U.host(first) != U.host(last))
    doubtful = U.is_generic_path(last) | moved | (F.coalesce(repair_reason, F.lit("")) != "") | (preflight != "")
    return (
        df.withColumn("expected_type", expected)
        .withColumn("type_mismatch", (F.col("expected_type") != "") & doubtful & ~F.coalesce(evidence, F.lit(False)))
        .withColumn(
            "type_mismatch_reason",
            F.when(
                F.col("type_mismatch"),
                F.when(preflight != "", preflight).otherwise(
                    F.concat(F.lit("expected_"), "expected_type", F.lit("_but_final_url_or_content_lacks_type_evidence"))
                ),
            ).otherwise(""),
        )
    )


def apply_mismatch_penalty(df: DataFrame) -> DataFrame:
    """a mismatching page gets one more warning and 0.05 less quality."""
    v = F.col("validation")
    return df.withColumn(
        "validation",
        F.when(
            F.col("type_mismatch"),
            v.withField("quality", F.greatest(F.lit(0.0), v["quality"] - WARNING_PENALTY)).withField(
                "warnings",
                F.concat(v["warnings"], F.array(F.concat(F.lit("fetch_page_type_mismatch: "), "type_mismatch_reason"))),
            ),
        ).otherwise(v),
    )
