"""Ordered classification rules over status and error texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.functions.blank import let

# ---- Fixed values: categories, in the order in which they are tried, with the
# ---- substrings of the lower-cased error text that select them.
RUN_FAILURE_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("empty_after_clean", ("empty_after_clean",)),
    ("empty_response", ("body_size=0",)),
    ("unsupported_content", ("unsupported_content", "unsupported content")),
    ("decode_error", ("decode", "encoding", "unicode", "charset")),
    ("blocked_but_unclassified", ("blocked_but_unclassified",)),
    ("unreachable", ("unreachable_url", "invalid_url")),
    ("not_found", ("404", "not found")),
    ("dns_timeout", ("dns_timeout",)),
    ("connect_timeout", ("connect_timeout",)),
    ("tls_timeout", ("tls_timeout",)),
    ("ttfb_timeout", ("ttfb_timeout",)),
    ("read_timeout", ("read_timeout",)),
    ("render_timeout", ("render_timeout",)),
    ("network_idle_timeout", ("network_idle_timeout",)),
    ("timeout", ("timeout",)),
    ("rate_limit", ("429", "rate limit")),
    ("blocked", ("401", "403")),
    ("http_400_500", ("http_400_500", "http_4\\d\\d", "http_5\\d\\d")),
    (
        "anti_bot_or_shell",
        ("verification", "shell", "empty page", "loading page", "anti bot", "anti-bot"),
    ),
    ("anti_bot_or_shell", ("challenge", "captcha", "验证")),
    ("quality", ("schema", "quality", "字段")),
    ("network", ("network", "connect", "dns")),
)
COARSE_FAILURE_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("timeout", ("timeout",)),
    ("rate_limit", ("429", "rate limit")),
    ("auth", ("401", "403", "鉴权")),
    ("anti_bot", ("challenge", "风控", "验证")),
    ("quality", ("schema", "字段", "quality")),
    ("network", ("network", "connect", "dns")),
)
FETCH_FAILURE_MARKERS = (
    "404", "401", "403", "429", "anti_bot", "anti bot", "blocked", "captcha", "challenge",
    "timeout", "timed out", "network", "connection", "shell", "fetch",
)
# category, substrings, title, suggestion, severity
DIAGNOSIS_RULES: tuple[tuple[str, tuple[str, ...], str, str, str], ...] = (
    (
        "captcha", ("captcha", "challenge", "验证"), "疑似验证码或挑战页",
        "启用代理池和会话/profile 池化，降低站点并发；如仍失败，将该站点加入挑战页恢复策略并重试。", "warning",
    ),
    (
        "403", ("403", "forbidden"), "目标站返回 403",
        "切换代理或代理分组，降低站点级并发和访问频率；检查请求头、登录态和 robots/条款限制。", "danger",
    ),
    (
        "timeout", ("timeout", "timed out", "超时"), "页面加载或执行超时",
        "重试并提高 fetch/Playwright 超时；若页面静态可读，切换静态抓取，否则延长等待关键选择器。", "warning",
    ),
    (
        "model_error", ("model", "llm", "jsondecode", "invalid json", "rate limit", "api error", "模型"),
        "模型调用或输出异常",
        "检查模型 API Key、base_url、限流和响应格式；建议降低并发、启用重试，并保留原始响应用于排查。", "danger",
    ),
    (
        "missing_fields", ("field", "schema", "字段", "缺失"), "字段缺失",
        "发起字段级人工反馈，标记正确/错误/缺失；系统会沉淀到模板评分和站点记忆。", "warning",
    ),
)
UNKNOWN_DIAGNOSIS = (
    "unknown", "任务执行失败",
    "查看任务详情和运行日志；优先确认网络、代理、站点限速和模型配置，再重试。", "danger",
)
FEEDBACK_SYNONYMS = {
    "correct": "correct", "ok": "correct", "true": "correct", "right": "correct", "正确": "correct",
    "incorrect": "incorrect", "wrong": "incorrect", "false": "incorrect", "错误": "incorrect",
    "缺失": "missing", "missing": "missing", "empty": "missing",
}
# ---- end of fixed values


def any_of(parts: Sequence[str]) -> str:
    """A regex alternation; the rule texts above are already regex-safe."""
    return "|".join(parts)


def first_rule(text: Column, rules: Sequence[tuple[str, tuple[str, ...]]], default: Column) -> Column:
    """CASE WHEN text ~ rule1 THEN name1 WHEN ... ELSE default END."""
    chain = reduce(
        lambda acc, rule: acc.when(text.rlike(any_of(rule[1])), F.lit(rule[0])),
        rules[1:],
        F.when(text.rlike(any_of(rules[0][1])), F.lit(rules[0][0])),
    )
    return chain.otherwise(default)


def _lowered(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def http_status_class(code: Column) -> Column:
    """class of an HTTP error status, '' below 400."""
    return (
        F.when(code.isin(401, 403), "blocked")
        .when(code == 429, "rate_limit")
        .when(code.isin(404, 410), "not_found")
        .when((code >= 400) & (code < 600), "http_400_500")
        .otherwise("")
    )


def run_failure_category(error: Column) -> Column:
    """the detailed failure category of an error text, '' when there is none."""
    # The text is put together once, not for each rule.
    return let(
        _lowered(error),
        lambda text: F.when(text == "", F.lit("")).otherwise(first_rule(text, RUN_FAILURE_RULES, F.lit("other"))),
    )


def coarse_failure_class(error: Column) -> Column:
    """the six-way failure class, 'unknown' for a blank text."""
    text = _lowered(error)
    return F.when(text == "", F.lit("unknown")).otherwise(
        first_rule(text, COARSE_FAILURE_RULES, F.lit("other"))
    )


def failure_diagnosis(status: Column, error: Column, missing_count: Column) -> Column:
    """STRUCT<category, title, message, suggestion, severity, actionable>."""
    text = _lowered(error)

    def verdict(category: str, title: str, suggestion: str, severity: str) -> Column:
        return F.struct(
            F.lit(category).alias("category"),
            F.lit(title).alias("title"),
            F.trim(F.coalesce(error, F.lit(""))).alias("message"),
            F.lit(suggestion).alias("suggestion"),
            F.lit(severity).alias("severity"),
            F.lit(category != "").alias("actionable"),
        )

    missing = DIAGNOSIS_RULES[-1]
    chain = F.when(F.lit(False), verdict("", "", "", "info"))
    for category, parts, title, suggestion, severity in DIAGNOSIS_RULES:
        chain = chain.when(text.rlike(any_of(parts)), verdict(category, title, suggestion, severity))
    return (
        chain.when(missing_count > 0, verdict(missing[0], missing[2], missing[3], missing[4]))
        .when(_lowered(status) == "failed", verdict(*UNKNOWN_DIAGNOSIS))
        .otherwise(verdict("", "", "", "info"))
    )


def result_bucket(
    status: Column, validation_status: Column, diagnostic_text: Column
) -> Column:
    """full_success, partial_success, fetch_failed, validation_failed or failed."""
    verdict = _lowered(validation_status)
    text = _lowered(diagnostic_text)
    bad = verdict.isin("failed", "validation_failed")
    return (
        F.when(
            _lowered(status) == "success",
            F.when(verdict == "partial_success", "partial_success")
            .when(bad, "validation_failed")
            .otherwise("full_success"),
        )
        .when(text.rlike(any_of(FETCH_FAILURE_MARKERS)), "fetch_failed")
        .when(bad | text.contains("validation"), "validation_failed")
        .otherwise("failed")
    )


def feedback_status(value: Column) -> Column:
    """canonical feedback status; other texts pass through, blank is 'unknown'."""
    text = _lowered(value)
    pairs = [F.lit(x) for pair in FEEDBACK_SYNONYMS.items() for x in pair]
    known = F.element_at(F.create_map(*pairs), text)
    return F.coalesce(known, F.when(text != "", text), F.lit("unknown"))
