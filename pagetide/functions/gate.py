"""Challenge, shell and loading-page tests (F17 helpers, F18) over page text and headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values
CHALLENGE_TEXTS = (
    "安全验证", "人机验证", "验证码", "异常访问", "访问受限", "verify you are human", "captcha",
    "checking your browser", "enable javascript", "enable cookies", "press and hold",
    "just a moment", "access denied", "suspicious traffic", "unusual traffic",
    "blocked due to suspicious activity", "ddos protection", "ray id", "cloudflare", "cf-chl",
    "robot check", "security check", "attention required", "please wait while we verify",
)
CHALLENGE_HEADERS = (
    "cf-ray", "cf-mitigated", "x-sucuri-block", "x-distil-cs", "x-akamai-session-info",
)
LOADING_TEXTS = ("加载中", "请稍候", "loading", "initializing")
RETRYABLE_ERRORS = (
    "proxy", "timeout", "timed out", "connection reset", "connection refused",
    "network is unreachable", "temporarily unavailable", "too many requests",
)
SHELL_MARKERS = (
    ("cloudflare", ("cloudflare", "cf-ray", "cf-chl", "just a moment")),
    ("captcha", ("captcha", "robot check", "verify you are human")),
    ("access_denied", ("access denied", "forbidden", "403 forbidden")),
    ("js_required", ("enable javascript", "javascript is disabled")),
    ("loading_shell", ("loading", "please wait", "initializing")),
    ("rate_limited", ("too many requests", "rate limit", "429")),
)
# ---- end of fixed values


def _low(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def has_challenge_text(text: Column) -> Column:
    return _low(text).rlike("|".join(CHALLENGE_TEXTS))


def is_loading_text(text: Column, most: int = 80) -> Column:
    """A short text that says it is loading."""
    t = _low(text)
    return (F.length(t) <= most) & t.rlike("|".join(LOADING_TEXTS))


def has_challenge_headers(headers: Column) -> Column:
    """`headers` is MAP<STRING,STRING>; names are compared case-insensitively."""

    def guarded(name: Column, value: Column) -> Column:
        n, v = F.lower(name), F.lower(value)
        return (
            n.isin(*CHALLENGE_HEADERS)
            | ((n == "server") & v.rlike("cloudflare|sucuri"))
            | ((n == "x-powered-by") & v.contains("perimeterx"))
        )

    pairs = F.map_entries(headers)
    return F.coalesce(F.exists(pairs, lambda e: guarded(e["key"], e["value"])), F.lit(False))


def shell_markers(html: Column, headers: Column | None = None) -> Column:
    """ARRAY of the shell kinds whose markers occur in the page or in its headers."""
    text = F.lower(F.coalesce(html, F.lit("")))
    if headers is not None:
        blob = F.array_join(
            F.transform(F.map_entries(headers), lambda e: F.concat_ws(" ", e["key"], e["value"])), " "
        )
        text = F.concat_ws(" ", text, F.lower(blob))
    return F.array_compact(
        F.array(*[F.when(text.rlike("|".join(parts)), name) for name, parts in SHELL_MARKERS])
    )


def assess_challenge(text: Column, headers: Column, status_code: Column, error: Column) -> Column:
    """STRUCT<challenge, shell_page, blocked, retryable, reason>."""
    challenge = has_challenge_text(text) | has_challenge_headers(headers)
    loading = is_loading_text(text)
    refused = F.coalesce(status_code.isin(401, 403, 429), F.lit(False))
    transport = _low(error).rlike("|".join(RETRYABLE_ERRORS))
    return F.struct(
        challenge.alias("challenge"),
        loading.alias("shell_page"),
        (challenge | refused).alias("blocked"),
        (challenge | refused | loading | transport).alias("retryable"),
        F.when(challenge, "challenge_page")
        .when(loading, "shell_page")
        .when(refused, F.concat(F.lit("http_"), status_code))
        .when(transport, "transport_error")
        .otherwise("")
        .alias("reason"),
    )


def page_gate(
    fetched_ok: Column, is_shell: Column, clean: Column, hint_count: Column
) -> Column:
    """STRUCT<page_status, reason>; the first failing test decides."""

    def verdict(status: str, reason: str) -> Column:
        return F.struct(F.lit(status).alias("page_status"), F.lit(reason).alias("reason"))

    empty = F.trim(F.coalesce(clean, F.lit(""))) == ""
    return (
        F.when(~F.coalesce(fetched_ok, F.lit(False)), verdict("fetch_failed", "网页抓取失败"))
        .when(F.coalesce(is_shell, F.lit(False)), verdict("shell_page", "页面为空壳页面"))
        .when(has_challenge_text(clean), verdict("verification", "目标站点返回安全验证页面，当前无法提取真实内容"))
        .when(
            is_loading_text(clean, 32) & (hint_count == 0),
            verdict("loading", "页面仍停留在加载状态，当前无法提取真实内容"),
        )
        .when(empty & (hint_count == 0), verdict("empty_after_clean", "网页清洗后为空"))
        .otherwise(verdict("ready", ""))
    )
