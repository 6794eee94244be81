"""Scalar normalisers, URL functions and classifiers on literals."""

import pytest
from pyspark.sql import functions as F

from pagetide.functions import classify, gate, text as T, urls as U
from pagetide.functions.sql_functions import register_sql_functions


def value(spark, build, *texts):
    row = spark.createDataFrame([texts], [f"c{i}" for i in range(len(texts))])
    return row.select(build(*[F.col(c) for c in row.columns]).alias("v")).first()["v"]


PRICES = [
    ("From $499 per seat/month", "USD 499 per seat/month"), ("$1,299.00", "USD 1299"), ("€ 10.50 /yr", "EUR 10.5 per year"),
    ("100", "100"), ("RMB 30.0", "CNY 30"), ("ask us", "ask us"), ("as low as £7.10", "GBP 7.1"),
]
DATES = [
    ("20 May 26", "2026-05-20"), ("May 3, 1999", "1999-05-03"), ("2024/2/30", "2024/2/30"), ("on 2024年3月5日", "2024-03-05"),
    ("3 Foo 2020", "3 Foo 2020"), ("1 Jan 71", "1971-01-01"), ("soon", "soon"), ("Sept 9, 2021", "2021-09-09"),
]
PERIODS = [
    ("$19 /mo", "per month"), ("billed annually", "per year"), ("per user per month", "per user/month"), ("once", ""),
    ("per member, monthly", "per user/month"),
]


@pytest.mark.parametrize("given,want", PRICES)
def test_price(spark, given, want):
    assert value(spark, T.normalize_price, given) == want


@pytest.mark.parametrize("given,want", DATES)
def test_date(spark, given, want):
    assert value(spark, T.normalize_date, given) == want


@pytest.mark.parametrize("given,want", PERIODS)
def test_period(spark, given, want):
    assert value(spark, T.normalize_billing_period, given) == want


def test_sql_functions_agree_with_columns(spark):
    register_sql_functions(spark)
    for name, cases in (("normalize_price", PRICES), ("normalize_date", DATES), ("normalize_billing_period", PERIODS)):
        rows = spark.createDataFrame(cases, ["given", "want"]).selectExpr(f"{name}(given) AS got", "want").collect()
        assert [(r.got, r.want) for r in rows if r.got != r.want] == []


def test_field_value_dispatch(spark):
    build = lambda f, v: T.normalize_field_value(f, v)
    assert value(spark, build, "monthly_price", "From $5.00") == "USD 5"
    assert value(spark, build, "price", '["$5","€6"]') == '["USD 5","EUR 6"]'
    assert value(spark, build, "price", '{"a":"$5"}') == '{"a":"$5"}'
    assert value(spark, build, "stock", "unavailable") == "out_of_stock"
    assert value(spark, build, "title", "  a \n b ") == "a b"


@pytest.mark.parametrize(
    "url,prefix,slug",
    [("https://a.com", "/", ""), ("https://a.com/x/y/z/", "/x/y", "z"), ("https://a.com/one?q=/b", "/one", "one")],
)
def test_paths(spark, url, prefix, slug):
    assert value(spark, U.path_prefix, url) == prefix
    assert value(spark, U.path_slug, url) == slug


def test_domains(spark):
    assert value(spark, U.extract_domain, "HTTPS://A.com:8080/x") == "a.com:8080"
    assert value(spark, U.extract_domain, "批量任务（3 个）") == "batch"
    assert value(spark, U.extract_domain, "no url") == "unknown"


def test_link_resolution(spark):
    base = "https://a.com/x/y?q=1"
    assert value(spark, lambda l: U.resolve_link(F.lit(base), l), "/z") == "https://a.com/z"
    assert value(spark, lambda l: U.resolve_link(F.lit(base), l), "z") == "https://a.com/x/z"
    assert value(spark, lambda l: U.resolve_link(F.lit(base), l), "//b.com/z") == "https://b.com/z"


def test_expected_type(spark):
    fields = lambda u: U.expected_page_type(u, F.array(F.lit("salary_range")))
    assert value(spark, fields, "https://a.com/product/1") == "job"
    none = lambda u: U.expected_page_type(u, F.array().cast("array<string>"))
    assert value(spark, none, "https://a.com/press/1") == "policy"


@pytest.mark.parametrize(
    "error,category,coarse",
    [
        ("body_size=0", "empty_response", "other"), ("render_timeout", "render_timeout", "timeout"), ("http_503", "http_400_500", "other"),
        ("HTTP 401", "blocked", "auth"), ("请完成验证", "anti_bot_or_shell", "anti_bot"), ("", "", "unknown"), ("odd", "other", "other"),
    ],
)
def test_failure_rules(spark, error, category, coarse):
    assert value(spark, classify.run_failure_category, error) == category
    assert value(spark, classify.coarse_failure_class, error) == coarse


def test_gate_order(spark):
    def status(ok, shell, text, hints):
        return value(spark, lambda t: gate.page_gate(F.lit(ok), F.lit(shell), t, F.lit(hints))["page_status"], text)

    assert status(False, True, "", 0) == "fetch_failed"
    assert status(True, True, "text", 0) == "shell_page"
    assert status(True, False, "Please complete the CAPTCHA", 3) == "verification"
    assert status(True, False, "Loading...", 0) == "loading"
    assert status(True, False, "Loading...", 1) == "ready"
    assert status(True, False, " ", 0) == "empty_after_clean"


def test_shell_markers_use_the_whole_page(spark):
    page = "x" * 9000 + " Too Many Requests"
    assert value(spark, gate.shell_markers, page) == ["rate_limited"]


def test_lenient_object(spark):
    assert value(spark, T.lenient_object, 'noise {"a": {"b": 1}} tail') == {"a": '{"b":1}'}
    assert value(spark, T.lenient_object, "no json") is None


@pytest.mark.parametrize(
    "text,expected",
    [
        ("The lamp is currently unavailable", "unavailable"), ("Out of stock. Available from May", "out of stock"),
        ("Available now", "available"), ("Sold out, was available", "sold out"), ("no word of it", None),
    ],
)
def test_stock_words_count_whole_and_missing_stock_first(spark, text, expected):
    from pagetide.operators import extract as X

    row = spark.createDataFrame([(text,)], "text string").select(F.expr(X._first_marker(X.AVAILABILITY_MARKERS, "lower(text)")).alias("m")).first()
    assert row["m"] == expected
