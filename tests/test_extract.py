"""Extraction, cascade and validation on small texts."""

from pyspark.sql import functions as F

from pagetide.operators import extract as X
from pagetide.operators import validate as VA


def page(spark, text, page_type="", fields=()):
    row = spark.createDataFrame([(1, "https://a.com/x", text, page_type, list(fields))], "page_id LONG, url STRING, text STRING, page_type STRING, fields ARRAY<STRING>")
    return X.read_hint_block(row)


def specialised(spark, text, page_type, fields=None):
    return X.specialized_extract(page(spark, text, page_type, fields or X.SPECIALIZED_FIELDS[page_type])).first()["specialized"]


def block(**hints):
    return "Structured extraction hints:\n" + "".join(f"{k}: {v}\n" for k, v in hints.items()) + "\n"


def test_product_hints(spark):
    s = specialised(spark, block(name="Tool Pro", price="USD 29.99", availability="InStock") + "Cookie banner\nBuy now", "product", ["name", "price", "availability"])
    assert s.usable and s.data == {"name": "Tool Pro", "price": "USD 29.99", "availability": "in_stock"}


def test_policy_date_and_number(spark):
    s = specialised(spark, block(title="Data Notice", publish_date="20 May 26", agency="Office", policy_number="No. ABC-7") + "No. ABC-7\nA paragraph with enough detail.", "policy")
    assert s.data["publish_date"] == "2026-05-20" and s.data["policy_number"] == "No. ABC-7"


def test_pricing_tiers(spark):
    s = specialised(spark, block(plan="Pro", price="USD 49 /month", billing_period="monthly", free_tier="Free", enterprise_tier="Enterprise") + "Free forever.", "pricing")
    assert s.data["billing_period"] == "per month" and s.data["free_tier"] == "Free" and s.data["price"] == "USD 49 per month"


def test_job_counts_platform_hints(spark):
    s = specialised(spark, block(title="Engineer", company="Acme", ats_platform="workday", job_page_kind="detail") + "Careers page", "job")
    assert s.hint_hits == 4 and s.data["company"] == "Acme"


def test_specialised_without_hints(spark):
    s = specialised(spark, "Blue Widget\nPrice: $12.50\nBrand: Acme\nin stock now and ready to ship today", "product")
    assert s.data["name"] == "Blue Widget" and s.data["price"] == "USD 12.5" and s.data["brand"] == "Acme" and s.data["availability"] == "in_stock"


def rules(spark, text, *fields):
    return X.rule_extract(page(spark, text, "", fields)).first()["rule_data"]


def test_rules(spark):
    text = "Great Widget\n价格：¥ 99\nAuthor: Ann\nPosted on Jan 5, 2024 in the city\nplain filler line that is long enough"
    data = rules(spark, text, "title", "price", "author", "publish_date", "content", "summary")
    assert data["title"] == "Great Widget" and data["price"] == "¥ 99" and data["author"] == "Ann"
    assert data["publish_date"] == "Jan 5, 2024"
    assert data["content"].startswith("Posted on Jan 5") and data["summary"].startswith("Posted on")


def test_noise_values_are_skipped(spark):
    assert "brand" not in rules(spark, "Brand: cookie settings\nshort", "brand")


def cascade(spark, text, fields=(), **columns):
    row = spark.createDataFrame([(1, "https://a.com/x", text, list(fields))], "page_id LONG, url STRING, text STRING, selected_fields ARRAY<STRING>")
    for name, value in columns.items():
        row = row.withColumn(name, value)
    return X.cascade(X.with_lines(row.withColumn("hints", F.expr(X.EMPTY_MAP)))).first()["result"]


def test_cascade_specialised(spark):
    r = cascade(spark, "Blue Widget\nprice: $10", ["name", "price"])
    assert r.strategy == "specialized_rule" and r.data == {"name": "Blue Widget", "price": "USD 10"}


def test_cascade_precheck(spark):
    r = cascade(spark, "摘要：短说明\n标题：公告一则\n作者：王", ["title", "author"])
    assert r.strategy in ("rule_precheck", "specialized_rule") and r.data["author"] == "王"


def test_cascade_model_before_fallback(spark):
    model = F.lit('{"data": {"mood": "calm"}, "selected_fields": ["mood"]}')
    rows = spark.createDataFrame([(1, "u", "tiny text", ["mood"])], "page_id LONG, url STRING, text STRING, selected_fields ARRAY<STRING>")
    rows = X.read_model_result(X.with_lines(rows.withColumn("hints", F.expr(X.EMPTY_MAP)).withColumn("model_json", model)))
    r = X.cascade(rows).first()["result"]
    assert r.strategy == "llm" and r.data == {"mood": "calm"}


def test_cascade_fallback_keeps_the_whole_text(spark):
    text = "\n".join(f"plain sentence number {i} of the text" for i in range(400))
    r = cascade(spark, "参考文献\n" + text, ["mood"])
    assert r.strategy == "fallback" and r.data["content"].count("plain sentence") == 400 and "参考文献" not in r.data["content"]


def validated(spark, data, fields, page_type="listing"):
    row = spark.createDataFrame([(data, fields, page_type)], "data MAP<STRING,STRING>, selected_fields ARRAY<STRING>, page_type STRING")
    return VA.validate_results(row).first()["validation"]


def test_validation_levels(spark):
    assert validated(spark, {"a": "1", "b": "2"}, ["a", "b"]).status == "full_success"
    half = validated(spark, {"a": "1"}, ["a", "b", "c"])
    assert half.status == "partial_success" and half.missing == ["b", "c"] and abs(half.quality - (1 / 3 - 0.05)) < 1e-9
    none = validated(spark, {"a": ""}, ["a", "b"])
    assert none.status == "failed" and not none.is_valid and abs(none.quality) < 1e-9


def test_required_field_warns(spark):
    v = validated(spark, {"price": "10"}, ["name", "price"], "product")
    assert v.status == "partial_success" and v.is_valid and any("name" in w for w in v.warnings)


def test_format_warnings(spark):
    v = validated(spark, {"source_url": "x", "publish_date": "May", "price": "cheap"}, ["source_url", "publish_date", "price"])
    assert len(v.warnings) == 3


def test_mojibake(spark):
    v = validated(spark, {"title": "鍚庝簡鍟樸紡鐞?", "company": "Acme"}, ["title", "company"])
    assert v.is_valid and v.status == "partial_success" and v.reason == "decode_mojibake_suspected"


def test_fixed_record(spark):
    rows = spark.createDataFrame([("t", None, "c", ["x"]), ("", "", "", [])], "title STRING, author STRING, content STRING, tags ARRAY<STRING>")
    got = [r.validation for r in VA.validate_record(rows, rows.columns, ["title"]).collect()]
    assert (got[0].status, got[0].completeness, got[1].status) == ("full_success", 0.75, "failed")


def test_words_for_missing_stock_go_before_others(spark):
    for words, want in (
        ("This item is not available at the moment", "out_of_stock"), ("Available in blue. Currently unavailable in red", "out_of_stock"),
        ("This colour is available now", "in_stock"), ("Sold out", "out_of_stock"),
    ):
        s = specialised(spark, f"Blue Widget\nPrice: $12.50\nBrand: Acme\n{words}", "product")
        assert s.data["availability"] == want, words


def test_lists_of_words_are_searched_for_word_by_word(spark):
    lists = [X.NOISE_VALUE, X.NOISE_HEADING, X.PAGE_NOISE, X.JOB_TEXT, X.PRICING_TEXT, X.PRODUCT_TEXT, X.POLICY_TEXT]
    words = sorted({w.replace("\\", "") for words in lists for w in words.split("|")} | {m for _, marks in X.TYPE_BY_TEXT for m in marks})
    texts = [None, "", "[...", "[... more", "[xyz more", "skipto", "a\ncookie", "Ünlü İSTANBUL pläne", *words, *[w.upper() for w in words], *[f"x{w[:-1]}" for w in words]]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k INT, text STRING")
    for pattern in lists:
        both = rows.selectExpr("text", f"{X._holds('text', pattern)} AS found", f"lower(text) RLIKE r'{pattern}' AS want").collect()
        assert [r["found"] for r in both] == [r["want"] for r in both]
        assert " RLIKE " not in X._holds("text", pattern)
    cases = " ".join(f"WHEN lower(text) RLIKE '{'|'.join(marks)}' THEN '{name}'" for name, marks in X.TYPE_BY_TEXT)
    both = rows.selectExpr(f"{X._type_by_text('text')} AS found", f"CASE {cases} ELSE 'article' END AS want").collect()
    assert [r["found"] for r in both] == [r["want"] for r in both] and " RLIKE " not in X._type_by_text("text")


def test_notices_are_left_out_of_a_fallback_text(spark):
    import re

    lines = ["| a row of a table", "plain words that stay here", "参考文献 and more words", "  参见：  ", "# 参见", "x (2024年1月2日) and so on", "此条目需要更多来源来证明", "展开 the whole text", "[编辑] this section", "a | bar in the middle", "été words that stay too", "", None]
    noise = re.compile("|".join(X.FALLBACK_NOISE))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*lines, "\n".join(t for t in lines if t)])], "k INT, text STRING")
    for r in rows.withColumn("kept", X.fallback_text()).collect():
        kept = [x.strip(" ") for x in (r["text"] or "").split("\n") if len(x.strip(" ")) >= X.FALLBACK_LINE and not noise.search(x.strip(" "))]
        assert r["kept"] == ("\n\n".join(kept) or r["text"])
