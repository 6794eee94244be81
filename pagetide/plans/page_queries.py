"""Whole-table queries over pages, documents and texts: cleaning, hints, extraction, validation, URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetide.functions import gate, text as T, urls as U
from pagetide.operators import extract as X
from pagetide.operators import hints as H
from pagetide.operators import links as L
from pagetide.operators import pages as P
from pagetide.operators import runs as R
from pagetide.operators import validate as VA
from pagetide.plans import sql_views as S
from pagetide.plans import views as V
from pagetide.plans.registry import query

_UNESCAPE = "replace(replace({}, '&quot;', '\"'), '&amp;', '&')"
_TITLE = "trim(" + _UNESCAPE.format("regexp_extract(html, '<title>([^<]*)</title>', 1)") + ")"
_CLEAN = """list_filter(list_transform(regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>|</p>|</h1>'),
  lambda s: trim(replace(replace(regexp_replace(s, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'))), lambda s: s <> '')"""


def _clean_pages(spark, sf):
    return P.with_clean_text(P.parse_pages(V.pages(spark, sf)))


@query("page_titles", f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_titles(spark, sf):
    return P.parse_pages(V.pages(spark, sf)).select("page_id", P.page_title().alias("title"))


@query("page_clean_text", f"SELECT page_id, '# ' || array_to_string({_CLEAN}, chr(10) || chr(10)) AS clean_text FROM pages")
def page_clean_text(spark, sf):
    return _clean_pages(spark, sf).select("page_id", "clean_text")


@query("page_lines", f"""WITH c AS (SELECT page_id, {_CLEAN} AS parts FROM pages)
SELECT page_id, i - 1 AS line_no, CASE WHEN i = 1 THEN '# ' ELSE '' END || regexp_replace(parts[i], '\\s+', ' ', 'g') AS line FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM c)""")
def page_lines(spark, sf):
    return P.page_lines(_clean_pages(spark, sf)).select("page_id", "line_no", "line")


@query("page_clean_text_capped")
def page_clean_text_capped(spark, sf):
    """The cleaned text cut at 2000 characters; checked against brute force in the tests."""
    return P.with_clean_text(P.parse_pages(V.pages(spark, sf)), max_chars=2000).select("page_id", "clean_text")


@query("page_region_text", f"SELECT page_id, '# ' || array_to_string({_CLEAN}, chr(10) || chr(10)) AS clean_text FROM pages")
def page_region_text(spark, sf):
    return P.with_clean_text(P.parse_pages(V.pages(spark, sf)), selector="article").select("page_id", "clean_text")


# The first element of each selector, by name.
_SELECTORS = {
    "link": "nav a", "second": "nav li:first-child + li > a", "third": "body li + li + li a[href*='/']", "heading": "article > h1",
    "opening": "article > h1 + p", "either": ".no-such-class, footer p, html > head > title[lang], title",
}
_MARKUP_TEXTS = "array_to_string(list_filter(list_transform(regexp_split_to_array({}, '<[^>]*>'), lambda s: trim(replace(replace(s, '&quot;', '\"'), '&amp;', '&'))), lambda s: s <> ''), chr(10))"
_SELECTED = {
    "link": "regexp_extract(html, '<nav><ul><li><a [^>]*>([^<]*)</a>', 1)", "second": "regexp_extract(html, '<nav><ul><li>.*?</li><li><a [^>]*>([^<]*)</a>', 1)",
    "third": "regexp_extract(html, '<nav><ul><li>.*?</li><li>.*?</li><li><a [^>]*>([^<]*)</a>', 1)", "heading": "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)",
    "opening": "regexp_extract(html, '(?s)</h1><p>(.*?)(<p>|</p>|</article>)', 1)", "either": "regexp_extract(html, '<title>([^<]*)</title>', 1)",
}


@query("page_selected_text", " UNION ALL ".join(f"SELECT page_id, '{name}' AS picked, {_MARKUP_TEXTS.format(sql)} AS text FROM pages" for name, sql in _SELECTED.items()))
def page_selected_text(spark, sf):
    """The text of the element that each of six selectors picks on a page."""
    parsed = P.parse_pages(V.pages(spark, sf), keep=("lang",))
    texts = [F.struct(F.lit(name).alias("picked"), P.region_text(selector).alias("text")) for name, selector in _SELECTORS.items()]
    return parsed.select("page_id", F.explode(F.array(*texts)).alias("p")).select("page_id", "p.picked", "p.text")


_JOB_PAGE = {
    0: ("<p>Intro ", "p_name", '</p><div class="job-info">Role one at ', "p_brand", '</div><div class="job-info"><b>Role two</b> ', "p_size",
        ' places</div><div class="Job-Info x">Role three ', "p_type", '</div><div class="job-info">tiny</div><p>Tail</p>'),
    1: ('<div class="job-info">Role one at ', "p_brand", '</div><section class="job-card">Card one of ', "p_name",
        '</section><section class="big job-card">Card two of ', "p_type", "</section><p>Tail</p>"),
    2: ('<ul class="the-job-list"><li class="a-job">Nested one ', "p_name", '</li><li class="a-job">Nested two ', "p_type",
        '</li><li class="a-job">Nested three ', "p_size", "</li><li>plain item here</li></ul>"),
    3: ('<h1>Jobs</h1><div class="job-info">Only one role ', "p_name", "</div><p>Tail text</p>"),
}


@query("job_page_text", """SELECT p_partkey AS page_id, CASE p_partkey % 4
  WHEN 0 THEN 'Role one at ' || p_brand || chr(10) || chr(10) || 'Role two' || chr(10) || p_size || ' places' || chr(10) || chr(10) || 'Role three ' || p_type
  WHEN 1 THEN 'Role one at ' || p_brand || chr(10) || chr(10) || 'Card one of ' || p_name || chr(10) || chr(10) || 'Card two of ' || p_type
  WHEN 2 THEN 'Nested one ' || p_name || chr(10) || chr(10) || 'Nested two ' || p_type || chr(10) || chr(10) || 'Nested three ' || p_size
  ELSE '# Jobs' || chr(10) || chr(10) || 'Tail text' END AS clean_text,
  CASE p_partkey % 4 WHEN 0 THEN 'Intro ' || p_name || chr(10) || 'Tail' || chr(10) || 'tiny' WHEN 1 THEN 'Tail' WHEN 2 THEN 'plain item here' END AS other_text FROM part""")
def job_page_text(spark, sf):
    """The job blocks of pages built from parts, and what stands beside them."""
    page = F.coalesce(*[
        F.when(F.col("p_partkey") % 4 == k, F.concat(*[F.col(x).cast("string") if x.startswith("p_") else F.lit(x) for x in parts])) for k, parts in _JOB_PAGE.items()
    ])
    rows = V.wide_table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), page.alias("html"))
    return P.with_clean_text(P.parse_pages(rows), beside=True).select("page_id", "clean_text", "other_text")


@query("page_element_counts", """SELECT page_id, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<li>')) AS items,
  len(regexp_extract_all(html, '<a ')) AS anchors, len(regexp_extract_all(html, '<b>')) AS bolds FROM pages""")
def page_element_counts(spark, sf):
    count = lambda tag: F.expr(f"size(filter(tree.elements, e -> e.tag = '{tag}'))")
    return P.parse_pages(V.pages(spark, sf)).select(
        "page_id", count("p").alias("paragraphs"), count("li").alias("items"), count("a").alias("anchors"), count("b").alias("bolds")
    )


@query("page_hints", f"""SELECT page_id, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS title, 1 AS hint_count,
  'Structured extraction hints:' || chr(10) || 'title: ' || trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS block FROM pages""")
def page_hints(spark, sf):
    return H.with_hints(P.parse_pages(V.pages(spark, sf))).select(
        "page_id", F.element_at("hints", "title").alias("title"), F.size("hints").alias("hint_count"), H.hint_block().alias("block")
    )


@query("page_gate", f"""SELECT page_id, CASE WHEN len({_CLEAN}) = 0 THEN 'empty_after_clean' ELSE 'ready' END AS page_status, 0 AS challenge_kinds FROM pages""")
def page_gate(spark, sf):
    rows = _clean_pages(spark, sf)
    verdict = gate.page_gate(F.lit(True), F.lit(False), F.col("clean_text"), F.lit(0))
    return rows.select(
        "page_id", verdict["page_status"].alias("page_status"),
        F.size(gate.shell_markers(F.col("html"))).alias("challenge_kinds"),
    )


# ---------------------------------------------------------------- product pages with known facts


def _hinted(spark, sf):
    parsed = P.with_clean_text(P.parse_pages(V.product_pages(spark, sf))).withColumn("title", P.page_title())
    return H.with_hints(parsed).drop("html", "tree")


def _product_pages(spark, sf):
    """Product pages with clean text and hints, as a stored table."""
    return V.stored(spark, sf, "hinted_products", lambda: _hinted(spark, sf))


@query("product_clean_text", """SELECT p_partkey AS page_id, '# ' || p_name || chr(10) || chr(10) || p_brand || ' ' || p_type || chr(10) || chr(10) || 'Made to order.' || chr(10) || chr(10) ||
  '• size ' || p_size || chr(10) || 'Size | ' || p_size AS clean_text FROM part""")
def product_clean_text(spark, sf):
    return P.with_clean_text(P.parse_pages(V.product_pages(spark, sf))).select("page_id", "clean_text")


@query("product_hints", """SELECT p_partkey AS page_id, p_name AS name, 'USD ' || CAST(p_retailprice AS VARCHAR) AS price, p_brand AS brand, 'InStock' AS availability FROM part""")
def product_hints(spark, sf):
    h = F.col("hints")
    return _hinted(spark, sf).select(
        "page_id", F.coalesce(h["name"], h["title"]).alias("name"), h["price"].alias("price"),
        h["brand"].alias("brand"), h["availability"].alias("availability"),
    )


@query("product_hint_rows", """SELECT p_partkey AS page_id, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS src, 'price' AS field,
  'USD ' || CAST(p_retailprice AS VARCHAR) AS value FROM part""")
def product_hint_rows(spark, sf):
    return all_product_hint_rows(spark, sf).where(F.col("field") == "price")


@query("all_product_hint_rows")
def all_product_hint_rows(spark, sf):
    """As product_hint_rows, for all fields."""
    return H.hint_rows(_product_pages(spark, sf)).select("page_id", "src", "field", "value")


_PRODUCT_PRICE = "'USD ' || regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.?0+$', '')"
_PRICED = "CASE WHEN CAST(p_retailprice AS VARCHAR) LIKE '%.%' THEN " + _PRODUCT_PRICE + " ELSE 'USD ' || CAST(p_retailprice AS VARCHAR) END"


def _extract(spark, sf):
    rows = _product_pages(spark, sf).withColumn("text", F.col("clean_text"))
    return X.cascade(X.with_lines(rows))


def _extracted(spark, sf):
    """Extraction results of the product pages, as a stored table."""
    return V.stored(
        spark, sf, "product_results", lambda: _extract(spark, sf).select("page_id", "url", "result")
    )


@query("product_extraction", f"""SELECT p_partkey AS page_id, 'specialized_rule' AS strategy, 'product' AS page_type, p_name AS name, {_PRICED} AS price, p_brand AS brand, 'in_stock' AS availability FROM part""")
def product_extraction(spark, sf):
    d = F.col("result.data")
    return _extract(spark, sf).select(
        "page_id", "result.strategy", "result.page_type",
        *[F.element_at(d, f).alias(f) for f in ("name", "price", "brand", "availability")],
    )


@query("product_validation", """SELECT p_partkey AS page_id, 'full_success' AS status, true AS is_valid, 1.0::DOUBLE AS completeness, 0.95::DOUBLE AS quality, 1 AS warnings FROM part""")
def product_validation(spark, sf):
    rows = _extracted(spark, sf).select("page_id", "result.*")
    v = F.col("validation")
    return VA.validate_results(rows, "data", "selected", "page_type").select(
        "page_id", v["status"].alias("status"), v["is_valid"].alias("is_valid"), v["completeness"].alias("completeness"),
        F.round(v["quality"], 4).alias("quality"), F.size(v["warnings"]).alias("warnings"),
    )


@query("product_consistency", """SELECT p_partkey AS page_id, 'product' AS expected_type, false AS type_mismatch, '' AS type_mismatch_reason FROM part""")
def product_consistency(spark, sf):
    rows = _product_pages(spark, sf).select(
        "page_id", "selected_fields", "hints", F.col("url").alias("original_url"),
        F.when(F.col("page_id") % 2 == 0, "https://shop1.example.com/login").otherwise(F.col("url")).alias("final_url"),
        F.lit("").alias("repair_reason"), "title",
    )
    return VA.page_type_consistency(rows).select("page_id", "expected_type", "type_mismatch", "type_mismatch_reason")


@query("product_evidence", """SELECT p_partkey AS page_id, 'brand' AS field, p_brand AS evidence FROM part""")
def product_evidence(spark, sf):
    return all_product_evidence(spark, sf).where(F.col("field") == "brand")


@query("all_product_evidence")
def all_product_evidence(spark, sf):
    """As product_evidence, for all fields."""
    rows = VA.field_evidence(H.hint_rows(_product_pages(spark, sf)))
    return rows.select("page_id", "field", F.array_join("evidence", " | ").alias("evidence"))


@query("completed_extraction", f"""SELECT p_partkey AS page_id, p_type AS type, {_PRICED} AS price, 'type' AS completed FROM part""")
def completed_extraction(spark, sf):
    results = _extracted(spark, sf).withColumn(
        "result", F.col("result").withField("selected", F.array_append("result.selected", F.lit("type")))
    )
    supplied = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("page_id"),
        F.create_map(F.lit("type"), F.col("p_type"), F.lit("price"), F.lit("USD 1")).alias("data"),
    )
    return X.complete_missing(results, supplied).select(
        "page_id", F.element_at("result.data", "type").alias("type"), F.element_at("result.data", "price").alias("price"),
        F.array_join("completed", ",").alias("completed"),
    )


@query("page_insights", """SELECT p_partkey AS page_id, p_name AS headline, 4 AS evidence_spans, 'medium' AS confidence FROM part""")
def page_insights(spark, sf):
    return X.insight_rows(_extracted(spark, sf)).select(
        "page_id", "headline", F.size("evidence").alias("evidence_spans"), "confidence"
    )


@query("page_comparison", f"""SELECT p_partkey AS page_id, 'product' AS page_type, p_name AS page_name, {_PRICED} AS price, p_brand AS brand FROM part""")
def page_comparison(spark, sf):
    return X.comparison_rows(_extracted(spark, sf), ["price", "brand"]).select("page_id", "page_type", "page_name", "price", "brand")


# ---------------------------------------------------------------- document text

_LINES = """list_filter(list_transform(regexp_split_to_array(text, '[\\r\\n]+'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '')"""
_NOISE = "structured extraction hints|skip to|main content|cookie|privacy|javascript|menu|search|subscribe|sign in|log in|\\[\\.\\.\\. "
_HEADING_NOISE = "structured extraction hints|skip to|main content|cookie|privacy|subscribe|sign in|log in|menu|search|javascript"
_STRIP = "trim(regexp_replace(s, '^[#>*\\-•\\s]+', ''))"
_LABEL = "regexp_matches(s, '^[^:：]{1,20}\\s*[:：]\\s*\\S+')"
_DOCS = f"""WITH d AS (SELECT doc_id AS page_id, text, {_LINES} AS lines FROM documents),
t AS (SELECT *, coalesce(list_transform(list_filter(lines, lambda s: NOT {_LABEL} AND NOT regexp_matches(lower(s), '{_HEADING_NOISE}')
    AND length({_STRIP}) BETWEEN 4 AND 80 AND NOT regexp_matches(lower(s), '{_NOISE}')), lambda s: {_STRIP})[1],
  list_transform(list_filter(lines[1:1], lambda s: {_STRIP} <> '' AND NOT regexp_matches(lower(s), '{_NOISE}')), lambda s: {_STRIP})[1], '') AS title FROM d)"""


@query("document_lines", f"""SELECT doc_id AS page_id, i - 1 AS line_no, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, {_LINES} AS lines FROM documents))""")
def document_lines(spark, sf):
    return P.page_lines(V.documents(spark, sf), "text").select("page_id", "line_no", "line")


@query("document_rules", _DOCS + f""",
x AS (SELECT *, list_filter(lines, lambda s: s <> title AND NOT {_LABEL} AND length(s) >= 18)[1] AS description,
  nullif(array_to_string(list_filter(lines, lambda s: s <> title AND length(s) >= 16 AND NOT {_LABEL}), chr(10)), '') AS content FROM t)
SELECT page_id, nullif(title, '') AS title, description, content,
  nullif(trim(regexp_replace(coalesce(description, content, text), '\\s+', ' ', 'g')), '') AS summary FROM x""")
def document_rules(spark, sf):
    rows = X.with_lines(V.documents(spark, sf)).withColumn(
        "fields", F.array(*[F.lit(f) for f in ("title", "description", "content", "summary")])
    )
    d = F.col("rule_data")
    return X.rule_extract(rows).select(
        "page_id", *[F.element_at(d, f).alias(f) for f in ("title", "description", "content", "summary")]
    )


@query("document_page_types", """WITH d AS (SELECT doc_id AS page_id, lower(text) AS t FROM documents)
SELECT page_id, CASE WHEN regexp_matches(t, '价格|售价|商品|品牌|库存|规格|product|offer') THEN 'product'
  WHEN regexp_matches(t, '任职要求|岗位职责|职位描述|薪资|工作地点|jobposting|hiringorganization') THEN 'job'
  WHEN regexp_matches(t, 'pricing|price|plan|tier|套餐|订阅|月付|年付') THEN 'pricing'
  WHEN regexp_matches(t, '政策|法规|规章|条例|文号|发布机关|legislation|policy') THEN 'policy'
  WHEN regexp_matches(t, '公告|通知|公示|发文|机构|notice') THEN 'notice'
  WHEN regexp_matches(t, 'newsarticle|article|新闻|资讯|发布于') THEN 'news' ELSE 'article' END AS page_type FROM d""")
def document_page_types(spark, sf):
    rows = V.documents(spark, sf).withColumn("selected_fields", F.array().cast("array<string>"))
    return X.resolve_page_type(rows).select("page_id", "page_type")


@query("document_extraction")
def document_extraction(spark, sf):
    """The whole cascade over every document."""
    rows = X.with_lines(V.documents(spark, sf)).withColumn("selected_fields", F.array().cast("array<string>")).withColumn(
        "hints", F.expr(X.EMPTY_MAP)
    )
    return X.cascade(rows).select(
        "page_id", "result.strategy", "result.page_type", F.size("result.data").alias("filled"),
        F.element_at("result.data", "title").alias("title"),
    )


@query("document_label_values")
def document_label_values(spark, sf):
    """Label lines of every document joined with the alias dictionary."""
    return X.label_values(P.page_lines(V.documents(spark, sf), "text"))


@query("order_label_values", """SELECT o_orderkey AS page_id, field, line_no, value FROM orders, LATERAL (SELECT unnest(['price', 'date', 'publish_date', 'availability']) AS field, unnest([0, 1, 1, 3]) AS line_no,
  unnest(['$' || CAST(o_totalprice AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m-%d'), 'in stock']) AS value)""")
def order_label_values(spark, sf):
    text = F.concat(
        F.lit("Price: $"), "o_totalprice", F.lit("\ndate："), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit("\nprice: $1\nStatus : in stock\nunknown: value"),
    )
    rows = V.wide_table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), text.alias("text"))
    return X.label_values(P.page_lines(rows, "text")).select("page_id", "field", "line_no", "value")


@query("best_prices", """SELECT o_orderkey AS page_id, '$' || printf('%.2f', o_orderkey % 90000 + 0.25) AS price FROM orders""")
def best_prices(spark, sf):
    key = F.col("o_orderkey")
    text = F.concat(
        F.lit("about 12 monthly or $"), (key % 90000 + 100000), F.lit(" list, now $"),
        F.format_string("%.2f", (key % 90000 + 0.25)), F.lit(" only, 300 USD deposit"),
    )
    rows = V.wide_table(spark, sf, "orders").select(key.alias("page_id"), text.alias("text"))
    return rows.select("page_id", F.expr(X.best_price_sql()).alias("price"))


@query("model_results", """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 4 = 1 THEN 'article' ELSE 'product' END AS page_type,
  CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_name END AS name FROM part""")
def model_results(spark, sf):
    key = F.col("p_partkey")
    wrapped = F.to_json(F.struct(F.lit("product").alias("page_type"), F.struct(F.col("p_name").alias("name")).alias("data")))
    answer = (
        F.when(key % 4 == 0, wrapped)
        .when(key % 4 == 1, F.to_json(F.struct(F.col("p_name").alias("name"))))
        .when(key % 4 == 2, F.concat(F.lit("Here it is: "), wrapped, F.lit(" done")))
        .otherwise(F.lit('{"page_type": "product", "data": {"name": ""}}'))
    )
    rows = V.wide_table(spark, sf, "part").select(
        key.alias("page_id"), answer.alias("model_json"), F.array(F.lit("name")).alias("selected_fields")
    )
    return X.read_model_result(rows).select(
        "page_id", "model.page_type", F.element_at("model.data", "name").alias("name")
    )


@query("run_validation", S.with_(S.RUNS, """v AS (SELECT run_id, ((price IS NOT NULL)::INT + (stock IS NOT NULL)::INT + (rating IS NOT NULL)::INT + (coalesce(note, '') <> '')::INT) AS filled,
  concat_ws(',', CASE WHEN stock IS NULL THEN 'stock' END, CASE WHEN rating IS NULL THEN 'rating' END, CASE WHEN note = '' THEN 'note' END) AS missing FROM runs WHERE status = 'success')""") + """
SELECT run_id, filled / 4.0::DOUBLE AS completeness, CASE WHEN filled = 4 THEN 'full_success' ELSE 'partial_success' END AS status, missing,
  round(filled / 4.0::DOUBLE - CASE WHEN filled < 2 THEN 0.05::DOUBLE ELSE 0 END, 4) AS quality FROM v""")
def run_validation(spark, sf):
    rows = V.typed(spark, sf).where(F.col("status") == "success").select(
        "run_id", F.col("entries").alias("data"), F.col("doc.selected_fields").alias("selected_fields"), F.lit("listing").alias("page_type")
    )
    v = F.col("validation")
    return VA.validate_results(rows).select(
        "run_id", v["completeness"].alias("completeness"), v["status"].alias("status"),
        F.array_join(v["missing"], ",").alias("missing"), F.round(v["quality"], 4).alias("quality"),
    )


@query("stored_validation", S.with_(S.RUNS) + """SELECT run_id, vstatus AS status, true AS is_valid, coalesce(completeness, 0.0) AS completeness,
  CASE status WHEN 'queued' THEN 0 WHEN 'failed' THEN 4 ELSE (price IS NULL)::INT + (stock IS NULL)::INT + (rating IS NULL)::INT + (note = '')::INT END AS missing FROM runs""")
def stored_validation(spark, sf):
    v = R.validation_summary()
    return V.typed(spark, sf).select(
        "run_id", v["status"].alias("status"), v["is_valid"].alias("is_valid"), v["completeness"].alias("completeness"),
        F.size(v["missing_fields"]).alias("missing"),
    )


@query("page_links", f"""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/c/' || page_id AS canonical, 'https://og.example.com/' || page_id AS og_url FROM pages""")
def page_links(spark, sf):
    """F44 on pages that got a canonical link and an og:url."""
    tags = F.concat(
        F.lit('<link rel="Canonical" href="/c/'), "page_id", F.lit('"><meta name="og:url" content="https://og.example.com/'), "page_id", F.lit('"></head>')
    )
    rows = V.pages(spark, sf).withColumn("html", F.replace("html", F.lit("</head>"), tags))
    return P.parse_pages(rows).select("page_id", P.canonical_url(F.col("url")).alias("canonical"), P.og_url(F.col("url")).alias("og_url"))


@query("mojibake_documents", """SELECT doc_id, marks >= 2 OR (bad > 0 AND bad / length(text)::DOUBLE >= 0.02) OR (contains(text, 'Ã') AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 2) AS mojibake
FROM (SELECT doc_id, text, length(text) - length(replace(text, '�', '')) AS bad, length(text) - length(translate(text, '�鍚鍟鍏鐞锟麓涓绻Ãâ', '')) AS marks FROM documents WHERE length(trim(text)) >= 4)
UNION ALL SELECT doc_id, false FROM documents WHERE length(trim(text)) < 4""")
def mojibake_documents(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", VA.looks_like_mojibake(F.col("text")).alias("mojibake"))


@query("range_rejects", """SELECT p_partkey, concat_ws(',', CASE WHEN p_size / 8.0 > 5 THEN 'rating' END, CASE WHEN p_size - 3 < 0 THEN 'review_count' END, CASE WHEN p_retailprice / 2000 > 1 THEN 'confidence' END) AS rejected_by FROM part""")
def range_rejects(spark, sf):
    rows = V.table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") / 8.0).alias("rating"), (F.col("p_size") - 3).alias("review_count"), (F.col("p_retailprice") / 2000).alias("confidence")
    )
    return VA.range_checks(rows).select("p_partkey", F.array_join("rejected_by", ",").alias("rejected_by"))


# ---------------------------------------------------------------- scalar normalisers on built texts


@query("normalized_prices", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'USD ' WHEN 1 THEN 'EUR ' WHEN 2 THEN 'GBP ' WHEN 3 THEN 'CNY ' ELSE '' END ||
  CASE WHEN CAST(p_retailprice AS VARCHAR) LIKE '%.%' THEN regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.?0+$', '') ELSE CAST(p_retailprice AS VARCHAR) END ||
  CASE p_partkey % 4 WHEN 0 THEN ' per month' WHEN 1 THEN ' per year' WHEN 2 THEN ' per seat/month' ELSE '' END AS price FROM part""")
def normalized_prices(spark, sf):
    key = F.col("p_partkey")
    pick = lambda items, n: F.element_at(F.array(*[F.lit(i) for i in items]), (key % n + 1).cast("int"))
    text = F.concat(
        pick(("From ", "", "starting at  ", "as low as "), 4), pick(("$", "€", "£", "￥", ""), 5),
        F.col("p_retailprice").cast("string"), pick((" /mo", " annually", " per seat / month", " "), 4),
    )
    return V.table(spark, sf, "part").select("p_partkey", T.normalize_price(text).alias("price"))


@query("normalized_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN 'sometime in 1999' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def normalized_dates(spark, sf):
    key, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(key % 6 == 0, F.date_format(d, "yyyy/M/d"))
        .when(key % 6 == 1, F.concat(F.lit("on "), F.date_format(d, "d MMM yyyy"), F.lit(" at noon")))
        .when(key % 6 == 2, F.date_format(d, "MMMM d, yyyy"))
        .when(key % 6 == 3, F.date_format(d, "yyyy年M月d日"))
        .when(key % 6 == 4, F.date_format(d, "d MMM, yy"))
        .otherwise(F.lit("sometime  in 1999"))
    )
    return V.table(spark, sf, "orders").select("o_orderkey", T.normalize_date(text).alias("day"))


@query("normalized_fields", """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'in_stock' WHEN 'N' THEN 'out_of_stock' ELSE 'preorder' END AS stock,
  CASE WHEN l_linenumber % 2 = 0 THEN 'per user/month' ELSE 'per year' END AS period, l_linenumber || 'k-' || (l_linenumber + 5) || 'k/year' AS salary,
  'x ' || l_linestatus AS other FROM lineitem""")
def normalized_fields(spark, sf):
    number = F.col("l_linenumber")
    stock = F.when(F.col("l_returnflag") == "A", "Available now").when(F.col("l_returnflag") == "N", "currently unavailable").otherwise("Pre-order today")
    period = F.when(number % 2 == 0, "billed monthly per user").otherwise("paid annually")
    salary = F.concat(number, F.lit("k ~ "), number + 5, F.lit("k / year"))
    return V.wide_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        T.normalize_field_value(F.lit("stock"), stock).alias("stock"),
        T.normalize_field_value(F.lit("billing_period"), period).alias("period"),
        T.normalize_field_value(F.lit("salary_range"), salary).alias("salary"),
        T.normalize_field_value(F.lit("other"), F.concat(F.lit(" x \t"), "l_linestatus")).alias("other"),
    )


@query("token_estimates", """SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 0 ELSE greatest(length(text) // 4, 1) END AS tokens FROM conversations""")
def token_estimates(spark, sf):
    return V.table(spark, sf, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"))


@query("keyword_counts", """SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(p_name || ', ' || p_type || '/' || p_brand, '[\\s,，;；、/|]+'), lambda w: w <> '')) AS word FROM part) GROUP BY 1""")
def keyword_counts(spark, sf):
    text = F.concat("p_name", F.lit(", "), "p_type", F.lit("/"), "p_brand")
    return V.table(spark, sf, "part").select(F.explode(T.split_keywords(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("formatted_products", """SELECT p_partkey, '“品名”：“' || p_name || '”' || chr(10) || '“brand”：“' || p_brand || '”' AS block FROM part""")
def formatted_products(spark, sf):
    entries = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("note"), F.lit(""))
    names = F.array(F.lit("name"), F.lit("note"), F.lit("brand"))
    return V.table(spark, sf, "part").select(
        "p_partkey", T.formatted_lines(F.create_map(F.lit("name"), F.lit("品名")), names, entries).alias("block")
    )


@query("lenient_objects", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_name END AS name FROM part""")
def lenient_objects(spark, sf):
    body = F.to_json(F.struct(F.col("p_name").alias("name")))
    text = F.when(F.col("p_partkey") % 3 == 0, body).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Sure: "), body, F.lit("."))).otherwise("{broken")
    return V.table(spark, sf, "part").select("p_partkey", F.element_at(T.lenient_object(text), "name").alias("name"))


# ---------------------------------------------------------------- URLs

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_SLUG = f"regexp_extract({_PATH}, '([^/]*)/*$', 1)"


@query("url_parts", f"""SELECT page_id, {_HOST} AS domain, '/' || array_to_string(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')[1:2], '/') AS prefix, {_SLUG} AS slug,
  array_to_string(list_sort(list_distinct(regexp_extract_all(lower({_PATH}), '[a-z0-9]{{3,}}'))), ',') AS tokens, '' AS intent FROM pages""")
def url_parts(spark, sf):
    u = F.col("url")
    return V.table(spark, sf, "pages").select(
        "page_id", U.extract_domain(u).alias("domain"), U.path_prefix(u).alias("prefix"), U.path_slug(u).alias("slug"),
        F.array_join(F.array_sort(U.path_tokens(u)), ",").alias("tokens"), U.url_intent(u).alias("intent"),
    )


@query("url_variants", f"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, {_PATH} AS path, regexp_extract(url, '^[a-z]+://[^/?#]*[^?#]*(.*)$', 1) AS tail FROM pages)
SELECT DISTINCT page_id, variant FROM (SELECT page_id, url, unnest([scheme || '://' || host || CASE WHEN path LIKE '%/' THEN rtrim(path, '/') ELSE path || '/' END || tail, scheme || '://' || host || '/m' || path || tail,
  scheme || '://' || CASE WHEN host LIKE 'www.%' THEN host[5:] ELSE 'www.' || host END || path || tail]) AS variant FROM u) WHERE variant <> url""")
def url_variants(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", F.explode(U.url_variants(F.col("url"))).alias("variant"))


@query("first_seen_urls", """SELECT sha256(trim(url)) AS url_hash, min(event_id) AS event_id, any_value(url) AS url FROM (SELECT event_id, 'https://site' || (user_id % 20) || '.example.com/p/' || user_id AS url FROM events) GROUP BY 1""")
def first_seen_urls(spark, sf):
    rows = V.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("https://site"), F.col("user_id") % 20, F.lit(".example.com/p/"), "user_id", F.lit(" ")).alias("url")
    )
    return L.first_seen_urls(rows, "event_id").withColumn("url", F.trim("url"))


@query("seen_urls", """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 AS seen FROM events""")
def seen_urls(spark, sf):
    rows = V.table(spark, sf, "events").select("event_id", F.concat(F.lit("https://h/"), "user_id").alias("url"))
    return L.flag_seen_urls(rows, "event_id").select("event_id", "seen")


@query("sitemap_repairs", f"""WITH m AS (SELECT {_HOST} AS host, lower({_SLUG}) AS slug, 'http://' || {_HOST} || '/new/section/' || {_SLUG} AS loc, page_id FROM pages),
f AS (SELECT host, slug, arg_min(loc, page_id) AS loc FROM m WHERE slug <> '' GROUP BY 1, 2)
SELECT p.page_id, f.loc AS repaired_url, f.loc IS NOT NULL AS safe FROM pages p LEFT JOIN f ON f.host = lower(regexp_extract(p.url, '^[a-z]+://([^/?#]*)', 1)) AND f.slug = lower(regexp_extract(regexp_extract(p.url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)/*$', 1))""")
def sitemap_repairs(spark, sf):
    u = F.col("url")
    pages = V.table(spark, sf, "pages").select("page_id", "url")
    maps = pages.select(
        F.col("page_id").alias("map_id"), u.alias("base"),
        F.concat(F.lit("<urlset><url><LOC> http://"), U.extract_domain(u), F.lit("/new/section/"), U.path_slug(u), F.lit(" </LOC></url></urlset>")).alias("text"),
    )
    locs = L.sitemap_urls(maps).withColumn("position", F.col("map_id"))
    return L.repair_from_sitemap(pages, locs).select("page_id", "repaired_url", "safe")


@query("feed_pages", f"""SELECT page_id, '<html><body>' || '<h1>Item & ' || page_id || '</h1>' || chr(10) || '<time>2024-01-01</time>' || chr(10) || '<article>About it</article>' || chr(10) ||
  '<link rel="canonical" href="' || url || '">' || '</body></html>' AS html FROM (SELECT page_id, 'https://f' || page_id || '.example.com/a/' || {_SLUG} AS url FROM pages)""")
def feed_pages(spark, sf):
    pages = V.table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("https://f"), "page_id", F.lit(".example.com/a/"), U.path_slug(F.col("url"))).alias("url")
    )
    feeds = pages.select(
        F.concat(
            F.lit("<rss><item><title>Item &amp; "), "page_id", F.lit("</title><pubDate>2024-01-01</pubDate><description><![CDATA[About <b>it</b>]]></description><link>"),
            "url", F.lit("</link></item></rss>"),
        ).alias("text")
    )
    return L.pages_from_feed(pages, L.feed_items(feeds)).select("page_id", "html")


@query("site_policies", f"""SELECT page_id, CASE WHEN {_HOST} LIKE 'www.%' THEN 2 END AS max_concurrency FROM pages""")
def site_policies(spark, sf):
    pages = V.table(spark, sf, "pages").select("page_id", "url")
    policies = (
        pages.select(U.extract_domain(F.col("url")).alias("domain"))
        .where(F.col("domain").startswith("www."))
        .distinct()
        .withColumn("max_concurrency", F.lit(2))
    )
    return L.with_site_policy(pages, policies, ["max_concurrency"]).select("page_id", "max_concurrency")


@query("url_mismatches", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'product_host_changed' WHEN 2 THEN 'product_redirected_to_generic_page' ELSE '' END AS reason,
  p_partkey % 4 = 0 AS safe FROM part""")
def url_mismatches(spark, sf):
    key = F.col("p_partkey")
    original = F.concat(F.lit("https://www.shop.example.com/product/"), key)
    final = (
        F.when(key % 4 == 0, F.concat(F.lit("https://shop.example.com/product/"), key, F.lit("/")))
        .when(key % 4 == 1, F.lit("https://other.example.com/product/x"))
        .when(key % 4 == 2, F.lit("https://shop.example.com/login?next=1"))
        .otherwise(F.lit("https://shop.example.com/category/1"))
    )
    title = F.when(key % 4 == 3, "Buy parts").otherwise("Welcome")
    return V.table(spark, sf, "part").select(
        "p_partkey", U.page_type_mismatch(original, final, title).alias("reason"), U.is_safe_repair(original, final).alias("safe")
    )


@query("challenge_texts", """SELECT doc_id, regexp_matches(lower(text), '安全验证|人机验证|验证码|异常访问|访问受限|verify you are human|captcha|checking your browser|enable javascript|enable cookies|press and hold|just a moment|access denied|suspicious traffic|unusual traffic|blocked due to suspicious activity|ddos protection|ray id|cloudflare|cf-chl|robot check|security check|attention required|please wait while we verify') AS challenge,
  length(trim(text)) <= 80 AND regexp_matches(lower(text), '加载中|请稍候|loading|initializing') AS loading FROM documents""")
def challenge_texts(spark, sf):
    t = F.col("text")
    return V.table(spark, sf, "documents").select(
        "doc_id", gate.has_challenge_text(t).alias("challenge"), gate.is_loading_text(t).alias("loading")
    )


@query("challenge_assessment", """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'challenge_page' WHEN user_id % 3 = 1 AND event_id % 2 = 0 THEN 'http_403' WHEN user_id % 3 = 1 THEN 'transport_error' WHEN event_id % 5 = 0 THEN 'shell_page' ELSE '' END AS reason,
  CASE WHEN user_id % 3 = 1 AND event_id % 2 = 0 THEN 'blocked' ELSE '' END AS status_class FROM events""")
def challenge_assessment(spark, sf):
    user, event = F.col("user_id"), F.col("event_id")
    headers = F.when(user % 3 == 0, F.create_map(F.lit("Server"), F.lit("Cloudflare"))).otherwise(F.create_map(F.lit("Server"), F.lit("nginx")))
    text = F.when((user % 3 == 2) & (event % 5 == 0), "Loading...").otherwise("plain words of a page")
    code = F.when((user % 3 == 1) & (event % 2 == 0), 403).otherwise(200)
    error = F.when((user % 3 == 1) & (event % 2 == 1), "Connection reset by peer").otherwise("")
    from pagetide.functions.classify import http_status_class

    return V.table(spark, sf, "events").select(
        "event_id", gate.assess_challenge(text, headers, code, error)["reason"].alias("reason"), http_status_class(code).alias("status_class")
    )
