"""Page cleaning and hints on small pages."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from pagetide.functions import page_tree
from pagetide.operators import hints as H
from pagetide.operators import pages as P


def frame(spark, *pages):
    return P.parse_pages(spark.createDataFrame([(i, "https://a.com/b/c", p) for i, p in enumerate(pages)], "page_id LONG, url STRING, html STRING"))


def clean(spark, html, **options):
    return P.with_clean_text(frame(spark, html), **options).first()["clean_text"]


PAGE = """<html><head><title>T</title><script>var x = "</p>";</script><style>b{}</style></head><body><nav>go</nav><header>top</header>
<main><h1>Heading</h1><p>First &amp; last</p><ul><li>one<li>two</ul><table><tr><th>A<th>B<tr><td>1<td>2</table></main>
<footer>end</footer><aside>side</aside></body></html>"""


def test_structure_and_dropped_tags(spark):
    assert clean(spark, PAGE) == "# Heading\n\nFirst & last\n\n• one\n• two\nA | B\n1 | 2"


def test_plain_mode(spark):
    assert clean(spark, PAGE, keep_structure=False).split("\n") == ["T", "Heading", "First & last", "one", "two", "A", "B", "1", "2"]


@pytest.mark.parametrize("html,want", [("", ""), ("   ", ""), ("<body><script>a()</script></body>", ""), ("<div>" * 20 + "deep" + "</div>" * 20, "deep")])
def test_edges(spark, html, want):
    assert clean(spark, html) == want


def test_hidden_noise_and_comments(spark):
    html = '<div><!-- note --><p style="DISPLAY: none">no</p><p class="menu x">no</p><p id="toc1">no</p><p role="banner">no</p><p class="menus">yes</p></div>'
    assert clean(spark, html) == "yes"


def test_regions(spark):
    assert clean(spark, PAGE, selector="nav") == ""  # the region itself is a dropped tag
    assert clean(spark, "<nav><p>go</p></nav>", selector="p") == "go"  # what encloses a region does not matter
    assert clean(spark, '<div class="a b"><p>in</p></div><p>out</p>', selector=".b") == "in"
    assert clean(spark, '<div id="k"><p>in</p></div><p>out</p>', selector="#k") == "in"
    assert clean(spark, "<p>all</p>", selector=".none") == "all"


def test_job_blocks_win_over_the_rest(spark):
    jobs = "".join(f'<div class="job-info">Engineer number {i}</div>' for i in range(3))
    assert clean(spark, f"<p>noise text here</p>{jobs}") == "\n\n".join(f"Engineer number {i}" for i in range(3))
    assert clean(spark, '<p>kept</p><div class="job-info">Engineer number 1</div>') == "kept"
    nested = '<ul class="job-list-x">' + "".join(f'<li class="a-job">Nested posting {i}</li>' for i in range(3)) + "</ul>"
    assert clean(spark, nested) == "\n\n".join(f"Nested posting {i}" for i in range(3))


def truncated(text, most):
    """The truncation rule, written row by row."""
    if len(text) <= most:
        return text
    head, mark = text[:most], "\n\n[... 内容已截断 ...]"
    cut = head.rfind("\n\n")
    if cut > most * 0.7:
        return head[:cut].strip() + mark
    for end in "。.！!？?":
        cut = head.rfind(end)
        if cut > most * 0.8:
            return head[: cut + 1].strip() + mark
    cut = head.rfind("\n")
    return (head[:cut] if cut > most * 0.8 else head).strip() + mark


def test_truncation_equals_row_rule(spark):
    texts = ["short", "a" * 30, "word. " * 9, "one\n\ntwo\n\nthree four five six", "aaaa bbbb cccc dddd\nee ff", "问。" * 20, "line one is here\nand\nmore"]
    rows = spark.createDataFrame([(t,) for t in texts], ["t"]).select("t", P.smart_truncate(F.col("t"), 20).alias("got")).collect()
    assert [r.got for r in rows] == [truncated(r.t, 20) for r in rows]


def test_whole_table_truncation(spark):
    rows = P.with_clean_text(P.parse_pages(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")))
    both = rows.select("clean_text", P.smart_truncate(F.col("clean_text"), 2000).alias("got")).collect()
    assert all(r.got == truncated(r.clean_text, 2000) for r in both)


def hints(spark, html):
    return H.with_hints(frame(spark, html)).first()


def script(body, attrs='type="application/json"'):
    return f"<html><head><script {attrs}>{body}</script></head><body></body></html>"


def test_linked_data_wins_and_candidates_stay(spark):
    row = hints(spark, '<meta property="product:price:amount" content="19.99"><meta property="product:price:currency" content="USD">' + script(
        '{"@type": "Product", "name": "W", "brand": {"name": "Acme"}, "description": "A tool.", "offers": [{"price": "29.99", "priceCurrency": "USD", "availability": "https://schema.org/InStock"}]}',
        'type="application/ld+json"'))
    assert row.hints["price"] == "USD 29.99" and row.hints["availability"] == "InStock" and row.hints["brand"] == "Acme"
    assert row.hint_candidates["price"] == ["USD 29.99", "USD 19.99"]


def test_job_posting_salary(spark):
    row = hints(spark, script('{"@type": "JobPosting", "title": "Engineer", "hiringOrganization": {"name": "Acme"}, "jobLocation": {"name": "Remote"}, "baseSalary": {"currency": "USD", "value": {"minValue": 1000, "maxValue": 2000, "unitText": "YEAR"}}}', 'type="application/ld+json"'))
    assert row.hints["salary_range"] == "USD 1000-2000 YEAR" and row.hints["company"] == "Acme" and row.hints["location"] == "Remote"


def test_variants(spark):
    row = hints(spark, script('window.ShopifyAnalytics = window.ShopifyAnalytics || {}; window.ShopifyAnalytics.meta = {"product": {"title": "W", "vendor": "Acme", "variants": [{"price": "1299", "available": true}]}};', ""))
    assert (row.hints["name"], row.hints["price"], row.hints["availability"], row.hints["brand"]) == ("W", "1299", "True", "Acme")


def test_job_systems(spark):
    row = hints(spark, script('{"posting": {"jobPostingTitle": "Lead", "locationsText": "Berlin", "jobRequisitionId": "WD-1", "description": "Own data"}, "lever": {"text": "X", "categories": {"commitment": "Full-time", "location": "US"}, "id": "L"}}'))
    assert row.hints["title"] == "Lead" and row.hints["location"] == "Berlin" and row.hints["job_id"] == "WD-1"
    assert row.hints["employment_type"] == "Full-time" and row.hints["requirements"] == "Own data" and row.hints["job_page_kind"] == "detail"


def test_job_list_card(spark):
    row = hints(spark, script('{"jobs": [{"jobTitle": "B", "jobNumber": "1", "metadata": [{"label": "Salary", "value": "10k"}]}, {"jobTitle": "D", "jobNumber": "2"}]}'))
    assert row.hints["ats_platform"] == "icims" and row.hints["title"] == "B" and row.hints["salary_range"] == "10k"


def test_pricing_tiers(spark):
    row = hints(spark, script('{"plans": [{"planName": "Free", "price": "0", "currency": "USD", "billingPeriod": "month"}, {"planName": "Enterprise", "customPricing": "Contact"}]}'))
    assert (row.hints["plan"], row.hints["price"], row.hints["free_tier"], row.hints["enterprise_tier"]) == ("Free", "USD 0", "Free", "Enterprise")


def test_microdata_and_meta(spark):
    row = hints(spark, '<title>Page</title><meta name="author" content="A"><meta property="og:title" content="Shared"><span itemprop="price" content="5"></span><span itemprop="priceCurrency">EUR</span><b itemprop="name">N</b>')
    assert row.hints == {"title": "Shared", "author": "A", "price": "EUR 5", "name": "N"}


def test_broken_json_is_skipped(spark):
    assert hints(spark, script("{oops", 'type="application/ld+json"')).hints == {}


def test_links(spark):
    df = frame(spark, '<link rel="canonical" href="/x"><meta property="og:url" content="y">')
    row = df.select(P.canonical_url(F.col("url")).alias("c"), P.og_url(F.col("url")).alias("o")).first()
    assert (row.c, row.o) == ("https://a.com/x", "https://a.com/b/y")


def test_whole_hints_blocks_and_lines_are_kept(spark):
    body = "long article text " * 300
    cards = "".join(f'<div class="job-card">Job number {k} in a large city</div>' for k in range(100))
    pages = [
        (1, f'<script type="application/ld+json">{{"@type": "Article", "articleBody": "{body}"}}</script><p>x</p>'),
        (2, f"<div>{cards}</div>"),
    ]
    rows = P.parse_pages(spark.createDataFrame([(i, "http://a.example/", h) for i, h in pages], "page_id int, url string, html string"))
    found = {r["page_id"]: r for r in H.with_hints(P.with_clean_text(rows)).select("page_id", "clean_text", "hints").collect()}
    assert found[1]["hints"]["content"] == body.strip()
    assert found[2]["clean_text"].count("Job number") == 100


def test_rows_of_a_long_table_take_linear_time(spark):
    import time

    def seconds(n):
        table = "<table>" + "".join("<tr>" + "".join(f"<td>cell {k} {c}</td>" for c in range(5)) + "</tr>" for k in range(n)) + "</table>"
        rows = P.with_clean_text(P.parse_pages(spark.createDataFrame([(1, "http://a.example/", table)], "page_id int, url string, html string")))
        start = time.perf_counter()
        text = rows.select("clean_text").first()[0]
        assert text.count(" | ") == 4 * n
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 5 * seconds(8_000) + 2


def test_only_a_piece_of_a_batch_is_nodes_at_a_time(monkeypatch):
    monkeypatch.setattr(page_tree, "PIECE_CHARS", 100)
    texts = pa.array(["x" * 40] * 5 + [None, "", "y" * 300, "z"])
    parsed = []

    def parse(text):
        parsed.append(text)
        return len(text or "")

    out = page_tree._in_pieces(iter([texts, texts.slice(0, 0)]), pc.utf8_length, parse, pa.int32())
    assert next(out).to_pylist() == [40, 40] and len(parsed) == 2
    rest = [a.to_pylist() for a in out]
    assert rest == [[40, 40], [40, 0, 0], [300], [1], []]


def test_pages_in_pieces_are_those_of_one_batch(spark):
    html = [None, "", PAGE, "<p a=1>x" * 30, "<div>" * 3] * 40
    rows = spark.createDataFrame(list(enumerate(html)), "page_id LONG, html STRING").repartition(2)

    def trees():
        return {r["page_id"]: r["tree"] for r in rows.withColumn("tree", page_tree.page_tree(F.col("html"))).collect()}

    whole = trees()
    page_tree.PIECE_CHARS, before = 50, page_tree.PIECE_CHARS
    try:
        assert trees() == whole and len(whole) == 200
    finally:
        page_tree.PIECE_CHARS = before
    assert whole[0]["elements"] == [] and whole[3]["elements"][0]["attrs"] == {} and whole[2]["elements"][0]["tag"] == "html"
