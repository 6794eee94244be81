"""Sources, sinks and extension points exercised over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pagetide.functions.sql_functions import register_sql_functions
from pagetide.operators import changes, extension, kpi, pages as P
from pagetide.plans import sql_views as S
from pagetide.plans import views as V
from pagetide.plans.registry import day_text, query
from pagetide.plans.run_queries import _PAIRS, _usage
from pagetide.operators import links as L
from pagetide.sources import collection, readers, schemas, sinks
from pagetide.streaming.jobs import upsert_usage
from pagetide.streaming.state import shared_folder


@query("url_list", "SELECT url FROM pages WHERE page_id % 3 = 0")
def url_list(spark, sf):
    """S01 on a URL list file written from the pages table."""
    folder = shared_folder(spark, "urls")
    key = F.col("page_id")
    line = F.when(key % 3 == 0, F.concat(F.lit("  "), "url", F.lit(" "))).when(key % 3 == 1, F.concat(F.lit("# "), "url")).otherwise("   ")
    V.table(spark, sf, "pages").select(line.alias("value")).write.text(folder)
    return readers.read_url_list(spark, folder)


@query("labelled_samples", """SELECT url, CASE WHEN page_id % 2 = 0 THEN 'product' ELSE 'auto' END AS page_type, 'name,price' AS selected_fields, CASE WHEN page_id % 4 = 0 THEN 'x' ELSE '' END AS expected_name,
  CASE WHEN page_id % 5 = 0 THEN 1 ELSE CAST(page_id % 5 AS INTEGER) END AS min_fields, 'held_out' AS split, page_id % 3 = 0 AS dynamic FROM pages""")
def labelled_samples(spark, sf):
    """S02 on a CSV file written from the pages table."""
    folder = shared_folder(spark, "samples") + ".csv"
    key = F.col("page_id")
    V.table(spark, sf, "pages").select(
        "url", F.when(key % 2 == 0, "product").otherwise("").alias("page_type"), F.lit(" name, ,price ").alias("selected_fields"),
        F.when(key % 4 == 0, '{"name": "x"}').otherwise("not json").alias("expected_fields"),
        F.when(key % 5 == 0, "").otherwise((key % 5).cast("string")).alias("minimum_fields"),
        F.when(key % 3 == 0, "Yes").otherwise("no").alias("dynamic"),
    ).write.option("escape", '"').csv(folder, header=True)
    rows = readers.read_samples(spark, folder, split="held_out")
    return rows.select(
        "url", "page_type", F.array_join("selected_fields", ",").alias("selected_fields"),
        F.coalesce(F.element_at("expected_fields", "name"), F.lit("")).alias("expected_name"), "min_fields", "split", "dynamic",
    )


@query("declared_schema", """SELECT p_partkey, CASE WHEN p_partkey % 4 <> 3 THEN p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'none' END AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE 0 END AS rating,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS BIGINT) ELSE 0 END AS reviews, CASE WHEN p_partkey % 4 <> 3 THEN '' ELSE 'name' END AS missing FROM part""")
def declared_schema(spark, sf):
    declared, defaults = schemas.parse_declared(
        {"fields": {
            "name": {"type": "str", "required": True}, "brand": {"type": "string", "default": "none"},
            "rating": {"type": "number"}, "reviews": {"type": "int"}, "tags": {"type": "list[str]"},
        }}
    )
    key = F.col("p_partkey")
    even = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("rating"), F.col("p_size").alias("reviews"), F.lit("x").alias("extra")))
    payload = F.when(key % 2 == 0, even).when(key % 4 == 1, F.to_json(F.struct(F.col("p_name").alias("name")))).otherwise("{}")
    rows = V.table(spark, sf, "part").select("p_partkey", payload.alias("payload"))
    return schemas.apply_schema(rows, declared, defaults).select(
        "p_partkey", "name", "brand", "rating", "reviews", F.array_join("missing_required", ",").alias("missing")
    )


def _records(spark, sf):
    rows = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.split("p_name", " ").alias("words"),
        F.create_map(F.lit("brand"), F.col("p_brand")).alias("facts"),
    )
    return sinks.with_meta(
        rows, F.concat(F.lit("https://h/"), "id"), F.lit("rules"), F.lit(0.5), F.length("name"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    )


@query("json_collection", "SELECT p_partkey AS id, p_name AS name, len(string_split(p_name, ' ')) AS words, p_brand AS brand, 'https://h/' || p_partkey AS source_url, 0.5::DOUBLE AS confidence FROM part")
def json_collection(spark, sf):
    folder = shared_folder(spark, "json")
    records = _records(spark, sf)
    sinks.append_json(records, folder)
    back = spark.read.schema(records.schema).json(folder)
    return back.select(
        "id", "name", F.size("words").alias("words"), F.element_at("facts", "brand").alias("brand"),
        F.col("_meta.source_url").alias("source_url"), F.col("_meta.confidence_score").alias("confidence"),
    )


@query("csv_collection", """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, replace(p_name, ' ', ', ') AS words, '{"brand":"' || p_brand || '"}' AS facts, 'rules' AS _model, '' AS color FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, '', '', '', p_type FROM part""")
def csv_collection(spark, sf):
    folder = shared_folder(spark, "csv")
    first = sinks.write_csv_collection(_records(spark, sf), folder)
    more = V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("color"))
    second = sinks.write_csv_collection(more, folder)
    return sinks.read_csv_collection(spark, [first, second]).select("id", "name", "words", "facts", "_model", "color")


@query("table_collection", "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, NULL AS color FROM part UNION ALL SELECT p_partkey, p_name, NULL, p_type FROM part")
def table_collection(spark, sf):
    folder = shared_folder(spark, "table")
    part = V.table(spark, sf, "part")
    sinks.append_table(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")), folder)
    sinks.append_table(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("color")), folder)
    return sinks.read_table(spark, folder).select("id", "name", "brand", "color")


@query("collection_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 200")
def collection_page(spark, sf):
    return sinks.page_of(V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 50, 200)


@query("collection_count", "SELECT count(*) AS rows FROM lineitem")
def collection_count(spark, sf):
    return sinks.collection_count(spark, V.table(spark, sf, "lineitem"))


@query("flat_records", """SELECT p_partkey AS id, replace(p_name, ' ', ', ') AS words, '{"brand":"' || p_brand || '"}' AS facts, 'https://h/' || p_partkey AS _source_url, 'rules' AS _model, 0.5::DOUBLE AS _confidence FROM part""")
def flat_records(spark, sf):
    return sinks.flatten_record(_records(spark, sf)).select("id", "words", "facts", "_source_url", "_model", "_confidence")


@query("spread_records", "SELECT p_partkey AS id, p_brand AS brand, NULL AS color FROM part")
def spread_records(spark, sf):
    rows = V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("data"))
    return sinks.spread_data(rows, ["brand", "color"])


@query("run_reports", S.with_(S.RUNS).rstrip() + _PAIRS + """,
cc AS (SELECT run_id, count(*) AS n FROM diffs GROUP BY 1)
SELECT p.task_id, '# 任务报告 - ' || p.task_id AS heading, '- 域名: ' || p.domain AS domain_line, CASE WHEN p.prev_id IS NULL THEN '' ELSE '- 变化字段数: ' || coalesce(n, 0) END AS change_line
FROM prev p LEFT JOIN cc USING (run_id) WHERE p.status = 'success'""")
def run_reports(spark, sf):
    compared = changes.compare_with_previous(
        V.typed(spark, sf), keep=("storage_format", "created_at", "elapsed_ms", "quality_score")
    )
    summaries = changes.change_summary(compared).select("run_id", "domain", "impact_summary", "summary_lines", "suggested_actions")
    details = compared.select(
        "run_id", "task_id", "url", "status", "storage_format", "created_at", "completed_at", "elapsed_ms", "quality_score",
        "has_previous", "changed_count", F.col("fields").alias("data"),
    ).join(summaries, "run_id")
    report = F.col("report")
    line = lambda mark: F.regexp_extract(report, rf"(?m)^({mark}[^\n]*)$", 1)
    return sinks.markdown_reports(details).select(
        "task_id", line("# 任务报告").alias("heading"), line("- 域名").alias("domain_line"), line("- 变化字段数").alias("change_line")
    )


@query("decoded_bodies", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g') END AS text, CASE WHEN doc_id % 2 = 0 THEN 'utf-8' ELSE 'iso-8859-1' END AS charset, '' AS decode_note FROM documents""")
def decoded_bodies(spark, sf):
    """Documents as UTF-8 bodies and as Latin-1 bodies with a declared charset."""
    odd = F.col("doc_id") % 2 == 1
    latin = F.regexp_replace("text", r"[^\x{00}-\x{FF}]", "?")
    rows = V.wide_table(spark, sf, "documents").select(
        "doc_id", F.when(odd, F.encode(latin, "ISO-8859-1")).otherwise(F.encode("text", "UTF-8")).alias("content"),
        F.when(odd, "text/html; charset=ISO-8859-1").otherwise("text/html").alias("content_type"),
    )
    return readers.decode_bodies(rows, content_type="content_type").select("doc_id", "text", "charset", "decode_note")


@query("merged_usage", S.with_(S.RUNS) + """SELECT tenant_id, day AS usage_date, 2 * count(*) AS tasks_created, CAST(2 * sum(total_tokens) AS BIGINT) AS total_tokens FROM runs GROUP BY 1, 2""")
def merged_usage(spark, sf):
    """A07 incremental: the same partial sums added twice."""
    once = _usage(spark, sf)
    return upsert_usage(once, upsert_usage(once, None)).select(
        "tenant_id", day_text("usage_date").alias("usage_date"), "tasks_created", "total_tokens"
    )


@query("recent_runs_per_tenant", S.with_(S.RUNS) + "SELECT run_id, tenant_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY run_id DESC) AS rn FROM runs) WHERE rn <= 200")
def recent_runs_per_tenant(spark, sf):
    return kpi.keep_recent(V.runs(spark, sf), ["tenant_id"], [F.desc("run_id")], 200).select("run_id", "tenant_id")


def _word_counter(batch: pd.DataFrame) -> pd.DataFrame:
    words = batch["clean_text"].str.split().str.len().fillna(0).astype("int64").astype(str)
    return pd.DataFrame({"page_id": batch["page_id"], "field": "words", "value": words})


@query("custom_extractor", """SELECT doc_id AS page_id, 'words' AS field, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS VARCHAR) AS value FROM documents""")
def custom_extractor(spark, sf):
    """G01 + G03: a user's batch function as one of several steps."""
    steps = [
        lambda d: d.select("page_id", F.col("text").alias("clean_text")),
        lambda d: extension.apply_extractor(d, _word_counter),
    ]
    return extension.run_steps(V.documents(spark, sf), steps)


@query("sql_normalizers", """SELECT p_partkey, 'USD ' || CASE WHEN CAST(p_retailprice AS VARCHAR) LIKE '%.%' THEN regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.?0+$', '') ELSE CAST(p_retailprice AS VARCHAR) END || ' per month' AS price,
  'out_of_stock' AS stock, '2024-03-0' || (p_partkey % 9 + 1) AS day, p_partkey || 'k-' || p_partkey || 'k' AS salary FROM part""")
def sql_normalizers(spark, sf):
    """The normalisers called from SQL."""
    register_sql_functions(spark)
    V.table(spark, sf, "part").createOrReplaceTempView("normalizer_input")
    return spark.sql(
        "SELECT p_partkey, normalize_price(concat('From $', string(p_retailprice), ' monthly')) AS price, "
        "normalize_availability('Sold  out') AS stock, normalize_date(concat('posted March ', p_partkey % 9 + 1, ', 2024')) AS day, "
        "normalize_salary(concat(p_partkey, 'k ~ ', p_partkey, 'k')) AS salary FROM normalizer_input"
    )


@query("sql_html_nodes", "SELECT page_id, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def sql_html_nodes(spark, sf):
    """The page parser as a table function."""
    register_sql_functions(spark)
    V.pages(spark, sf).createOrReplaceTempView("html_input")
    return spark.sql(
        "SELECT p.page_id, int(count_if(n.tag = 'p')) AS paragraphs FROM html_input p, LATERAL html_nodes(p.html) n GROUP BY p.page_id"
    )


@query("sql_page_tags", "SELECT CAST(page_id AS VARCHAR) AS key, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<h1>')) AS headings FROM pages")
def sql_page_tags(spark, sf):
    """The page parser as a table function over whole batches."""
    register_sql_functions(spark)
    V.pages(spark, sf).createOrReplaceTempView("html_input")
    return spark.sql(
        "SELECT key, int(count_if(tag = 'p')) AS paragraphs, int(count_if(tag = 'h1')) AS headings "
        "FROM html_table(TABLE(SELECT page_id, html FROM html_input)) GROUP BY key"
    )


@query("sql_json_nodes", """SELECT CAST(p_partkey AS VARCHAR) AS key, 0 AS node_no, -1 AS parent, '' AS via, p_name AS name, NULL AS price FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), k, 0, CASE WHEN k = 1 THEN 'offers' ELSE 'brand' END, CASE WHEN k = 2 THEN p_brand END, CASE WHEN k = 1 THEN CAST(p_size AS VARCHAR) END FROM part, (VALUES (1), (2)) n(k) WHERE k = 1 OR p_partkey % 3 <> 0""")
def sql_json_nodes(spark, sf):
    """The flattener of JSON documents as a table function over whole batches."""
    register_sql_functions(spark)
    brand = F.when(F.col("p_partkey") % 3 != 0, F.struct(F.col("p_brand").alias("name")))
    offer = F.array(F.struct(F.col("p_size").alias("price")))
    document = F.to_json(F.struct(F.col("p_name").alias("name"), offer.alias("offers"), brand.alias("brand")))
    V.wide_table(spark, sf, "part").select("p_partkey", document.alias("document")).createOrReplaceTempView("json_input")
    return spark.sql(
        "SELECT key, node_no, parent, via, fields['name'] AS name, fields['price'] AS price "
        "FROM json_table(TABLE(SELECT p_partkey, document FROM json_input))"
    ).withColumn("name", F.when((F.col("via") != "offers"), F.col("name")))


@query("csv_headers", """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS brand, '' AS color FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, p_brand, '' FROM part WHERE p_partkey % 2 = 1
UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, '', p_type FROM part""")
def csv_headers(spark, sf):
    """S05 as appends to one folder: two with the same header, one with another."""
    folder = shared_folder(spark, "csv-headers")
    part = V.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("color"))
    for odd in (0, 1):
        sinks.append_csv(part.where(F.col("id") % 2 == odd).drop("color"), folder)
    sinks.append_csv(part.drop("brand"), folder)
    return sinks.read_csv_folder(spark, folder).select("id", "name", "brand", "color")


@query("stored_collection", """SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, NULL AS priority FROM orders WHERE o_totalprice >= 100000
UNION ALL SELECT o_orderkey, NULL, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice >= 100000""")
def stored_collection(spark, sf):
    """A collection written twice through the data source, the second time with other columns."""
    name, folder = collection.register(spark), shared_folder(spark, "collection")
    rows = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority")
    )
    for left_out in ("priority", "status"):
        rows.drop(left_out).write.format(name).mode("append").option("path", folder).save()
    return spark.read.format(name).option("path", folder).load().where("price >= 100000").select("id", "status", "price", "priority")


@query("feed_file_items", """SELECT 'Item & ' || p_partkey AS title, '2024-01-01' AS published, 'About ' || p_name || ' here' AS summary, 'https://shop.example.com/a/' || p_partkey || '?x=1&y=2' AS link FROM part""")
def feed_file_items(spark, sf):
    """S11 on feed files written from the part table: RSS items and Atom entries, entities, CDATA, markup."""
    folder = shared_folder(spark, "feeds")
    key = F.col("p_partkey")
    address = F.concat(F.lit("https://shop.example.com/a/"), key, F.lit("?x=1&amp;y=2"))
    title = F.concat(F.lit("<title>Item &amp; "), key, F.lit("</title>"))
    about = F.concat(F.lit("<![CDATA[About <b>"), "p_name", F.lit("</b>  here]]>"))
    rss = F.concat(F.lit("<rss><channel><item>"), title, F.lit("<pubDate>2024-01-01</pubDate><description>"), about, F.lit("</description><link> "), address, F.lit(" </link></item></channel></rss>"))
    atom = F.concat(F.lit("<feed><entry>"), title, F.lit('<link rel="self" href="'), address, F.lit('"/><updated>2024-01-01</updated><summary>'), about, F.lit("</summary></entry></feed>"))
    part = V.table(spark, sf, "part")
    part.where(key % 2 == 0).select(rss).write.text(f"{folder}/rss")
    part.where(key % 2 == 1).select(atom).write.text(f"{folder}/atom")
    items = readers.read_feed_items(spark, f"{folder}/rss").union(readers.read_feed_items(spark, f"{folder}/atom", tag="entry"))
    return items.select("title", "published", "summary", "link")


@query("sitemap_file_repairs", """SELECT p_partkey, 'https://shop.example.com/new/' || p_partkey AS repaired_url FROM part""")
def sitemap_file_repairs(spark, sf):
    """S12 + J10 on sitemap files written from the part table."""
    folder = shared_folder(spark, "sitemaps")
    key = F.col("p_partkey")
    entry = lambda place: F.concat(F.lit(f"<url><loc> https://shop.example.com/{place}/"), key, F.lit(" </loc></url>"))
    V.table(spark, sf, "part").select(F.concat(F.lit("<urlset>"), entry("new"), entry("other"), F.lit("</urlset>"))).write.text(folder)
    dead = V.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("https://shop.example.com/old/"), key).alias("url"))
    locs = readers.read_sitemap_urls(spark, folder).withColumn("base", F.lit("https://shop.example.com/sitemap.xml"))
    return L.repair_from_sitemap(dead, locs).select("p_partkey", "repaired_url")


@query("region_lines", "SELECT page_id, count(*) AS items FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li>')) AS x FROM pages) GROUP BY 1")
def region_lines(spark, sf):
    """H09 with a navigation region: the selected region is kept though its tag is a dropped one elsewhere."""
    parsed = P.parse_pages(V.pages(spark, sf), drop_tags=("script", "style"))
    rows = P.page_lines(P.with_clean_text(parsed, selector="nav"))
    return rows.groupBy("page_id").agg(F.count("*").alias("items"))
