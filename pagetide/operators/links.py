"""Whole-table URL operators: dedupe (W03), sitemap and feed matching (S11, S12, J10), site policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.urls import host, is_safe_repair, netloc, path_slug, url_hash
from pagetide.operators.ordered import first_per_key


def first_seen_urls(df: DataFrame, *order: str | Column) -> DataFrame:
    """One row per distinct trimmed URL, the first seen; add `url_hash`.  Combined map-side."""
    return first_per_key(df.withColumn("url_hash", url_hash(F.col("url"))), ["url_hash"], *order)


def flag_seen_urls(df: DataFrame, order: str) -> DataFrame:
    """Every row with `url_hash` and whether an earlier row has the same URL.

    The firsts come from a map-side-combined minimum; the join back has one row per hash on
    the small side, so adaptive execution can split a hot hash.
    """
    hashed = df.withColumn("url_hash", url_hash(F.col("url")))
    firsts = hashed.groupBy("url_hash").agg(F.min(order).alias("_first"))
    return hashed.join(firsts, "url_hash").withColumn("seen", F.col(order) > F.col("_first")).drop("_first")


def sitemap_urls(sitemaps: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per <loc>, with its position; `limit` keeps the first so many per sitemap."""
    found = F.regexp_extract_all("text", F.lit(r"(?i)<loc>\s*([^<]+)\s*</loc>"), F.lit(1))
    found = F.transform(found, lambda u: F.trim(u))
    if limit is not None:
        found = F.slice(found, 1, limit)
    keep = [c for c in sitemaps.columns if c != "text"]
    return sitemaps.select(*keep, F.posexplode(found).alias("position", "loc"))


def repair_from_sitemap(dead: DataFrame, locs: DataFrame) -> DataFrame:
    """Dead URLs matched to sitemap entries of the same host on the last path segment.

    The sitemap side is reduced to one entry per (host, slug) before the join, so the join
    emits at most one row per dead URL whatever the skew.
    """
    keyed = locs.select(
        F.lower(netloc(F.col("base"))).alias("site"), F.lower(path_slug(F.col("loc"))).alias("slug"), "position", "loc"
    ).where(F.col("slug") != "")
    firsts = first_per_key(keyed, ["site", "slug"], "position", "loc").drop("position")
    return (
        dead.withColumn("site", F.lower(netloc(F.col("url"))))
        .withColumn("slug", F.lower(path_slug(F.col("url"))))
        .join(firsts, ["site", "slug"], "left")
        .withColumn("safe", F.coalesce(is_safe_repair(F.col("url"), F.col("loc")), F.lit(False)))
        .withColumnRenamed("loc", "repaired_url")
        .drop("site", "slug")
    )


def feed_items(feeds: DataFrame) -> DataFrame:
    """Items of RSS or Atom text as rows (feed columns, position, title, published, summary, link)."""

    def tag(item: Column, *names: str) -> Column:
        found = [F.regexp_extract(item, rf"(?is)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1) for n in names]
        return F.coalesce(*[F.when(f != "", f) for f in found], F.lit(""))

    def plain(text: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"<[^>]+>", " ")
        named = F.replace(F.replace(F.replace(F.replace(bare, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
        return F.trim(F.regexp_replace(named, r"(?U)\s+", " "))

    items = F.regexp_extract_all("text", F.lit(r"(?is)<(?:item|entry)(?:\s[^>]*)?>(.*?)</(?:item|entry)>"), F.lit(1))
    keep = [c for c in feeds.columns if c != "text"]
    rows = feeds.select(*keep, F.posexplode(items).alias("position", "item"))
    href = F.regexp_extract("item", r"""(?is)<link\s[^>]*href=["']([^"']+)["']""", 1)
    return rows.select(
        *keep, "position",
        plain(tag(F.col("item"), "title")).alias("title"),
        plain(tag(F.col("item"), "pubDate", "published", "updated")).alias("published"),
        plain(tag(F.col("item"), "description", "summary", "content")).alias("summary"),
        F.when(href != "", href).otherwise(plain(tag(F.col("item"), "link"))).alias("link"),
    )


def pages_from_feed(dead: DataFrame, items: DataFrame) -> DataFrame:
    """S11 + J10: page rows for URLs whose slug ends a feed link of the same host."""
    keyed = items.where(F.col("link") != "").select(
        host(F.col("link")).alias("site"), F.lower(path_slug(F.col("link"))).alias("slug"),
        "position", "title", "published", "summary", "link",
    )
    firsts = first_per_key(keyed, ["site", "slug"], "position", "link")
    parts = F.array(
        F.when(F.col("title") != "", F.concat(F.lit("<h1>"), "title", F.lit("</h1>"))),
        F.when(F.col("published") != "", F.concat(F.lit("<time>"), "published", F.lit("</time>"))),
        F.when(F.col("summary") != "", F.concat(F.lit("<article>"), "summary", F.lit("</article>"))),
        F.concat(F.lit('<link rel="canonical" href="'), "link", F.lit('">')),
    )
    return (
        dead.withColumn("site", host(F.col("url")))
        .withColumn("slug", F.lower(path_slug(F.col("url"))))
        .join(firsts, ["site", "slug"])
        .select(
            *dead.columns,
            F.concat(F.lit("<html><body>"), F.array_join(F.array_compact(parts), "\n"), F.lit("</body></html>")).alias("html"),
        )
    )


def with_site_policy(df: DataFrame, policies: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Policy columns of the URL's lower-cased authority; NULL without a policy.

    No broadcast hint: Catalyst broadcasts the policy table when its measured size allows.
    """
    wanted = policies.select(F.lower("domain").alias("_domain"), *columns)
    keyed = df.withColumn("_domain", F.lower(netloc(F.col("url"))))
    return keyed.join(wanted, "_domain", "left").drop("_domain")
