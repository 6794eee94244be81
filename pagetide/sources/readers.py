"""Sources (S01, S02, S11-S13)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- Fixed values
TRUE_TEXTS = ("1", "true", "yes", "y")
FALLBACK_CHARSETS = ("utf-8", "utf-8-sig", "gb18030", "big5", "latin-1")
MAX_REPLACEMENT_RATIO = 0.01
# ---- end of fixed values


def url_lines(lines: DataFrame) -> DataFrame:
    """URLs of a text table (column `value`): trimmed, no blanks, no comment lines."""
    url = F.trim("value")
    return lines.select(url.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """S01."""
    return url_lines(spark.read.text(path))


def _text_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def _flag(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*TRUE_TEXTS), F.lit(False))


def samples_from_rows(rows: DataFrame, split: str = "") -> DataFrame:
    """Labelled samples from text columns, whatever subset of them is present."""
    have = set(rows.columns)

    def text(*names: str, default: str = "") -> Column:
        options = [F.when(F.trim(F.col(n).cast("string")) != "", F.col(n).cast("string")) for n in names if n in have]
        return F.coalesce(*options, F.lit(default))

    return rows.select(
        F.trim(text("url")).alias("url"),
        text("page_type", "schema_name", default="auto").alias("page_type"),
        _text_list(text("selected_fields")).alias("selected_fields"),
        F.coalesce(
            F.from_json(text("expected_fields"), "MAP<STRING,STRING>"), F.create_map().cast("map<string,string>")
        ).alias("expected_fields"),
        F.coalesce(text("min_fields", "minimum_fields").try_cast("int"), F.lit(1)).alias("min_fields"),
        (F.lit(split) if split else text("split", default="fixed")).alias("split"),
        _flag(text("anti_bot_risk")).alias("anti_bot_risk"),
        _flag(text("dynamic")).alias("dynamic"),
    )


def read_samples(spark: SparkSession, path: str, split: str = "") -> DataFrame:
    """CSV with a header, or JSON holding a list or an object with `samples`."""
    if path.lower().rstrip("/").endswith(".csv"):
        return samples_from_rows(spark.read.csv(path, header=True, multiLine=True, escape='"'), split)
    # One JSON document per file: the list is exploded as text, so nested values may be of any shape.
    documents = spark.read.text(path, wholetext=True)
    listed = F.coalesce(
        F.from_json(F.get_json_object("value", "$.samples"), "ARRAY<MAP<STRING,STRING>>"),
        F.from_json("value", "ARRAY<MAP<STRING,STRING>>"),
    )
    item = F.col("s")
    names = (
        "url", "page_type", "schema_name", "expected_fields", "min_fields", "minimum_fields", "split",
        "anti_bot_risk", "dynamic",
    )
    raw_fields = item["selected_fields"]
    as_list = F.coalesce(F.array_join(F.from_json(raw_fields, "ARRAY<STRING>"), ","), raw_fields)
    rows = documents.select(F.explode(listed).alias("s")).select(
        *[item[n].alias(n) for n in names], as_list.alias("selected_fields")
    )
    return samples_from_rows(rows, split)


def _decode(body: bytes, declared: str, content_type: str) -> tuple[str, str, str]:
    """Text, recovery note and charset of one response body."""
    _, _, charset = content_type.lower().partition("charset=")
    charset = charset.split(";")[0].strip(" \"'")
    first_error = ""
    tried = list(dict.fromkeys(c for c in (declared.strip().lower(), charset, *FALLBACK_CHARSETS) if c))
    for name in tried:
        try:
            text = body.decode(name)
        except LookupError:
            continue
        except UnicodeError as exc:
            first_error = first_error or f"decode_error: {type(exc).__name__}"
            continue
        if text.count("�") <= MAX_REPLACEMENT_RATIO * max(len(text), 1):
            return text, f"decode_recovered:{name}" if first_error else "", name
    return body.decode("utf-8", errors="replace"), first_error or "decode_error: fallback_replace", "utf-8-replace"


def decode_bodies(
    df: DataFrame, body: str = "content", declared: str | None = None, content_type: str | None = None
) -> DataFrame:
    """Add `text`, `decode_note` and `charset` to a table of response bodies.

    Valid UTF-8 without a declared charset, the bulk of any crawl, is decoded on the JVM; the
    Arrow-batched helper sees only the rest.
    """
    none = F.lit("").cast("string")
    hinted = F.coalesce(F.col(declared) if declared else none, none)
    header = F.coalesce(F.col(content_type) if content_type else none, none)
    plain = F.try_validate_utf8(F.col(body))
    simple = (hinted.isin("", "utf-8")) & (F.lower(header).rlike("charset=[\"']?utf-8") | ~F.lower(header).contains("charset=")) & plain.isNotNull()

    @F.pandas_udf("text STRING, decode_note STRING, charset STRING")
    def slow(bodies: pd.Series, charsets: pd.Series, headers: pd.Series) -> pd.DataFrame:
        rows = [
            _decode(bytes(b), c or "", h or "") if b is not None else ("", "", "")
            for b, c, h in zip(bodies, charsets, headers, strict=True)
        ]
        return pd.DataFrame(rows, columns=["text", "decode_note", "charset"])

    return (
        df.withColumn("_slow", slow(F.when(~simple, F.col(body)), hinted, header))
        .withColumn("text", F.when(simple, plain).otherwise(F.col("_slow.text")))
        .withColumn("decode_note", F.when(simple, "").otherwise(F.col("_slow.decode_note")))
        .withColumn("charset", F.when(simple, "utf-8").otherwise(F.col("_slow.charset")))
        .drop("_slow")
    )


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Response bodies stored as files."""
    return decode_bodies(spark.read.format("binaryFile").load(path).select("path", "content"))


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of XML files as rows (path, position, element), position an order within all files.

    The end tag is the separator of the text reader, so a large file is split among tasks. Entities and CDATA are the
    parser's; an element that it refuses is parsed again with its unknown entities as plain text.
    """
    rows = spark.read.option("lineSep", f"</{tag}>").text(path)
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    start = F.regexp_extract("value", rf"(?s)^.*?(<{tag}(?:\s[^>]*)?>.*)$", 1)
    found = rows.select(F.col("_metadata.file_path").alias("path"), order.alias("position"), F.concat(start, F.lit(f"</{tag}>")).alias("xml"))
    parse = lambda xml: F.from_xml(xml, f"{schema}, _corrupt_record STRING", {"ignoreNamespace": "true"})
    named = F.regexp_replace("xml", r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)", "&amp;")
    element = F.when(F.col("first._corrupt_record").isNull(), F.col("first")).otherwise(parse(named))
    whole = found.where(F.col("xml") != f"</{tag}>").withColumn("first", parse(F.col("xml")))
    return whole.select("path", "position", element.alias("element"))


def read_feed_items(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """Items of feed files as rows (path, position, title, published, summary, link).

    `tag` is "item" for RSS and "entry" for Atom; a file without it is read as a single row without items. Texts are
    plain: markup goes, runs of blanks are one. An item's link is its first address, else its first text.
    """
    texts = ("title", "pubDate", "published", "updated", "description", "summary", "content")
    schema = ", ".join([f"{t} STRING" for t in texts] + ["link ARRAY<STRUCT<_VALUE: STRING, _href: STRING>>"])

    def plain(*names: str) -> Column:
        bare = [F.regexp_replace(F.col(f"element.{n}"), r"<[^>]+>", " ") for n in names]
        found = [F.trim(F.regexp_replace(b, r"(?U)\s+", " ")) for b in bare]
        return F.coalesce(*[F.when(f != "", f) for f in found], F.lit(""))

    def first(part: str) -> Column:
        return F.get(F.filter(F.transform("element.link", lambda x: F.trim(x[part])), lambda x: x != ""), 0)

    return _elements(spark, path, tag, schema).select(
        "path", "position", plain("title").alias("title"), plain("pubDate", "published", "updated").alias("published"),
        plain("description", "summary", "content").alias("summary"), F.coalesce(first("_href"), first("_VALUE"), F.lit("")).alias("link"),
    )


def read_sitemap_urls(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of sitemap files as rows (path, position, loc); blank ones are left out."""
    loc = F.trim("element.loc")
    return _elements(spark, path, "url", "loc STRING").select("path", "position", loc.alias("loc")).where(F.col("loc") != "")


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """S11/S12 input: feed or sitemap files as (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
