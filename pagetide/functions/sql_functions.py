"""Functions for SQL users (G06, G07): normalisers as SQL functions, parsers as table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagetide.functions import text as T
from pagetide.functions.page_tree import DROP_TAGS, _documents, _flatten, _Tree, pieces

def _r(pattern: str) -> str:
    return f"r'{pattern}'"


def _month_case() -> str:
    names = " ".join(f"WHEN m LIKE '{name[:3]}%' THEN {n}" for n, name in enumerate(T.MONTH_NAMES, start=1))
    return f"CASE {names} END"


def _dated(pattern: str, day: int, month: int, year: int) -> str:
    part = lambda g: f"regexp_extract(x, {_r(pattern)}, {g})"
    number = f"get(transform(array(lower({part(month)})), m -> {_month_case()}), 0)"
    full = f"get(transform(array(int({part(year)})), y -> CASE WHEN y < 70 THEN y + 2000 WHEN y < 100 THEN y + 1900 ELSE y END), 0)"
    return (
        f"CASE WHEN x RLIKE {_r(pattern)} AND {number} IS NOT NULL THEN "
        f"coalesce(string(try_to_date(concat({full}, '-', lpad({number}, 2, '0'), '-', lpad({part(day)}, 2, '0')), 'yyyy-MM-dd')), x) END"
    )


def _iso() -> str:
    part = lambda g: f"regexp_extract(x, {_r(T.ISO_DATE)}, {g})"
    return (
        f"CASE WHEN x RLIKE {_r(T.ISO_DATE)} THEN coalesce(string(try_to_date(concat({part(1)}, '-', lpad({part(2)}, 2, '0'), "
        f"'-', lpad({part(3)}, 2, '0')), 'yyyy-MM-dd')), x) END"
    )


# Name to SQL body over one STRING argument `x`, in dependency order.  The bodies use the
# fixed values of `text.py`, and Spark inlines them, so they run inside code generation.
SQL_BODIES = {
    "clean_text": r"trim(regexp_replace(coalesce(x, ''), r'(?U)\s+', ' '))",
    "detect_currency": "CASE " + " ".join(
        f"WHEN contains(lower(x), '{m.lower()}') THEN '{c}'" for m, c in T.CURRENCY_MARKERS
    ) + " ELSE '' END",
    "normalize_availability": (
        f"CASE WHEN lower(clean_text(x)) RLIKE {_r(T.NO_STOCK)} THEN 'out_of_stock' "
        f"WHEN lower(clean_text(x)) RLIKE {_r(T.IN_STOCK)} THEN 'in_stock' "
        f"WHEN lower(clean_text(x)) RLIKE {_r(T.PREORDER)} THEN 'preorder' ELSE clean_text(x) END"
    ),
    "normalize_salary": r"regexp_replace(regexp_replace(clean_text(x), r'\s*/\s*', '/'), r'\s*[-~至到]\s*', '-')",
    "billing_unit": r"CASE WHEN lower(x) RLIKE r'\b(seat|user|member)\b' THEN CASE WHEN contains(lower(x), 'seat') THEN 'per seat/' ELSE 'per user/' END ELSE 'per ' END",
    "normalize_billing_period": (
        r"CASE WHEN lower(x) RLIKE r'per\s+seat(\s*/\s*|\s+per\s+)month' THEN 'per seat/month' "
        r"WHEN lower(x) RLIKE r'per\s+user(\s*/\s*|\s+per\s+)month' THEN 'per user/month' "
        f"WHEN lower(x) RLIKE {_r(T.MONTHLY)} THEN concat(billing_unit(x), 'month') "
        f"WHEN lower(x) RLIKE {_r(T.YEARLY)} THEN concat(billing_unit(x), 'year') ELSE '' END"
    ),
    "price_digits": f"regexp_replace(regexp_extract(x, {_r(T.PRICE_AMOUNT)}, 1), '[, ]', '')",
    "price_number": r"CASE WHEN contains(price_digits(x), '.') THEN regexp_replace(price_digits(x), r'\.?0+$', '') ELSE price_digits(x) END",
    "strip_price_lead": f"regexp_replace(clean_text(x), {_r(T.PRICE_LEAD)}, '')",
    "normalize_price": (
        "CASE WHEN price_digits(strip_price_lead(x)) = '' THEN strip_price_lead(x) ELSE array_join(filter(array("
        "detect_currency(strip_price_lead(x)), price_number(strip_price_lead(x)), normalize_billing_period(strip_price_lead(x))), p -> p <> ''), ' ') END"
    ),
    "normalize_date": f"coalesce({_iso()}, {_dated(T.DAY_MONTH_YEAR, 1, 2, 3)}, {_dated(T.MONTH_DAY_YEAR, 2, 1, 3)}, x)",
}


@F.udtf(returnType="node_no INT, tag STRING, attrs MAP<STRING,STRING>, dropped BOOLEAN")
class HtmlNodes:
    """SELECT * FROM html_nodes(html): the elements of a page."""

    def eval(self, html: str) -> Iterator[tuple]:
        tree = _Tree(frozenset(DROP_TAGS))
        tree.feed(html or "")
        for e in tree.finish()[0]:
            yield e["no"], e["tag"], e["attrs"], e["dropped_by"] >= 0


@F.udtf(returnType="node_no INT, parent INT, via STRING, fields MAP<STRING,STRING>")
class JsonNodes:
    """SELECT * FROM json_nodes(text): the objects of a JSON document."""

    def eval(self, document: str) -> Iterator[tuple]:
        for value in _documents("whole", (document or "").strip()):
            for node in _flatten(value):
                yield node["no"], node["parent"], node["via"], node["fields"]


_HTML_ROW = pa.schema([("key", pa.string()), ("node_no", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("dropped", pa.bool_())])
_JSON_ROW = pa.schema([("key", pa.string()), ("node_no", pa.int32()), ("parent", pa.int32()), ("via", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])


def _texts(batch: pa.RecordBatch) -> Iterator[list[tuple[str | None, str]]]:
    """Key and text of each row, piece by piece: the first two columns; null texts are empty."""
    keys, texts = batch.column(0).cast(pa.string()), batch.column(1).cast(pa.string())
    for start, rows in pieces(pc.utf8_length(texts)):
        yield [(k, t or "") for k, t in zip(keys.slice(start, rows).to_pylist(), texts.slice(start, rows).to_pylist(), strict=True)]


@F.arrow_udtf(returnType="key STRING, node_no INT, tag STRING, attrs MAP<STRING,STRING>, dropped BOOLEAN")
class HtmlTable:
    """SELECT * FROM html_table(TABLE(SELECT key, html FROM ...)): the elements of all pages, batch by batch."""

    def eval(self, pages: pa.RecordBatch) -> Iterator[pa.Table]:
        for piece in _texts(pages):
            rows = []
            for key, html in piece:
                tree = _Tree(frozenset(DROP_TAGS))
                tree.feed(html)
                rows += [(key, e["no"], e["tag"], e["attrs"], e["dropped_by"] >= 0) for e in tree.finish()[0]]
            if rows:
                yield _table(rows, _HTML_ROW)


@F.arrow_udtf(returnType="key STRING, node_no INT, parent INT, via STRING, fields MAP<STRING,STRING>")
class JsonTable:
    """SELECT * FROM json_table(TABLE(SELECT key, json FROM ...)): the objects of all documents, batch by batch."""

    def eval(self, documents: pa.RecordBatch) -> Iterator[pa.Table]:
        for piece in _texts(documents):
            nodes = ((key, n) for key, text in piece for value in _documents("whole", text.strip()) for n in _flatten(value))
            rows = [(key, n["no"], n["parent"], n["via"], n["fields"]) for key, n in nodes]
            if rows:
                yield _table(rows, _JSON_ROW)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = [[list(v.items()) if isinstance(v, dict) else v for v in values] for values in zip(*rows, strict=True)]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Register all functions on the session and return their names."""
    for name, body in SQL_BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")
    spark.udtf.register("html_nodes", HtmlNodes)
    spark.udtf.register("json_nodes", JsonNodes)
    spark.udtf.register("html_table", HtmlTable)
    spark.udtf.register("json_table", JsonTable)
    return [*SQL_BODIES, "html_nodes", "json_nodes", "html_table", "json_table"]
