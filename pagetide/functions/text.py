"""Text normalisers for extracted values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.functions.blank import is_blank, let

# ---- Fixed values
CURRENCY_MARKERS = (
    ("$", "USD"), ("US$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "CNY"), ("￥", "CNY"),
    ("RMB", "CNY"), ("CNY", "CNY"), ("USD", "USD"), ("EUR", "EUR"), ("GBP", "GBP"),
)
MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
)
PRICE_FIELDS = ("price", "amount", "monthly_price", "annual_price", "sale_price", "regular_price")
DATE_FIELDS = ("publish_date", "date", "posted_at", "published_at", "updated_at", "valid_through", "deadline")
PERIOD_FIELDS = ("billing_period", "period", "billing", "billing_cycle")
AVAILABILITY_FIELDS = ("availability", "stock")
SALARY_FIELDS = ("salary", "salary_range", "compensation")
PRICE_LEAD = r"(?i)^(?:from|starting at|starts at|as low as)\s+"
PRICE_AMOUNT = r"(\d{1,9}(?:[,\s]\d{3})*(?:[.]\d{1,4})?|\d+(?:[.]\d{1,4})?)"
ISO_DATE = r"\b((?:19|20)\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})"
DAY_MONTH_YEAR = r"\b(\d{1,2})\s+([A-Za-z]{3,9})\.?,?\s+(\d{2,4})\b"
MONTH_DAY_YEAR = r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{2,4})\b"
MONTHLY = r"/mo\b|/month\b|per\s+month|monthly|每月|月付"
YEARLY = r"/yr\b|/year\b|per\s+year|annually|annual|每年|年付"
OUT_OF_STOCK = r"out\s+of\s+stock|sold\s+out|缺货|无货|售罄|\bunavailable\b"
IN_STOCK = r"in\s*stock|instock|\bavailable\b|有货|现货|可购买"
PREORDER = r"pre[-\s]?order|预订|预约"
# ---- end of fixed values

# Missing stock also in other words.
NO_STOCK = OUT_OF_STOCK + r"|\b(?:not|no\s+longer)(?:\s+currently)?\s+available\b"


def _month_numbers() -> dict[str, int]:
    table = {}
    for number, name in enumerate(MONTH_NAMES, start=1):
        table[name] = table[name[:3]] = number
    table["sept"] = 9
    return table


def clean_text(text: Column) -> Column:
    """runs of Unicode whitespace become one space; trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def detect_currency(text: Column) -> Column:
    """ISO code of the first listed marker that occurs anywhere, '' when none does."""
    lowered = F.lower(text)
    chain = reduce(
        lambda acc, pair: acc.when(lowered.contains(pair[0].lower()), F.lit(pair[1])),
        CURRENCY_MARKERS[1:],
        F.when(lowered.contains(CURRENCY_MARKERS[0][0]), F.lit(CURRENCY_MARKERS[0][1])),
    )
    return chain.otherwise("")


def _period(text: Column) -> Column:
    """F05 on a cleaned text."""

    def rules(t: Column) -> Column:
        unit = F.when(t.rlike(r"\b(seat|user|member)\b"), F.when(t.contains("seat"), "seat").otherwise("user"))
        per = F.coalesce(F.concat(F.lit("per "), unit, F.lit("/")), F.lit("per "))
        return (
            F.when(t.rlike(r"per\s+seat(\s*/\s*|\s+per\s+)month"), "per seat/month")
            .when(t.rlike(r"per\s+user(\s*/\s*|\s+per\s+)month"), "per user/month")
            .when(t.rlike(MONTHLY), F.concat(per, F.lit("month")))
            .when(t.rlike(YEARLY), F.concat(per, F.lit("year")))
            .otherwise("")
        )

    return let(F.lower(text), rules)


def normalize_billing_period(text: Column) -> Column:
    """'per month', 'per seat/year', ... or ''."""
    return _period(clean_text(text))


def _price_parts(text: Column) -> Column:
    def parts(t: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(t, PRICE_AMOUNT, 1), "[, ]", "")
        tidy = F.regexp_replace(digits, r"(\.\d*?)0+$|\.$", "$1")
        return F.struct(
            detect_currency(t).alias("currency"),
            F.when(t.rlike(PRICE_AMOUNT), F.regexp_replace(tidy, r"\.$", "")).alias("amount"),
            _period(t).alias("period"),
            t.alias("stripped"),
        )

    return let(F.regexp_replace(text, PRICE_LEAD, ""), parts)


def price_parts(text: Column) -> Column:
    """STRUCT<currency, amount, period, stripped>; amount is NULL when the text has no number."""
    return _price_parts(clean_text(text))


def _price(text: Column) -> Column:
    def joined(p: Column) -> Column:
        filled = F.filter(F.array(p["currency"], p["amount"], p["period"]), lambda x: x != "")
        return F.when(p["amount"].isNull(), p["stripped"]).otherwise(F.array_join(filled, " "))

    return let(_price_parts(text), joined)


def normalize_price(text: Column) -> Column:
    """'USD 29.99 per month'; a text without a number is returned stripped."""
    return _price(clean_text(text))


def price_amount(text: Column) -> Column:
    """Typed companion of F02: DECIMAL(18,4) amount."""
    return price_parts(text)["amount"].try_cast("decimal(18,4)")


def _valid_date(year: Column, month: Column, day: Column) -> Column:
    parts = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.date_format(F.try_to_date(parts, "yyyy-MM-dd"), "yyyy-MM-dd")


def _full_year(year: Column) -> Column:
    number = year.try_cast("int")
    widened = F.when(number < 70, number + 2000).when(number < 100, number + 1900).otherwise(number)
    return widened.cast("string")


def _date(text: Column) -> Column:
    """F04 on a cleaned text."""
    months = F.create_map(*[F.lit(x) for pair in _month_numbers().items() for x in pair])

    def month_of(name: Column) -> Column:
        return F.element_at(months, F.lower(name)).cast("string")

    def rules(t: Column) -> Column:
        def part(pattern: str, group: int) -> Column:
            return F.regexp_extract(t, pattern, group)

        dmy, mdy = month_of(part(DAY_MONTH_YEAR, 2)), month_of(part(MONTH_DAY_YEAR, 1))
        return (
            F.when(t.rlike(ISO_DATE), _valid_date(*[part(ISO_DATE, g) for g in (1, 2, 3)]))
            .when(dmy.isNotNull(), _valid_date(_full_year(part(DAY_MONTH_YEAR, 3)), dmy, part(DAY_MONTH_YEAR, 1)))
            .when(mdy.isNotNull(), _valid_date(_full_year(part(MONTH_DAY_YEAR, 3)), mdy, part(MONTH_DAY_YEAR, 2)))
        )

    return let(text, lambda t: F.coalesce(rules(t), t))


def normalize_date(text: Column) -> Column:
    """ISO date of the first recognised form; an unrecognised or impossible date stays text."""
    return _date(clean_text(text))


def _availability(text: Column) -> Column:
    """F06 on a cleaned text."""
    return let(
        F.lower(text),
        lambda low: F.when(low.rlike(NO_STOCK), "out_of_stock")
        .when(low.rlike(IN_STOCK), "in_stock")
        .when(low.rlike(PREORDER), "preorder")
        .otherwise(text),
    )


def normalize_availability(text: Column) -> Column:
    """out_of_stock, in_stock or preorder; other texts unchanged."""
    return _availability(clean_text(text))


def _salary(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s*/\s*", "/"), r"\s*[-~至到]\s*", "-")


def normalize_salary(text: Column) -> Column:
    """no spaces around '/', one '-' as range separator."""
    return _salary(clean_text(text))


def normalize_field_value(field: Column, value: Column) -> Column:
    """normalise by field name; JSON lists element-wise, JSON objects and blanks untouched."""
    name = F.lower(F.trim(field))

    def scalar(t: Column) -> Column:
        return (
            F.when(name.isin(*PRICE_FIELDS) | name.endswith("_price"), _price(t))
            .when(name.isin(*DATE_FIELDS) | name.endswith("_date"), _date(t))
            .when(name.isin(*PERIOD_FIELDS), _period(t))
            .when(name.isin(*AVAILABILITY_FIELDS), _availability(t))
            .when(name.isin(*SALARY_FIELDS), _salary(t))
            .otherwise(t)
        )

    # A scalar is a list of one, so that the rules appear once in the plan.
    items = F.from_json(F.when(value.startswith("["), value), "ARRAY<STRING>")
    done = F.transform(F.coalesce(items, F.array(value)), lambda v: scalar(clean_text(v)))
    return F.when(is_blank(value) | value.startswith("{"), value).otherwise(
        let(done, lambda d: F.when(items.isNotNull(), F.to_json(d)).otherwise(F.get(d, 0)))
    )


def token_estimate(text: Column) -> Column:
    """length/4 with at least one token, 0 for a blank text."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit(0)).otherwise(
        F.greatest(F.floor(F.length(text) / 4), F.lit(1))
    ).cast("long")


def split_keywords(text: Column) -> Column:
    """split on spaces, commas, semicolons, slashes and bars, ASCII or CJK."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?U)[\s,，;；、/|]+")
    return F.filter(parts, lambda p: p != "")


def formatted_lines(labels: Column, names: Column, entries: Column) -> Column:
    """one “label”：“value” line per filled field."""
    lines = F.transform(
        F.filter(names, lambda n: ~is_blank(F.element_at(entries, n))),
        lambda n: F.concat(
            F.lit("“"), F.coalesce(F.element_at(labels, n), n), F.lit("”：“"),
            F.element_at(entries, n), F.lit("”"),
        ),
    )
    return F.array_join(lines, "\n")


def lenient_object(text: Column) -> Column:
    """MAP<STRING,STRING> of the whole text, else of the first '{' to the last '}'."""
    # A map field keeps nested values as JSON text; malformed JSON gives NULL.
    trimmed = F.trim(text)
    inner = F.regexp_extract(trimmed, r"(?s)(\{.*\})", 1)
    chosen = F.when(F.try_parse_json(trimmed).isNotNull() & trimmed.startswith("{"), trimmed).when(
        F.try_parse_json(inner).isNotNull(), inner
    )
    return F.from_json(chosen, "MAP<STRING,STRING>")
