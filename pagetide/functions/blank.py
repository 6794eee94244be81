"""The one definition of a missing value (P01) and the small helpers built on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON texts that count as missing, next to NULL.
BLANK_TEXTS = ("", "[]", "{}", "null")


def is_blank(text: Column) -> Column:
    """True for NULL, '' and the JSON texts of an empty list or object."""
    return text.isNull() | text.isin(*BLANK_TEXTS)


def is_blank_array(items: Column) -> Column:
    return items.isNull() | (F.size(items) == 0)


def is_blank_map(entries: Column) -> Column:
    return entries.isNull() | (F.size(entries) == 0)


def drop_blank_entries(entries: Column) -> Column:
    """Keep only the map entries that carry a value."""
    return F.map_filter(entries, lambda k, v: ~is_blank(v))


def count_filled(entries: Column, names: Column) -> Column:
    """How many of `names` have a non-blank value in the map."""
    return F.size(F.filter(names, lambda n: ~is_blank(F.element_at(entries, n))))


def truthy(text: Column) -> Column:
    """Truth of a JSON scalar that was read as text."""
    return F.coalesce(~text.isin("", "0", "0.0", "false", "null", "[]", "{}"), F.lit(False))


def first_text(*cols: Column) -> Column:
    """First non-blank of several texts, '' when all are blank."""
    return F.coalesce(*[F.when(~is_blank(c), c) for c in cols], F.lit(""))


def ratio(part: Column, whole: Column, digits: int | None = 4) -> Column:
    """part / max(whole, 1), rounded at the output edge."""
    value = part.cast("double") / F.greatest(whole, F.lit(1))
    return value if digits is None else F.round(value, digits)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often `body` mentions it."""
    return F.get(F.transform(F.array(value), body), 0)
