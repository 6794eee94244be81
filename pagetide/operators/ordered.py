"""Ordered lookups that stay distributed when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of the whole table that a span of the order axis holds, about.
DEFAULT_SPAN = 1_000_000


def with_span(df: DataFrame, order: str, span: int) -> DataFrame:
    """Add `_span`: the number of the row's range of the order column, each holding about `span` rows.

    Ranges end at quantiles of the order column, so sparse, hashed and time-based ids are cut as evenly as dense
    ones. The quantiles come from one aggregate over that column; a row finds its range by bisection, one column a
    step. A table of at most `span` rows is one range. Equal order values are never parted.
    """
    parts = -(-df.count() // int(span))
    if parts <= 1:
        return df.withColumn("_span", F.lit(0))
    shares = [k / parts for k in range(1, parts)]
    bounds = sorted(set(df.agg(F.percentile_approx(order, shares, 100 * parts).alias("b")).first()["b"] or []))
    if not bounds:
        return df.withColumn("_span", F.lit(0))
    step = 1 << (len(bounds).bit_length() - 1)
    table = F.array(*[F.lit(b) for b in bounds + [bounds[-1]] * (2 * step - len(bounds))])
    df = df.withColumn("_span", F.lit(0))
    while step:
        at = F.col("_span") + step
        passed = (at <= len(bounds)) & (F.element_at(table, at) < F.col(order))
        df = df.withColumn("_span", F.when(passed, at).otherwise(F.col("_span")))
        step //= 2
    return df


def previous_where(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    condition: Column | None,
    value: str,
    into: str,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Add `into`: column `value` of the nearest earlier row of the same key meeting `condition`.

    A single window over the key would sort a hot key in one task.  Here the order axis
    is cut into spans: a window looks back inside (key, span) only, and each span inherits the last
    match of the spans before it through a summary holding one row per (key, span).  The rows are
    shuffled once, by (key, span); the summary is combined map-side and is the only thing shuffled
    by key.  Without a condition the value column is read in place, so rows carry no second copy.
    """
    keys = list(keys)
    cut = keys + ["_span"]
    inside = Window.partitionBy(*cut).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    hit = F.col(value) if condition is None else F.when(condition, F.col(value))
    rank = F.col(order) if condition is None else F.when(condition, F.col(order))

    rows = with_span(df, order, span)
    near = rows.withColumn("_near", F.last(hit, ignorenulls=True).over(inside))
    spans = (
        rows.groupBy(*cut)
        .agg(F.max_by(hit, rank).alias("_final"))
        .withColumn("_inherited", F.last("_final", ignorenulls=True).over(before))
        .drop("_final")
    )
    return (
        near.join(spans, cut, "left")
        .withColumn(into, F.coalesce("_near", "_inherited"))
        .drop("_span", "_near", "_inherited")
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """The row with the greatest order values per key, by a map-side combinable max_by."""
    columns = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*columns), rank).alias("_row"))
        .select(*keys, "_row.*")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """The row with the smallest order values per key."""
    columns = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*columns), rank).alias("_row"))
        .select(*keys, "_row.*")
    )


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per key; Spark limits each group before the shuffle, so hot keys are cheap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def position_in_key(
    df: DataFrame, keys: Sequence[str], order: str, into: str, span: int = DEFAULT_SPAN
) -> DataFrame:
    """Add the 1-based position of a row within its key.

    As in `previous_where`, rows are numbered inside spans of the order axis and shifted by the
    row counts of the spans before, so that no task holds a whole key.
    """
    keys = list(keys)
    cut = keys + ["_span"]
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    rows = with_span(df, order, span).withColumn(
        "_local", F.row_number().over(Window.partitionBy(*cut).orderBy(order))
    )
    spans = (
        rows.groupBy(*cut)
        .agg(F.count("*").alias("_rows"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    return (
        rows.join(spans, cut)
        .withColumn(into, F.col("_local") + F.col("_shift"))
        .drop("_span", "_local", "_shift")
    )
