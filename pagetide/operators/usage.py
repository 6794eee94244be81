"""Model usage and cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions.blank import ratio
from pagetide.operators.kpi import n_if

# ---- Fixed values: model prefix, USD per million input tokens, USD per million output tokens;
# ---- the first matching prefix counts.
MODEL_PRICES = (
    ("gpt-4o-mini", 0.15, 0.60), ("gpt-4.1-mini", 0.40, 1.60), ("gpt-4o", 5.00, 15.00),
    ("gpt-4.1", 2.00, 8.00), ("gpt-5.4-mini", 0.15, 0.60), ("gpt-5-mini", 0.15, 0.60),
    ("claude-3-5-haiku", 0.80, 4.00), ("claude-3-5-sonnet", 3.00, 15.00),
    ("claude-3-7-sonnet", 3.00, 15.00), ("claude-sonnet-4", 3.00, 15.00),
    ("claude-4-sonnet", 3.00, 15.00),
)
# ---- end of fixed values


def model_price(
    model: Column,
    prices: Sequence[tuple[str, float, float]] = MODEL_PRICES,
    override: tuple[float, float] | None = None,
) -> Column:
    """F32: STRUCT<input, output> price of a model; a positive override replaces the table."""
    price = lambda a, b: F.struct(F.lit(float(a)).alias("input"), F.lit(float(b)).alias("output"))
    if override and max(override) > 0:
        return price(*override)
    name = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    chain = F.when(F.lit(False), price(0, 0))
    for prefix, into, out in prices:
        chain = chain.when(name.startswith(prefix), price(into, out))
    return chain.otherwise(price(0, 0))


def call_cost(prompt_tokens: Column, completion_tokens: Column, price: Column) -> Column:
    """F32: USD cost of one call."""
    return (prompt_tokens * price["input"] + completion_tokens * price["output"]) / 1_000_000


def usage_totals(calls: DataFrame, *keys: str, override: tuple[float, float] | None = None) -> DataFrame:
    """Calls, tokens, cost and time; `calls` has model, prompt_tokens, completion_tokens, source, elapsed_ms."""
    cost = call_cost(F.col("prompt_tokens"), F.col("completion_tokens"), model_price(F.col("model"), override=override))
    return (
        calls.withColumn("_cost", cost)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("total_calls"),
            F.sum("elapsed_ms").alias("total_time_ms"),
            F.sum("prompt_tokens").alias("prompt_tokens"),
            F.sum("completion_tokens").alias("completion_tokens"),
            F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
            F.round(F.sum("_cost"), 6).alias("estimated_cost_usd"),
            n_if(F.col("source") == "api").alias("api_usage_calls"),
            n_if(F.col("source") == "auth_error").alias("auth_error_calls"),
            n_if(~F.col("source").isin("api", "auth_error")).alias("estimated_usage_calls"),
        )
        .withColumn("avg_time_ms", F.round(F.col("total_time_ms") / F.col("total_calls"), 2))
        .withColumn("api_usage_ratio", ratio(F.col("api_usage_calls"), F.col("total_calls")))
    )
