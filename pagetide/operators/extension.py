"""Extension points (G01, G03, G05): steps are DataFrame functions, extractors are batch functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]
BatchExtractor = Callable[[pd.DataFrame], pd.DataFrame]

EXTRACTED = "page_id BIGINT, field STRING, value STRING"


def run_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Apply steps one after another, each from DataFrame to DataFrame."""
    for step in steps:
        df = df.transform(step)
    return df


def apply_extractor(pages: DataFrame, extractor: BatchExtractor, schema: str = EXTRACTED) -> DataFrame:
    """Run a user's extractor over Arrow batches of pages.

    The extractor gets a pandas frame of pages and returns rows of `schema`; batches stream
    through, so a partition is never held whole.
    """

    def over_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield extractor(batch)

    return pages.mapInPandas(over_batches, schema)
