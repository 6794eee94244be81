"""Partition layout helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """Give a file scan at least one partition per core before CPU-heavy work.

    A large table already has far more splits than cores and passes through unchanged; only
    an input that fits in a few splits is redistributed (round robin, so skew cannot form).
    Some of few splits may be without rows, as a row group belongs to one split whole.
    Call it on a scan, not on a plan that contains shuffles.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= 4 * cores else scan.repartition(cores)
