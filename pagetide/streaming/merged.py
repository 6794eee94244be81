"""A table that micro-batches of updated rows are merged into, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagetide.streaming.state import numbered_below, remove

BUCKETS = 16


class MergedTable:
    """Rows by key in buckets; a micro-batch rewrites the buckets it has rows for.

    `versions/batch=<n>` says for each bucket which batch wrote it last, `data/version=<n>/bucket=<k>` has its rows.
    A batch reads the versions that the batch before left, writes new buckets beside the old ones, and then its own
    versions, which makes them visible all at once. A batch that is run again writes the same folders again, from the
    same versions before it. Buckets that no kept version names are removed.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: StructType, buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.schema, self.buckets = spark, folder, keys, schema, buckets

    def versions(self, below: int = 1 << 62) -> tuple[int, dict[int, int]]:
        """Number of the last finished batch below a number, -1 without one, and the version of each bucket."""
        done = numbered_below(self.spark, f"{self.folder}/versions", below)
        if not done:
            return -1, {}
        rows = self.spark.read.schema("bucket INT, version BIGINT").parquet(f"{self.folder}/versions/batch={done[-1]}")
        return done[-1], {r["bucket"]: r["version"] for r in rows.collect()}

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Put the rows of a batch in the place of those with the same key; a key has one row in a batch."""
        before, versions = self.versions(batch_id)
        # Written first, so that the keyed state behind the batch is worked out once.
        staged = f"{self.folder}/staged/batch={batch_id}"
        batch.write.mode("overwrite").parquet(staged)
        batch = self.spark.read.schema(self.schema).parquet(staged)
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        # At most as many rows as there are buckets.
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}
        if touched:
            old = self._rows({b: v for b, v in versions.items() if b in touched})
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
            kept = old.alias("o").join(batch.select(*self.keys).alias("n"), same, "left_anti")
            kept = kept.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
            whole = kept.unionByName(new).repartition(len(touched), "bucket")
            whole.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/version={batch_id}")
        now = versions | dict.fromkeys(touched, batch_id)
        rows = self.spark.createDataFrame(sorted(now.items()), "bucket INT, version BIGINT")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/batch={batch_id}")
        remove(self.spark, staged)
        for old in numbered_below(self.spark, f"{self.folder}/versions", before):
            remove(self.spark, f"{self.folder}/versions/batch={old}")
        live = set(now.values()) | set(versions.values())
        for old in numbered_below(self.spark, f"{self.folder}/data", batch_id, "version"):
            if old not in live:
                remove(self.spark, f"{self.folder}/data/version={old}")

    def read(self) -> DataFrame:
        return self._rows(self.versions()[1])
