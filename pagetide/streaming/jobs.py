"""Structured Streaming twins of the run-history operators.

Every function takes a streaming DataFrame and returns one (or starts a query), so the same
code runs continuously or with `trigger(availableNow=True)`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagetide.functions.urls import url_hash
from pagetide.operators.changes import compare_with_previous, diff_maps, explode_changes
from pagetide.operators.kpi import USAGE_COUNTERS
from pagetide.operators.notify import due_retries
from pagetide.operators.runs import payload_fields, typed_runs
from pagetide.streaming.merged import MergedTable
from pagetide.streaming.state import numbered_below, remove, shared_folder

# ---- Fixed values
LATENESS = "1 hour"
INACTIVE_GAP = "14 days"
# ---- end of fixed values

_PAIR = (
    "tenant_id STRING, url STRING, run_id BIGINT, task_id STRING, previous_run_id BIGINT, "
    "previous_json STRING, current_json STRING"
)
# How long the last success of a URL is remembered after it was seen.
REMEMBERED_MS = 180 * 24 * 3600 * 1000


class _LastSuccess(StatefulProcessor):
    """Pairs the first run of each chain with the last run of the chain before; the state is that last run.

    It has a time to live, so a URL that is no longer run leaves nothing behind.
    """

    def __init__(self, remembered_ms: int):
        self.remembered_ms = remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "run_id BIGINT, fields STRING", self.remembered_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chains = pd.concat(list(rows)).sort_values("run_id")
        last = self.last.get() if self.last.exists() else (None, None)
        befores = [tuple(last), *zip(chains["last_id"].astype(int), chains["last_json"], strict=True)]
        self.last.update((int(befores[-1][0]), befores[-1][1]))
        yield pd.DataFrame(
            {
                "tenant_id": key[0], "url": key[1], "run_id": chains["run_id"].to_numpy(), "task_id": chains["task_id"].to_numpy(),
                "previous_run_id": pd.array([b[0] for b in befores[:-1]], "Int64"), "previous_json": [b[1] for b in befores[:-1]],
                "current_json": chains["fields_json"].to_numpy(),
            }
        )

    def close(self) -> None:
        pass


def chained(chains: DataFrame, remembered_ms: int = REMEMBERED_MS) -> DataFrame:
    """Changed fields of the first run of each chain against the last run of the chain before it.

    `chains`: tenant_id, url, run_id, task_id and fields_json of the first run, last_id and last_json of the last one.
    """
    pairs = chains.groupBy("tenant_id", "url").transformWithStateInPandas(
        _LastSuccess(remembered_ms), _PAIR, "append", "ProcessingTime"
    )
    as_map = lambda c: F.from_json(c, "MAP<STRING,STRING>")
    empty = F.create_map().cast("map<string,string>")
    return (
        pairs.where(F.col("previous_json").isNotNull())
        .select(
            "tenant_id", "url", "run_id", "task_id", "previous_run_id",
            F.explode(diff_maps(as_map("previous_json"), as_map("current_json"), empty)).alias("c"),
        )
        .select("tenant_id", "url", "run_id", "task_id", "previous_run_id", "c.*")
    )


def _successes(runs: DataFrame) -> DataFrame:
    return typed_runs(runs).where(F.col("status") == "success").select(
        "tenant_id", "url", "run_id", "task_id", F.to_json(payload_fields()).alias("fields_json")
    )


def change_stream(runs: DataFrame, remembered_ms: int = REMEMBERED_MS) -> DataFrame:
    """Changed fields of each successful run against the previous one of its tenant and URL.

    The keyed step only pairs payloads; the comparison itself is the batch expression.  Runs of a
    key must arrive in id order between micro-batches, as they do in a run log.  A key's runs of one
    micro-batch meet in one task; `change_log` keeps them apart.
    """
    ok = _successes(runs)
    return chained(ok.withColumns({"last_id": F.col("run_id"), "last_json": F.col("fields_json")}), remembered_ms)


_CHANGED = ["tenant_id", "url", "run_id", "previous_run_id", "field", "change_type", "before_text", "after_text"]


def change_log(runs: DataFrame, folder: str, remembered_ms: int = REMEMBERED_MS) -> DataFrame:
    """T01 for hot URLs: all changes of a stream of runs, as a table below `folder`.

    Each micro-batch is compared within itself by the batch operator, which spreads the runs of a
    URL over many tasks, and leaves one chain for each URL: its first and last success.  A second
    stream links the chains, so the keyed state sees a single row of a URL and micro-batch.  Both
    write by batch number, so a repeated batch writes the same files again.
    """
    spark = runs.sparkSession

    def within(batch: DataFrame, batch_id: int) -> None:
        # The payloads are parsed once; what is compared is read three times.
        staged = f"{folder}/successes/batch={batch_id}"
        document = F.struct("doc.data", "doc.field_labels").alias("doc")
        parsed = typed_runs(batch).where(F.col("status") == "success").select(
            "tenant_id", "url", "run_id", "task_id", "status", "completed_at", document, "entries"
        )
        parsed.write.mode("overwrite").parquet(staged)
        batch = batch.sparkSession.read.schema(parsed.schema).parquet(staged)
        inner = explode_changes(compare_with_previous(batch)).select(*_CHANGED)
        inner.write.mode("overwrite").parquet(f"{folder}/within/batch={batch_id}")
        run = F.struct("run_id", "task_id", "fields_json")
        ends = _successes(batch).groupBy("tenant_id", "url").agg(F.min_by(run, "run_id").alias("a"), F.max_by(run, "run_id").alias("z"))
        chains = ends.select("tenant_id", "url", "a.*", F.col("z.run_id").alias("last_id"), F.col("z.fields_json").alias("last_json"))
        chains.write.mode("overwrite").parquet(f"{folder}/chains/batch={batch_id}")
        remove(batch.sparkSession, staged)

    runs.writeStream.foreachBatch(within).option("checkpointLocation", f"{folder}/within-checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = "tenant_id STRING, url STRING, run_id BIGINT, task_id STRING, fields_json STRING, last_id BIGINT, last_json STRING"
    chains = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/chains/*")
    linked = chained(chains, remembered_ms).select(*_CHANGED)
    drained(linked.writeStream.format("parquet").option("path", f"{folder}/linked").option("checkpointLocation", f"{folder}/linked-checkpoint"), spark)
    return spark.read.schema(linked.schema).parquet(f"{folder}/within/*").unionByName(spark.read.schema(linked.schema).parquet(f"{folder}/linked"))


def dedupe_stream(pages: DataFrame, event_time: str = "fetched_at", lateness: str = LATENESS) -> DataFrame:
    """First row of each URL within the watermark; the state is bounded by it."""
    return (
        pages.withColumn("url_hash", url_hash(F.col("url")))
        .withWatermark(event_time, lateness)
        .dropDuplicatesWithinWatermark(["url_hash"])
    )


def usage_stream(events: DataFrame, event_time: str = "created_at", lateness: str = LATENESS) -> DataFrame:
    """The usage counters per tenant and day, in tumbling one-day windows."""
    sums = [F.sum(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))).alias(c) for c in USAGE_COUNTERS if c in events.columns]
    return (
        events.withWatermark(event_time, lateness)
        .groupBy("tenant_id", F.window(event_time, "1 day").alias("w"))
        .agg(*sums)
        .select("tenant_id", F.to_date("w.start").alias("usage_date"), *[c for c in USAGE_COUNTERS if c in events.columns])
    )


DIGEST_COUNTS = ("total", "sent", "failed", "retry_pending")


def hourly_digest_stream(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Notification counts of each hour, from which `trailing_day` makes those of a day."""
    return (
        events.withWatermark("created_at", lateness)
        .groupBy("tenant_id", F.window("created_at", "1 hour").alias("w"))
        .agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in DIGEST_COUNTS[1:]])
        .select("tenant_id", F.col("w.start").alias("hour"), *DIGEST_COUNTS)
    )


def trailing_day(hours: DataFrame, length: int = 24) -> DataFrame:
    """Counts of the day before each full hour: an hour's counts are added to the `length` days that it is part of."""
    ends = F.explode(F.sequence(F.lit(1), F.lit(length))).alias("h")
    spread = hours.select("*", ends).withColumn("window_end", F.col("hour") + F.make_dt_interval(hours=F.col("h")))
    return spread.groupBy("tenant_id", "window_end").agg(*[F.sum(c).alias(c) for c in DIGEST_COUNTS])


_SENT = "tenant_id STRING, monitor_id STRING, notification_id BIGINT, created_at TIMESTAMP"


class _Cooldown(StatefulProcessor):
    """Lets an alert pass when its cooldown since the last passed one is over; errors always pass.

    A timer of the key forgets the last one when event time has passed the longest cooldown after it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms BIGINT, longest_ms BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        alerts = pd.concat(list(rows)).sort_values(["created_at", "notification_id"])
        last, longest = self.last.get() if self.last.exists() else (None, 0)
        at = alerts["created_at"].astype("datetime64[us]").astype("int64").to_numpy()
        wait = alerts["cooldown_minutes"].to_numpy().astype("int64") * 60_000_000
        free = (alerts["alert_level"] == "error").to_numpy()
        passed = []
        for k, (now, quiet, error) in enumerate(zip(at.tolist(), wait.tolist(), free.tolist(), strict=True)):
            if last is None or error or now - last >= quiet:
                last = now
                passed.append(k)
        longest = max(longest, int(wait.max()))
        self.last.update((last, longest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max((last + longest) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        kept = alerts.iloc[passed]
        yield pd.DataFrame({"tenant_id": key[0], "monitor_id": key[1], "notification_id": kept["notification_id"].to_numpy(), "created_at": kept["created_at"].to_numpy()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def cooldown_stream(alerts: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Alerts that pass the cooldown of their monitor.

    `alerts`: tenant_id, monitor_id, notification_id, alert_level, cooldown_minutes, created_at.  A monitor's cooldown
    stays the same or gets shorter; alerts later than the watermark do not count.
    """
    return (
        alerts.withWatermark("created_at", lateness)
        .groupBy("tenant_id", "monitor_id")
        .transformWithStateInPandas(_Cooldown(), _SENT, "append", "EventTime")
    )


def once_a_day_stream(digests: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The first digest of each target and day."""
    return (
        digests.withColumn("day", F.to_date("created_at"))
        .withWatermark("created_at", lateness)
        .dropDuplicatesWithinWatermark(["tenant_id", "channel_type", "target", "day"])
    )


def drain_due_retries(
    events: DataFrame, as_of: Column, handle: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Hand every due retry that has arrived to `handle`, then stop."""
    return (
        due_retries(events, as_of)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def daily_activity_stream(runs: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """First and last run and number of runs of each tenant and day, from which `activity_sessions` makes spans."""
    return (
        runs.withWatermark("created_at", lateness)
        .groupBy("tenant_id", F.window("created_at", "1 day").alias("w"))
        .agg(F.count("*").alias("runs"), F.min("created_at").alias("first_run_at"), F.max("created_at").alias("last_run_at"))
        .select("tenant_id", F.to_date("w.start").alias("day"), "runs", "first_run_at", "last_run_at")
    )


def activity_sessions(days: DataFrame, gap: str = INACTIVE_GAP) -> DataFrame:
    """Spans of tenant activity; after `inactive_since` the tenant has been quiet for `gap`, which is a day at least.

    Windows run over the days of a tenant, not over its runs.
    """
    quiet = F.expr(f"INTERVAL {gap}")
    by_day = Window.partitionBy("tenant_id").orderBy("day")
    starts = F.coalesce(F.col("first_run_at") >= F.lag("last_run_at").over(by_day) + quiet, F.lit(True)).cast("int")
    spans = days.withColumn("_starts", starts).withColumn("_span", F.sum("_starts").over(by_day))
    return (
        spans.groupBy("tenant_id", "_span")
        .agg(F.min("first_run_at").alias("active_from"), F.max("last_run_at").alias("last_run_at"), F.sum("runs").alias("runs"))
        .select("tenant_id", "active_from", (F.col("last_run_at") + quiet).alias("inactive_since"), "runs", "last_run_at")
    )


def split_late(
    spark: SparkSession, events: DataFrame, on_time: str, late: str, checkpoint: str,
    event_time: str = "created_at", lateness_seconds: int = 3600,
) -> StreamingQuery:
    """Route rows later than the lateness bound to a side table, the others to `on_time`.

    The high-water mark after each micro-batch is a table of one row next to the checkpoint, which has
    all marks before folded in.  A batch reads the mark of the one before it, so a restarted or
    repeated batch sees what it saw before; older marks are removed.
    """
    marks = f"{checkpoint}-marks"

    def route(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = numbered_below(session, marks, batch_id)
        high = session.read.schema("high TIMESTAMP").parquet(f"{marks}/batch={before[-1]}").first()["high"] if before else None
        is_late = F.lit(False)
        if high is not None:
            bound = F.lit(high) - F.make_interval(secs=F.lit(lateness_seconds).cast("decimal(18,6)"))
            is_late = F.coalesce(F.col(event_time) < bound, F.lit(False))
        for rows, folder in ((batch.where(is_late), late), (batch.where(~is_late), on_time)):
            rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        batch.agg(F.greatest(F.max(event_time), F.lit(high).cast("timestamp")).alias("high")).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")
        for old in before[:-1]:
            remove(session, f"{marks}/batch={old}")

    return (
        events.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def upsert_usage(usage_delta: DataFrame, current: DataFrame | None) -> DataFrame:
    """A07 incremental: daily counters after adding the partial sums of a micro-batch."""
    counters = [c for c in USAGE_COUNTERS if c in usage_delta.columns]
    both = usage_delta if current is None else current.unionByName(usage_delta, allowMissingColumns=True)
    return both.groupBy("tenant_id", "usage_date").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counters])


NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def drained(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Run a query that gives its rows at once until everything available is processed.

    Micro-batches without data are switched off for it: with a time to live by the clock they would never end.
    """
    before = spark.conf.get(NO_DATA_BATCHES)
    spark.conf.set(NO_DATA_BATCHES, "false")
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(NO_DATA_BATCHES, before)
    query.awaitTermination()
    return query


def run_to_table(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Process everything available into a parquet table in the shared folder, by appending, and read it back."""
    folder = shared_folder(spark, name)
    table = f"{folder}/table"
    drained(stream.writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", f"{folder}/checkpoint"), spark)
    return spark.read.schema(stream.schema).parquet(table)


def run_to_merged_table(stream: DataFrame, spark: SparkSession, name: str, keys: list[str]) -> DataFrame:
    """Process everything available by updates merged into a table in the shared folder, and read it back."""
    folder = shared_folder(spark, name)
    table = MergedTable(spark, f"{folder}/table", keys, stream.schema)
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.outputMode("update").foreachBatch(table.merge).start().awaitTermination()
    return table.read()
