"""Streaming operators run with `availableNow` over the whole events table, checked like batch queries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.plans import sql_views as S
from pagetide.plans import views as V
from pagetide.plans.registry import day_text, query, stamp
from pagetide.plans.run_queries import _PAIRS
from pagetide.streaming import jobs as J
from pagetide.streaming.state import shared_folder

_NTZ = "TIMESTAMP '1970-01-01 00:00:00'"


PARTS = 6
# Rows of a part that one file holds, about.
FILE_ROWS = 500_000
_FOLDERS: dict[tuple[str, str, str], tuple[str, int]] = {}


def whole_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, in one micro-batch."""
    schema = V.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def event_stream(spark: SparkSession, sf_dir: str, part: str = "(day(ts) - 1) div 5") -> DataFrame:
    """The events as a stream of several micro-batches: files written one after the other, by the number of a part.

    Every part has the same number of files, so a micro-batch is one whole part, however large the table is. A part cut
    into several would have its rows come in the order of its files, not in that of the log.
    """
    events = V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    key = (spark.sparkContext.applicationId, sf_dir, part)
    if key not in _FOLDERS:
        number = F.expr(f"least({part}, {PARTS - 1})")
        rows = [r["count"] for r in events.where(number.between(0, PARTS - 1)).groupBy(number.alias("part")).count().collect()]
        files = max(1, -(-max(rows, default=0) // FILE_ROWS))
        _FOLDERS[key] = write_parts((events.where(number == k) for k in range(PARTS)), shared_folder(spark, "event-parts"), files), files
    folder, files = _FOLDERS[key]
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(folder)


def write_parts(parts: Iterable[DataFrame], folder: str, files: int) -> str:
    """Write the parts one after the other, each as so many files; those without rows count."""
    for k, part in enumerate(parts, start=1):
        part.repartition(files).write.mode("append").parquet(folder)
        for _ in range(k * files - len(part.sparkSession.read.schema(part.schema).parquet(folder).inputFiles())):
            part.sparkSession.createDataFrame([], part.schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def _k():
    return F.get_json_object("props", "$.k").cast("int")


@query("stream_field_changes", S.with_(S.RUNS).rstrip() + _PAIRS + """
SELECT tenant_id, url, run_id, prev_id AS previous_run_id, field, change_type FROM diffs""")
def stream_field_changes(spark, sf):
    # Parts by id: runs come in the order of their ids.
    top = V.table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    runs = V.runs_of(event_stream(spark, sf, f"event_id * {PARTS} div {(top or 0) + 1}"))
    return J.change_log(runs, shared_folder(spark, "changes")).select(
        "tenant_id", "url", "run_id", "previous_run_id", "field", "change_type"
    )


@query("stream_first_urls", "SELECT 'https://h/' || user_id AS url, 1 AS first_rows FROM events GROUP BY user_id")
def stream_first_urls(spark, sf):
    pages = event_stream(spark, sf).select(F.concat(F.lit("https://h/"), "user_id").alias("url"), F.col("ts").alias("fetched_at"))
    kept = J.run_to_table(J.dedupe_stream(pages, lateness="40 days"), spark, "dedupe")
    return kept.groupBy("url").agg(F.count("*").cast("int").alias("first_rows"))


@query("stream_daily_usage", """SELECT 't' || (user_id % 5) AS tenant_id, strftime(ts, '%Y-%m-%d') AS usage_date, count(*) AS tasks_created,
  CAST(sum(user_id) AS BIGINT) AS total_tokens FROM events GROUP BY 1, 2""")
def stream_daily_usage(spark, sf):
    events = event_stream(spark, sf).select(
        F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant_id"), F.col("ts").alias("created_at"),
        F.lit(1).alias("tasks_created"), F.col("user_id").alias("total_tokens"),
    )
    return J.run_to_merged_table(J.usage_stream(events), spark, "usage", ["tenant_id", "usage_date"]).select(
        "tenant_id", day_text("usage_date").alias("usage_date"), "tasks_created", "total_tokens"
    )


@query("stream_digests", S.with_(S.NOTIFICATIONS) + """SELECT tenant_id, strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS total, count(*) FILTER (status = 'sent') AS sent,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'retry_pending') AS retry_pending
FROM (SELECT *, unnest(range(1, 25)) AS h, date_trunc('hour', created_at) + to_hours(CAST(h AS BIGINT)) AS window_end FROM notes) GROUP BY 1, 2""")
def stream_digests(spark, sf):
    events = V.notification_events_of(event_stream(spark, sf))
    hours = J.run_to_merged_table(J.hourly_digest_stream(events), spark, "digest", ["tenant_id", "hour"])
    return J.trailing_day(hours).withColumn("window_end", stamp("window_end"))


@query("stream_once_a_day", S.with_(S.NOTIFICATIONS) + """SELECT tenant_id, target, strftime(created_at, '%Y-%m-%d') AS day, 1 AS digests FROM notes WHERE event_type = 'daily_digest' GROUP BY 1, 2, 3""")
def stream_once_a_day(spark, sf):
    digests = V.notification_events_of(event_stream(spark, sf)).where(F.col("event_type") == "daily_digest")
    kept = J.run_to_table(J.once_a_day_stream(digests, "40 days"), spark, "once")
    return kept.groupBy("tenant_id", "target", day_text("day").alias("day")).agg(F.count("*").cast("int").alias("digests"))


@query("stream_cooldown")
def stream_cooldown(spark, sf):
    """Alerts that pass a two-hour cooldown per monitor; checked against a row loop in the tests."""
    alerts = V.notification_events_of(event_stream(spark, sf)).select(
        "tenant_id", "monitor_id", "notification_id", F.when(F.col("status") == "failed", "error").otherwise("changed").alias("alert_level"),
        F.lit(120).alias("cooldown_minutes"), "created_at",
    )
    return J.run_to_table(J.cooldown_stream(alerts), spark, "cooldown").select("tenant_id", "monitor_id", "notification_id")


@query("stream_due_retries", S.with_(S.NOTIFICATIONS) + f"SELECT notification_id FROM notes WHERE status = 'retry_pending' AND next_retry_at <= {S.AS_OF_SQL}")
def stream_due_retries(spark, sf):
    folder = shared_folder(spark, "retries")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.select("notification_id").write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id}")

    J.drain_due_retries(V.notification_events_of(event_stream(spark, sf)), V.as_of(), keep, f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("notification_id BIGINT").parquet(f"{folder}/table").select("notification_id")


@query("stream_activity", """SELECT 't' || (user_id % 5) AS tenant_id, count(*) AS runs, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_run_at FROM events GROUP BY 1""")
def stream_activity(spark, sf):
    runs = event_stream(spark, sf).select(F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant_id"), F.col("ts").alias("created_at"))
    days = J.run_to_merged_table(J.daily_activity_stream(runs), spark, "activity", ["tenant_id", "day"])
    return J.activity_sessions(days).select(
        "tenant_id", "runs", stamp("last_run_at").alias("last_run_at")
    )


@query("stream_late_rows", "SELECT 0 AS late_rows, count(*) AS on_time_rows FROM events")
def stream_late_rows(spark, sf):
    folder = shared_folder(spark, "late")
    events = whole_event_stream(spark, sf).select("event_id", F.col("ts").alias("created_at"))
    J.split_late(spark, events, f"{folder}/on_time", f"{folder}/late", f"{folder}/checkpoint").awaitTermination()
    count = lambda name: spark.read.schema(events.schema).parquet(f"{folder}/{name}").agg(F.count("*").alias(name + "_rows"))
    return count("late").select(F.col("late_rows").cast("int").alias("late_rows")).join(count("on_time"))


@query("stream_late_split", f"""WITH p AS (SELECT event_id, ts, least((day(ts) - 1) // 5 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, {PARTS - 1}) AS part FROM events),
highs AS (SELECT part, max(ts) AS high FROM p GROUP BY part),
marks AS (SELECT part, max(high) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM highs)
SELECT p.event_id, coalesce(p.ts < m.mark - INTERVAL 1 HOUR, false) AS late FROM p JOIN marks m ON m.part = p.part""")
def stream_late_split(spark, sf):
    """T09 with every tenth row held back to the next part, so that it comes late."""
    folder = shared_folder(spark, "late-split")
    events = event_stream(spark, sf, "(day(ts) - 1) div 5 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END").select("event_id", F.col("ts").alias("created_at"))
    J.split_late(spark, events, f"{folder}/on_time", f"{folder}/late", f"{folder}/checkpoint").awaitTermination()
    read = lambda name: spark.read.schema(events.schema).parquet(f"{folder}/{name}/*").select("event_id", F.lit(name == "late").alias("late"))
    return read("late").unionByName(read("on_time"))
