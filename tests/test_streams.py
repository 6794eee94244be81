"""State that ends, batches that are run again, and sums that are merged."""

import time

from pyspark.sql import functions as F

from pagetide.plans import stream_queries
from pagetide.streaming import jobs as J
from pagetide.streaming.merged import MergedTable
from pagetide.streaming.state import numbered_below

RUN = "tenant_id STRING, url STRING, run_id BIGINT, task_id STRING, fields_json STRING, last_id BIGINT, last_json STRING"


def chain(spark, folder, run_id, price):
    fields = f'{{"price": "{price}"}}'
    spark.createDataFrame([("t", "u", run_id, f"task-{run_id}", fields, run_id, fields)], RUN).coalesce(1).write.mode("append").parquet(folder)


def test_the_last_success_is_forgotten_after_its_time(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(run_id, price):
        chain(spark, source, run_id, price)
        stream = J.chained(spark.readStream.schema(RUN).parquet(source), remembered_ms=15_000)
        J.drained(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")), spark)
        return {(r["run_id"], r["previous_run_id"]) for r in spark.read.schema(stream.schema).parquet(out).collect()}

    assert run(1, "5") == set()
    assert run(2, "6") == {(2, 1)}
    time.sleep(16)
    assert run(3, "7") == {(2, 1)}


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    schema = "k STRING, day INT, n BIGINT"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    table = MergedTable(spark, str(tmp_path), ["k", "day"], frame(("", 0, 0)).schema, buckets=4)
    rows = lambda: {tuple(r) for r in table.read().collect()}
    table.merge(frame(*[(f"k{i}", 1, i) for i in range(20)], (None, 1, 7)), 0)
    first = rows()
    assert len(first) == 21
    second = frame(("k3", 1, 300), ("new", 2, 1), (None, 1, 8))
    table.merge(second, 1)
    merged = rows()
    assert merged == (first - {("k3", 1, 3), (None, 1, 7)}) | {("k3", 1, 300), ("new", 2, 1), (None, 1, 8)}
    table.merge(second, 1)
    assert rows() == merged
    table.merge(second.limit(0), 2)
    assert rows() == merged
    for number in range(3, 7):
        table.merge(frame(*[(f"k{i}", 1, number) for i in range(20)]), number)
    assert {r[2] for r in rows() if r[0] in ("k1", "k19")} == {6}
    # Versions that no bucket needs are gone.
    assert len(numbered_below(spark, f"{tmp_path}/versions", 99)) <= 3
    assert min(numbered_below(spark, f"{tmp_path}/data", 99, "version")) >= 1


def test_sessions_from_days(spark):
    at = lambda text: F.lit(text).cast("timestamp")
    days = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("tenant_id"), at(a).cast("date").alias("day"), F.lit(n).cast("bigint").alias("runs"), at(a).alias("first_run_at"), at(b).alias("last_run_at"))
        for t, a, b, n in [("a", "2024-01-01 05:00:00", "2024-01-01 06:00:00", 2), ("a", "2024-01-15 05:59:59", "2024-01-15 07:00:00", 3),
                           ("a", "2024-01-29 07:00:00", "2024-01-29 07:00:00", 1), ("b", "2024-01-02 00:00:00", "2024-01-02 00:00:00", 1)]
    ])).alias("d")).select("d.*")
    got = sorted((r["tenant_id"], str(r["active_from"]), str(r["inactive_since"]), r["runs"]) for r in J.activity_sessions(days).collect())
    assert got == [
        ("a", "2024-01-01 05:00:00", "2024-01-29 07:00:00", 5), ("a", "2024-01-29 07:00:00", "2024-02-12 07:00:00", 1),
        ("b", "2024-01-02 00:00:00", "2024-01-16 00:00:00", 1),
    ]


def test_a_micro_batch_is_a_whole_part_of_the_events(spark, tmp_path, monkeypatch):
    """A part of several files is one batch: cut up, its files would come in any order, and rows before the mark be late."""
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 40)
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("id").cast("int") * 30)
    events = spark.range(1400).select(
        F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("click").alias("event_type"),
        F.col("id").cast("double").alias("value"), F.lit('{"k": 1}').alias("props"),
    )
    # Days 21 to 25 are empty, and a part has its rows in several files of the table, the late ones first.
    events.where("day(ts) NOT BETWEEN 21 AND 25").orderBy(F.desc("ts")).repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    stream = stream_queries.event_stream(spark, str(tmp_path))
    query = stream.writeStream.foreachBatch(lambda batch, _: seen.append({(r[0] - 1) // 5 for r in batch.select(F.dayofmonth("ts")).distinct().collect()}))
    query.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert seen == [{0}, {1}, {2}, {3}, set(), {5}]
