"""Run history, notifications, sources and streams on small literals."""

import json

from pyspark.sql import functions as F

from pagetide.operators import changes, kpi, monitors as M, runs as R
from pagetide.plans import catalog, views as V
from pagetide.sources import readers, schemas
from pagetide.streaming import jobs

COLUMNS = (
    "run_id LONG, task_id STRING, tenant_id STRING, url STRING, schema_name STRING, storage_format STRING, batch_group_id STRING, "
    "parent_task_id STRING, status STRING, created_at TIMESTAMP, completed_at TIMESTAMP, elapsed_ms DOUBLE, quality_score DOUBLE, data_json STRING, error STRING"
)


def history(spark, *rows):
    full = []
    for i, (status, payload, error) in enumerate(rows, 1):
        full.append((i, f"t{i}", "default", "https://a.com/p", "auto", "json", "", "", status, None, None, 10.0, 1.0, json.dumps(payload) if payload is not None else "", error))
    return spark.createDataFrame(full, COLUMNS).withColumn("created_at", F.lit("2024-01-05 10:00:00").cast("timestamp"))


def test_price_change_is_found_past_a_failure(spark):
    runs = history(
        spark, ("success", {"data": {"price": "99", "name": "W"}}, ""), ("failed", None, "timeout"),
        ("success", {"data": {"price": "79", "name": "W"}, "field_labels": {"price": "Price"}}, ""),
    )
    rows = changes.compare_with_previous(runs).orderBy("run_id").collect()
    assert [r.changed_count for r in rows] == [0, 1]
    c = rows[1].changes[0]
    assert (c.field, c.label, c.change_type, c.before_text, c.after_text) == ("price", "Price", "updated", "99", "79")


def test_nested_values_compare_by_content_and_long_text_counts(spark):
    long_a, long_b = "x" * 80 + "a", "x" * 80 + "b"
    runs = history(
        spark, ("success", {"data": {"m": {"a": 1, "b": 2}, "t": long_a, "gone": "1"}}, ""),
        ("success", {"data": {"m": {"b": 2, "a": 1}, "t": long_b, "new": ""}}, ""),
    )
    got = {c.field: c.change_type for c in changes.compare_with_previous(runs).where("run_id = 2").first().changes}
    assert got == {"t": "updated", "gone": "removed"}


def test_overview_rates(spark):
    runs = history(
        spark, ("success", {"_validation": {"status": "full_success"}}, ""), ("success", {"_validation": {"status": "partial_success"}}, ""),
        ("failed", None, "403 Forbidden challenge page"), ("failed", {"_validation": {"status": "failed", "errors": ["missing title"]}}, "validation failed"),
    )
    row = kpi.daily_overview(R.typed_runs(runs)).first()
    assert (row.full_success, row.partial_success, row.fetch_failed, row.validation_failed) == (1, 1, 1, 1)
    assert (row.fetch_success_rate, row.extraction_success_rate) == (0.75, 0.6667)


def test_field_counts_and_tokens(spark):
    runs = history(spark, ("success", {"data": {"a": "1", "b": "2", "c": ""}, "_extractor_stats": {"total_tokens": 125}}, ""))
    row = R.run_metrics(R.typed_runs(runs)).first()
    assert (row.field_count, row.filled_field_count, row.total_tokens, row.failure_category) == (3, 2, 125, None)


def test_flat_payload(spark):
    runs = history(spark, ("success", {"title": "T", "note": "", "selected_fields": ["title"]}, ""))
    assert R.typed_runs(runs).select(R.payload_fields().alias("f")).first().f == {"title": "T"}


def test_channels_merge(spark):
    channel = "STRUCT<channel_type: STRING, name: STRING, target: STRING, secret: STRING, enabled: BOOLEAN>"
    rows = spark.createDataFrame(
        [("t", "m", ([("Slack", "", " u ", "", False), ("slack", "n", "u", "s", True), ("fax", "", "v", "", None), ("slack", "", "", "", True)], "w"))],
        f"tenant_id STRING, monitor_id STRING, profile STRUCT<channels: ARRAY<{channel}>, webhook_url: STRING>",
    )
    got = sorted((r.channel_type, r.target, r.name, r.secret, r.enabled) for r in M.normalize_channels(rows).collect())
    assert got == [("slack", "u", "n", "s", True), ("webhook", "v", "", "", True), ("webhook", "w", "默认 Webhook", "", True)]


def test_cooldown_equals_row_loop(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = V.notification_events(spark, sf_dir).select("tenant_id", "monitor_id", "notification_id", "status", "created_at").collect()
    last, want = {}, set()
    for r in sorted(rows, key=lambda r: (r.created_at, r.notification_id)):
        key = (r.tenant_id, r.monitor_id)
        if r.status != "failed" and key in last and (r.created_at - last[key]).total_seconds() < 7200:
            continue
        last[key] = r.created_at
        want.add(r.notification_id)
    assert {r.notification_id for r in catalog.QUERIES["stream_cooldown"](spark, sf_dir).collect()} == want


def test_stream_state_survives_micro_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    runs = V.runs(spark, "/root/testdata/sf0.001")
    for part in range(3):
        runs.where((F.col("run_id") >= part * 400) & (F.col("run_id") < (part + 1) * 400)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    keys = ("run_id", "field", "change_type", "before_text", "after_text")
    got = {tuple(r) for r in jobs.run_to_table(jobs.change_stream(stream), spark, "t").select(*keys).collect()}
    want = {tuple(r) for r in changes.explode_changes(changes.compare_with_previous(runs)).select(*keys).collect()}
    assert got == want


def test_late_rows_go_to_the_side_table(spark, tmp_path):
    source = str(tmp_path / "in")
    stamp = lambda text: F.lit(text).cast("timestamp").alias("created_at")
    for number, text in enumerate(("2024-01-02 00:00:00", "2024-01-01 00:00:00", "2024-01-01 23:30:00")):
        spark.range(1).select(F.lit(number).alias("event_id"), stamp(text)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("event_id INT, created_at TIMESTAMP").option("maxFilesPerTrigger", 1).parquet(source)
    folder = str(tmp_path / "out")
    jobs.split_late(spark, stream, f"{folder}/ok", f"{folder}/late", f"{folder}/cp").awaitTermination()
    late = {r.event_id for r in spark.read.parquet(f"{folder}/late").collect()}
    on_time = {r.event_id for r in spark.read.parquet(f"{folder}/ok").collect()}
    assert (late, on_time) == ({1}, {0, 2})


def test_samples_from_json(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"samples": [{"url": " u ", "selected_fields": ["a", "b"], "expected_fields": {"a": "1"}, "dynamic": True}, {"url": "v", "selected_fields": "c, d", "min_fields": 2}]}))
    a, b = readers.read_samples(spark, str(path)).orderBy("url").collect()
    assert (a.url, a.selected_fields, a.expected_fields, a.min_fields, a.dynamic, a.split) == ("u", ["a", "b"], {"a": "1"}, 1, True, "fixed")
    assert (b.selected_fields, b.min_fields, b.page_type) == (["c", "d"], 2, "auto")


def test_body_charsets(spark):
    rows = [(1, "价格".encode("gb18030"), ""), (2, "价格".encode(), ""), (3, "é".encode("latin-1"), "text/html; charset=latin-1"), (4, "價格表".encode("big5"), "text/html; charset=big5")]
    df = spark.createDataFrame([(i, bytearray(b), h) for i, b, h in rows], "i INT, content BINARY, content_type STRING")
    got = {r.i: (r.text, r.charset) for r in readers.decode_bodies(df, content_type="content_type").collect()}
    assert got == {1: ("价格", "gb18030"), 2: ("价格", "utf-8"), 3: ("é", "latin-1"), 4: ("價格表", "big5")}


def test_declared_schema_file(spark, tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("fields:\n  name: {type: str, required: true}\n  tags: {type: 'list[str]'}\n  odd: {type: blob}\n  n: {type: int, default: 7}\n")
    schema, defaults = schemas.load_declared(path)
    rows = spark.createDataFrame([('{"name": "x", "tags": ["a"]}',), ("{}",)], ["payload"])
    a, b = schemas.apply_schema(rows, schema, defaults).collect()
    assert (a.name, a.tags, a.odd, a.n, a.missing_required) == ("x", ["a"], "", 7, [])
    assert (b.name, b.tags, b.missing_required) == (None, [], ["name"])


def test_registry_ignores_case():
    registry = schemas.SchemaRegistry()
    registry.register("Mine", schemas.BUILT_IN["news"])
    assert registry.get("MINE") is schemas.BUILT_IN["news"] and registry.get("none") is None


def _fields_of_events(spark, folder):
    """Three events in a table of their own, read as runs."""
    rows = [
        (0, "2024-01-05 10:00:00", 0, "purchase", 80.0, '{"k": 6}'), (1, "2024-01-06 10:00:00", 7, "error", 16.0, '{"k": 3}'),
        (2, "2024-01-07 10:00:00", 3, "view", None, None),
    ]
    events = spark.createDataFrame(rows, "event_id LONG, ts STRING, user_id LONG, event_type STRING, value DOUBLE, props STRING")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_metrics_go_over_the_events_once_and_write_nothing(spark, tmp_path):
    sf = _fields_of_events(spark, tmp_path)
    once = sorted(map(str, catalog.QUERIES["run_metrics"](spark, sf).collect()))
    assert not [key for key in V._STORED if key[1] == sf]
    V.typed(spark, sf)
    assert [key[2] for key in V._STORED if key[1] == sf] == ["typed_runs"]
    assert once == sorted(map(str, catalog.QUERIES["run_metrics"](spark, sf).collect()))
    parsed = V.typed_rows(spark, sf).select("run_id", F.to_json("doc"), "data_json").orderBy("run_id")
    stored = R.typed_runs(V.runs(spark, sf)).select("run_id", F.to_json("doc"), "data_json").orderBy("run_id")
    assert parsed.collect() == stored.collect()


def test_category_puts_its_text_together_once(spark):
    metrics = R.run_metrics(R.typed_runs(history(spark, ("failed", None, "429 rate limit"), ("failed", None, ""))))
    assert [r.failure_category for r in metrics.orderBy("run_id").collect()] == ["rate_limit", ""]
    plan = metrics.select("failure_category")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws(") == 1
