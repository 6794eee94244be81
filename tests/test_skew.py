"""Ordered lookups on a key that holds most rows, cut into many spans, against plain windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagetide.operators.ordered import position_in_key, previous_where, top_per_key, with_span


def _rows(spark):
    key = F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    return spark.range(2000).select("id", key.alias("key"), (F.hash("id") % 5 == 0).alias("ok"))


def test_previous_where_equals_one_window(spark):
    rows = _rows(spark)
    w = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumn("prev", F.last(F.when(F.col("ok"), F.col("id")), ignorenulls=True).over(w))
    got = previous_where(rows, ["key"], "id", F.col("ok"), "id", "prev", span=37)
    assert sorted(map(tuple, got.select("id", "prev").collect())) == sorted(map(tuple, want.select("id", "prev").collect()))


def test_previous_without_condition_equals_lag(spark):
    rows = _rows(spark)
    want = rows.withColumn("prev", F.lag("id").over(Window.partitionBy("key").orderBy("id")))
    got = previous_where(rows, ["key"], "id", None, "id", "prev", span=37)
    assert sorted(map(tuple, got.select("id", "prev").collect())) == sorted(map(tuple, want.select("id", "prev").collect()))


def test_position_in_key_equals_row_number(spark):
    rows = _rows(spark)
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id")))
    got = position_in_key(rows, ["key"], "id", "n", span=37)
    assert sorted(map(tuple, got.select("id", "n").collect())) == sorted(map(tuple, want.select("id", "n").collect()))


def test_hot_key_is_cut_before_the_shuffle(spark):
    plan = top_per_key(_rows(spark), ["key"], [F.desc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert plan.count("WindowGroupLimit") == 2  # once before and once after the exchange


def test_window_rows_are_partitioned_by_span(spark):
    plan = previous_where(_rows(spark), ["key"], "id", F.col("ok"), "id", "prev", span=100)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in text and "_span" in text


def test_sparse_ids_are_cut_into_even_spans(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("id"), F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("key"))
    sizes = [r["count"] for r in with_span(rows, "id", 300).groupBy("_span").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 400
    w = Window.partitionBy("key").orderBy("id")
    want = rows.withColumn("prev", F.lag("id").over(w)).withColumn("n", F.row_number().over(w))
    got = position_in_key(previous_where(rows, ["key"], "id", None, "id", "prev", span=300), ["key"], "id", "n", span=300)
    assert sorted(map(str, got.select("id", "prev", "n").collect())) == sorted(map(str, want.select("id", "prev", "n").collect()))
