"""The collection data source, CSV collections of many appends, and feeds read by tag."""

import pytest
from pyspark.sql import functions as F

from pagetide.sources import collection, readers, sinks


@pytest.fixture(scope="module")
def name(spark):
    return collection.register(spark)


def test_failed_job_leaves_no_rows(spark, name, tmp_path):
    folder = str(tmp_path / "c")
    rows = spark.range(100, numPartitions=4).select("id", F.col("id").cast("string").alias("text"))
    rows.write.format(name).mode("append").option("path", folder).save()
    broken = rows.select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"), "text")
    with pytest.raises(Exception, match="broken"):
        broken.write.format(name).mode("append").option("path", folder).save()
    back = spark.read.format(name).option("path", folder).load()
    assert sorted(back.collect()) == sorted(rows.collect()) and collection.row_count(folder) == 100


def test_overwrite_replaces_and_empty_collections_have_no_rows(spark, name, tmp_path):
    folder = str(tmp_path / "c")
    write = lambda df, mode: df.write.format(name).mode(mode).option("path", folder).save()
    write(spark.range(10), "append")
    write(spark.range(5), "overwrite")
    write(spark.range(0), "append")
    assert spark.read.format(name).option("path", folder).load().count() == 5 == collection.row_count(folder)
    write(spark.range(0), "overwrite")
    assert spark.read.format(name).option("path", folder).load().collect() == [] and collection.row_count(str(tmp_path / "none")) == 0


def test_columns_grow_and_a_given_schema_reads_only_its_columns(spark, name, tmp_path):
    folder = str(tmp_path / "c")
    rows = spark.range(3).select("id", F.array(F.lit("a"), F.lit(None)).alias("tags"), F.create_map(F.lit("k"), "id").alias("facts"))
    for part in (rows.drop("facts"), rows.drop("tags")):
        part.write.format(name).mode("append").option("path", folder).save()
    back = spark.read.format(name).option("path", folder).load()
    assert back.columns == ["id", "tags", "facts"] and back.where("tags IS NULL").select("facts").first()[0] == {"k": 0}
    assert spark.read.format(name).option("path", folder).schema("facts map<string,long>").load().columns == ["facts"]


def test_filters_leave_out_parts(spark, name, tmp_path):
    folder = str(tmp_path / "c")
    spark.range(1000, numPartitions=10).write.format(name).mode("append").option("path", folder).save()
    back = spark.read.format(name).option("path", folder).load()
    assert back.where("id >= 950").rdd.getNumPartitions() == 1 and back.where("id >= 950").count() == 50
    assert back.where("id < 100").rdd.getNumPartitions() == 1 and back.where("id = 500").collect() == [(500,)]
    assert back.where("id > 99 AND id <= 100").collect() == [(100,)] and back.where("id > 5000").collect() == []
    odd = str(tmp_path / "odd")
    spark.sql("SELECT * FROM VALUES (1D, 'a'), (double('NaN'), NULL) t(x, y)").coalesce(1).write.format(name).mode("append").option("path", odd).save()
    back = spark.read.format(name).option("path", odd).load()
    assert back.where("x > 5").count() == 1 and back.where("y >= 'a'").count() == 1 and back.where("y > 'a'").count() == 0


def test_appends_with_one_header_are_one_scan(spark, tmp_path):
    folder = str(tmp_path / "csv")
    for k in range(12):
        row = spark.createDataFrame([(k, 'a "quoted"\nline, and more')], "id int, name string")
        sinks.append_csv(row if k % 2 else row.withColumn("color", F.lit("red")), folder)
    back = sinks.read_csv_folder(spark, folder)
    assert sorted((int(r["id"]), r["name"], r["color"]) for r in back.collect()) == [(k, 'a "quoted"\nline, and more', "" if k % 2 else "red") for k in range(12)]
    assert back._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2


def test_one_feed_is_read_by_several_tasks(spark, tmp_path):
    filler = "words " * 50
    items = "".join(f"<item><title>T{k}</title><description>{filler}</description><link>https://h/{k}</link></item>\n" for k in range(3000))
    (tmp_path / "feed.xml").write_text(f"<rss><channel><title>feed</title>\n{items}</channel></rss>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        rows = readers.read_feed_items(spark, str(tmp_path / "feed.xml"))
        found = rows.withColumn("task", F.spark_partition_id()).orderBy("position").select("title", "task").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["title"] for r in found] == [f"T{k}" for k in range(3000)] and len({r["task"] for r in found}) > 2
    assert readers.read_feed_items(spark, str(tmp_path / "feed.xml")).where("title = 'feed'").count() == 0


def test_several_links_and_missing_fields(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<feed><entry><title type="html">A</title><link href="https://h/1"/><link href="https://h/2"/></entry><entry></entry><entry><title>B&nbsp;&amp; C</title></entry></feed>')
    rows = readers.read_feed_items(spark, str(tmp_path), tag="entry").orderBy("position").select("title", "published", "summary", "link").collect()
    assert [tuple(r) for r in rows] == [("A", "", "", "https://h/1"), ("", "", "", ""), ("B&nbsp;& C", "", "", "")]
    (tmp_path / "map.xml").write_text("<urlset><url><loc> https://h/a </loc></url><url><loc/></url><url><loc>https://h/b?x=1&amp;y</loc></url></urlset>")
    locs = readers.read_sitemap_urls(spark, str(tmp_path / "map.xml")).orderBy("position").collect()
    assert [r["loc"] for r in locs] == ["https://h/a", "https://h/b?x=1&y"]
