"""What the operators of this subpackage share: stored stages, prefix sums over an order, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting, as in tests, gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pagetide-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n if isinstance(col, str) else F.crc32(col.cast("string").cast("binary")) % n


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def releasing(run: Batches) -> Batches:
    """A function of batches that hands its task's memory back when it is through. Workers are used again by later
    stages, and what earlier ones freed but kept would be added to those."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def dealt_in_order(df: DataFrame, order: Sequence[Column], name: str, part: str) -> DataFrame:
    """df sorted over all partitions, stored, with each row's partition number in the column `part`."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id())
    return stored(dealt, name)


def components(edges: DataFrame, salts: int = 16) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps until the edges stay as they are; each step is stored, so
    a lost executor costs one step. A node with very many edges is dealt out by a salt of the other end.
    Nodes without an edge to another node are not returned; null ends are dropped.
    """

    def minima(sides: DataFrame) -> DataFrame:
        low = sides.groupBy("u").agg(F.min("v").alias("low"))
        return low.select("u", F.least("u", "low").alias("low"), F.explode(F.array([F.lit(k) for k in range(salts)])).alias("salt"))

    def with_minimum(sides: DataFrame) -> DataFrame:
        salted = sides.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
        return salted.join(minima(sides), ["u", "salt"])

    def large(e: DataFrame) -> DataFrame:
        sides = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        return with_minimum(sides).filter("v > u").select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        moved = with_minimum(down).select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("low").alias("b")), F.struct(F.col("v").alias("a"), F.col("low").alias("b")))).alias("e"))
        return moved.select("e.a", "e.b").filter("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before, state = None, mark(now)
    while state != before:
        now = stored(small(stored(large(now), "large")), "small")
        before, state = state, mark(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()


def one_row_per_root(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of docs, one row for each root in rows (doc_id, text_hash, root): the one with the smallest doc_id, null last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    chosen = rows.groupBy("root").agg(first).select(F.col("first.doc_id").alias("__sim_id"), F.col("first.text_hash").alias("__sim_hash"))
    equal = rows.groupBy(F.col("doc_id").alias("__row_id"), F.col("text_hash").alias("__row_hash")).agg(F.count("*").alias("__sim_rows"))
    own = F.col("__sim_id").eqNullSafe(F.col("__row_id")) & (F.col("__sim_hash") == F.col("__row_hash"))
    kept = stored(chosen.join(equal, own).select("__sim_id", "__sim_hash", "__sim_rows"), "kept")
    marked = docs.withColumns({"__sim_doc": F.col("doc_id").cast("long"), "__sim_text": F.xxhash64("text")})
    same = F.col("__sim_doc").eqNullSafe(F.col("__sim_id")) & (F.col("__sim_text") == F.col("__sim_hash"))
    # Whole rows are sorted and reduced only where a row is there several times.
    once = marked.join(kept.filter("__sim_rows = 1"), same, "left_semi")
    several = marked.join(kept.filter("__sim_rows > 1"), same, "left_semi").dropDuplicates(["__sim_doc", "__sim_text"])
    return once.union(several).drop("__sim_doc", "__sim_text")
