"""Mixing sources to target weights: hash-random order, prefix sums of sizes, an exact cut for each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.llm.common import WORD, stored

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
# Leading hexadecimal digits of a key that name its piece of the key range: 4096 pieces of equal width for each source.
PIECE_DIGITS = 3


def words_in(text: Column) -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    """32 hexadecimal digits, uniform over the ids and the same in every run."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def _weighted(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """The weights in turn over the sources in code-point order, null last.

    The rank of a source is the number of sources in smaller range partitions plus its place in its own.
    """
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    dealt = stored(sources.repartitionByRange(n, order).withColumn("part", F.spark_partition_id()), "sources")
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(order))
    ranked = dealt.join(F.broadcast(before.select("part", "before")), "part").withColumn("rank", F.col("before") + place - 1)
    weight = F.element_at(F.array([F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    return stored(ranked.select("source", "source_size", weight.alias("weight")), "weighted")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Each source's target: its share by weight, at most `most` times its size, the excess reshared.

    One aggregate a round finds the level (target per unit of weight) of the sources still below their limit;
    rounds end when no further source is above. The driver sees four numbers a round.
    """
    table = _weighted(sources, weights)
    limit = F.col("source_size") * most
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, shut = 0.0, -1
    while True:
        over = limit < F.lit(level) * F.col("weight")
        n, taken, left = table.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == shut or not left:
            break
        shut, level = n, (total - taken) / left
    share = F.lit(float(total - taken)) * F.col("weight") / F.lit(left or 1.0)
    return table.withColumn("target", F.when(over, limit.cast("double")).otherwise(F.least(share, limit.cast("double"))))


def source_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix") -> DataFrame:
    """One row per source: source_size, target, epochs (whole repeats of all its documents) and the cut of the last epoch.

    The cut is the document (cut_key, cut_id, cut_size) at which the prefix sum of sizes, in the order of the keys, meets
    the rest of the budget; that document gives cut_words words (each of its identical rows as many), those before it all
    of theirs. Prefix sums are made over pieces of the key range first and over rows only inside the piece with the cut.
    """
    sized = docs.select(
        F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), words_in(F.col("text")).alias("size"),
        random_key(F.col("doc_id"), seed).alias("key"),
    )
    # Rows alike in everything that orders them are one row with a count: no single key can fill a piece.
    sized = stored(sized.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("n")), "sized")
    sized = sized.withColumn("piece", F.conv(F.substring("key", 1, PIECE_DIGITS), 16, 10).cast("int")).withColumn("words", F.col("size") * F.col("n"))
    pieces = stored(sized.groupBy("source", "piece").agg(F.sum("words").alias("words")), "pieces")
    plan = stored(targets(pieces.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most), "targets")
    whole = F.floor("target").cast("long")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", whole - F.col("epochs") * F.col("source_size"))
    by_piece = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = pieces.withColumn("upto", F.sum("words").over(by_piece))
    at = plan.alias("p").join(summed.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
    at = at.filter("rest > upto - words AND rest <= upto").select("p.source", "piece", (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))
    inside = sized.alias("r").join(at.alias("a"), F.col("r.source").eqNullSafe(F.col("a.source")) & (F.col("r.piece") == F.col("a.piece")))
    inside = inside.select("r.source", "key", "doc_id", "size", "n", "words", "left")
    by_row = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = inside.withColumn("upto", F.sum("words").over(by_row)).filter("left > upto - words AND left <= upto")
    cut = cut.select("source", F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.col("size").alias("cut_size"), F.floor((F.col("left") - F.col("upto") + F.col("words")) / F.col("n")).alias("cut_words"))
    both = plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
    return stored(both.select("p.source", "source_size", "target", "epochs", "cut_key", "cut_id", "cut_size", "cut_words"), "plan")


def _last_epoch(key: Column, doc_id: Column, size: Column) -> Column:
    """Words that the last, partial epoch takes of a document; no cut: none."""
    mine = F.struct(key.alias("k"), doc_id.alias("d"), size.alias("s"))
    cut = F.struct(F.col("cut_key").alias("k"), F.col("cut_id").alias("d"), F.col("cut_size").alias("s"))
    return F.when(F.col("cut_key").isNull() | (mine > cut), F.lit(0)).when(mine < cut, size).otherwise(F.col("cut_words")).cast("long")


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of docs (doc_id, text, source).

    Sizes are words; null and empty texts have size 0 and take 0. The null source is the last. taken counts
    repeats, sums to the whole words of the target in each source (short of it by fewer words than the cut document
    has identical rows), and is at most three times the size. Ties of the key fall back on doc_id and size.
    An empty table gives no rows; other columns are not looked at.
    """
    plan = source_plan(docs, seed=seed)
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"))
    key = random_key(F.col("doc_id"), seed)
    # The plan has a row per source; Catalyst broadcasts it when its files are small and splits a hot source otherwise.
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    taken = F.col("epochs") * F.col("size") + _last_epoch(key, F.col("doc_id").cast("long"), F.col("size"))
    return joined.select("doc_id", F.col("r.source").alias("source"), "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents of the mix, whole texts: a document stands in it once for each epoch that takes it.

    The one document of a source at the cut is taken whole when the budget has room for at least half of it.
    Same columns as docs, whatever their names; texts without a word follow their key like the others.
    """
    plan = source_plan(docs, seed=seed)
    plan = plan.select(*[F.col(c).alias(f"__mix_{c}") for c in plan.columns])
    size, key = words_in(F.col("text")), random_key(F.col("doc_id"), seed)
    mine = F.struct(key.alias("k"), F.col("doc_id").cast("long").alias("d"), size.alias("s"))
    cut = F.struct(F.col("__mix_cut_key").alias("k"), F.col("__mix_cut_id").alias("d"), F.col("__mix_cut_size").alias("s"))
    last = F.when(F.col("__mix_cut_key").isNull() | (mine > cut), 0).when(mine < cut, 1).otherwise((F.col("__mix_cut_words") * 2 >= size).cast("int"))
    joined = docs.join(plan, docs["source"].cast("string").eqNullSafe(plan["__mix_source"]))
    copies = joined.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), (F.col("__mix_epochs") + last).cast("int"))))
    return copies.select(*[docs[c] for c in docs.columns])


SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents
), g AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM g),
l AS (
  SELECT *, (SELECT SUM(source_size) FROM g) AS total, CAST(3 * source_size AS DOUBLE) / weight AS ratio,
    COALESCE(SUM(3 * source_size) OVER o, 0) AS shut_size, COALESCE(SUM(weight) OVER o, 0) AS shut_weight
  FROM w WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT total - shut_size AS free, (SELECT SUM(weight) FROM w) - shut_weight AS free_weight FROM l
  WHERE ratio >= (total - shut_size) / ((SELECT SUM(weight) FROM w) - shut_weight) ORDER BY shut_weight LIMIT 1
), t AS (
  SELECT source, source_size, LEAST(CAST(3 * source_size AS DOUBLE), CAST(free AS DOUBLE) * weight / free_weight) AS target FROM w, v
), p AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
r AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.epochs, CAST(floor(p.target) AS BIGINT) - p.epochs * p.source_size AS rest,
    SUM(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before
  FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source, size, source_size, target, CAST(epochs * size + GREATEST(0, LEAST(size, rest - before)) AS BIGINT) AS taken FROM r
"""
