"""How filters interact: what each removes, spares and repeats in every order in which they can run.

A document is known by its mask, the set of filters that it fails. Orders are numbered by their Lehmer rank, so all
orders with the same first filters are one interval of ranks. A mask is removed at the first filter of the order that
it holds: for every beginning without another filter of the mask, the documents of the mask are added where the
beginning's interval starts and taken off where it ends. The running sum over the ranks gives what each step of each
order removes. The documents are read for their masks only; everything after that works on counts by part and mask.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetide.llm.common import stored

FILTERS = "ABCDE"
ORDERS = factorial(len(FILTERS))
_SPACE = r"[\x20\x09-\x0D]+"


def failures() -> dict[str, Column]:
    """Of the filters that look at the text alone, whether `text` fails; `words` are its words."""
    words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    return {
        "A": words < 100,
        "B": 100 * distinct.cast("long") < 80 * words.cast("long"),
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 10 * F.length("text").cast("long"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


def failed(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) for each row of docs (doc_id, text, lang): bit k of mask is set where filter k of FILTERS fails.

    Filter E fails for a text that a row with a smaller doc_id has too. Only digests of texts travel; the rows that hold
    the smallest id of their text are found by text and id together, so a text that many rows share is no hot key.
    Null texts are empty texts, a null lang is the part ''. A row without an id is not a copy and makes no copies.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    worded = read.withColumn("words", F.filter(F.split("text", _SPACE), lambda w: w != ""))
    bits = [F.when(fails, 1 << FILTERS.index(name)).otherwise(0) for name, fails in failures().items()]
    # Stored, so that the texts are read once.
    own = stored(worded.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits, F.lit(0)).alias("own")), "own-masks")
    firsts = own.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    mask = F.col("own") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    return own.join(firsts, ["digest", "doc_id"], "left").select("doc_id", "part", mask.alias("mask"))


def counted(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): rows of masks (doc_id, part, mask), and those that labels (doc_id, quality, toxic)
    has as good and as toxic. A document labelled several times is good or toxic if one of its labels says so; a row
    without an id has no label."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = masks.join(known, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(
        F.count("*").alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


def lehmer_rank(order: str) -> int:
    """Number of the order among all orders, sorted."""
    left, rank = list(FILTERS), 0
    for name in order:
        rank = rank * len(left) + left.index(name)
        left.remove(name)
    return rank


def intervals() -> list[tuple[int, int, int, int, bool]]:
    """(mask, step, first rank, rank after the last, first failure) for every mask and every beginning whose last filter
    the mask holds. The mask is removed there if that is the first of its filters, else the failure is redundant."""
    found = []
    for step in range(1, len(FILTERS) + 1):
        size = factorial(len(FILTERS) - step)
        for start in permutations(FILTERS, step):
            rest = "".join(f for f in FILTERS if f not in start)
            low = lehmer_rank("".join(start) + rest)
            for mask in range(1, 1 << len(FILTERS)):
                fails = [bool(mask >> FILTERS.index(f) & 1) for f in start]
                if fails[-1]:
                    found.append((mask, step, low, low + size, not any(fails[:-1])))
    return found


def _orders(spark: SparkSession) -> DataFrame:
    """(rank, filter_order, step, letter): the orders and their filters, a table of fixed size."""
    rows = [(lehmer_rank("".join(o)), "".join(o), k + 1, f) for o in permutations(FILTERS) for k, f in enumerate(o)]
    return spark.createDataFrame(rows, "rank int, filter_order string, step int, letter string")


def audit(counts: DataFrame) -> DataFrame:
    """Of counts (part, mask, docs, good, toxic) one row for each part, order and step.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley are numbers of documents of the part, zeros
    included. An empty table gives no rows. Intervals and orders are tables of fixed size, which joins may broadcast.
    """
    spark = counts.sparkSession
    spans = spark.createDataFrame(intervals(), "mask int, step int, low int, high int, removes boolean")
    held = counts.join(F.broadcast(spans), "mask")
    amounts = {
        "removed": F.when(F.col("removes"), F.col("docs")).otherwise(0), "redundant": F.when(F.col("removes"), 0).otherwise(F.col("docs")),
        "good_lost": F.when(F.col("removes"), F.col("good")).otherwise(0), "toxic_lost": F.when(F.col("removes"), F.col("toxic")).otherwise(0),
    }
    ends = F.explode(F.array(F.struct(F.col("low").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("high").alias("rank"), F.lit(-1).alias("sign"))))
    changes = held.select("part", "step", ends.alias("end"), *(a.cast("long").alias(name) for name, a in amounts.items()))
    changes = changes.select("part", "step", "end.rank", *((F.col(name) * F.col("end.sign")).alias(name) for name in amounts))
    alone = [F.sum(F.when(F.col("mask") == 1 << k, F.col("docs")).otherwise(0)).alias(f"alone_{name}") for k, name in enumerate(FILTERS)]
    parts = counts.groupBy("part").agg(F.sum("docs").alias("total"), *alone)
    places = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("rank"))
    places = places.select("part", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"), "rank", *(F.lit(0).cast("long").alias(name) for name in amounts))
    ranked = changes.unionByName(places).filter(F.col("rank") < ORDERS).groupBy("part", "step", "rank").agg(*(F.sum(name).alias(name) for name in amounts))
    # No window sees more rows than there are orders, steps and places of a filter: 120, 5 and 120.
    upto = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranked.select("part", "step", "rank", *(F.sum(name).over(upto).alias(name) for name in amounts))
    named = summed.join(F.broadcast(_orders(spark)), ["rank", "step"]).join(parts, "part")
    gone = F.sum("removed").over(Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    unique = F.coalesce(*(F.when(F.col("letter") == name, F.col(f"alone_{name}")) for name in FILTERS))
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return named.select(
        "part", "filter_order", "step", (F.col("total") - gone).alias("kept"), "removed", "redundant", unique.alias("unique_fails"),
        "good_lost", "toxic_lost", shapley.alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of docs (doc_id, text, lang) with labels (doc_id, quality, toxic); see failed, counted and audit."""
    return audit(stored(counted(failed(docs), labels), "mask-counts"))


SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
firsts AS (SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text),
failed AS (
    SELECT w.doc_id, w.part,
        len(w.words) < 100 AS a,
        100 * len(list_distinct(w.words)) < 80 * len(w.words) AS b,
        100 * len(regexp_extract_all(w.text, '[A-Z]')) > 10 * length(w.text) AS c,
        regexp_matches(w.text, '[#$%&*|]') AS d,
        coalesce(f.first_id < w.doc_id, false) AS e
    FROM worded w JOIN firsts f ON f.text = w.text),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
marked AS (
    SELECT f.part,
        CASE WHEN a THEN ['A'] ELSE [] END || CASE WHEN b THEN ['B'] ELSE [] END || CASE WHEN c THEN ['C'] ELSE [] END
            || CASE WHEN d THEN ['D'] ELSE [] END || CASE WHEN e THEN ['E'] ELSE [] END AS failing,
        count(*) AS docs, count(*) FILTER (coalesce(good, false)) AS good, count(*) FILTER (coalesce(toxic, false)) AS toxic
    FROM failed f LEFT JOIN known k ON k.doc_id = f.doc_id GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT [p.x, q.x, r.x, s.x, t.x] AS letters FROM letters p, letters q, letters r, letters s, letters t
    WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT letters, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
rows AS (
    SELECT m.part, array_to_string(s.letters, '') AS filter_order, s.step, s.letters[s.step] AS letter,
        m.docs, m.good, m.toxic, list_contains(m.failing, s.letters[s.step]) AS fails_here,
        list_has_any(s.letters[1:s.step - 1], m.failing) AS fails_before, len(m.failing) = 1 AS fails_once
    FROM marked m, steps s),
summed AS (
    SELECT part, filter_order, step, letter,
        sum(CASE WHEN NOT fails_here AND NOT fails_before THEN docs ELSE 0 END) AS kept,
        sum(CASE WHEN fails_here AND NOT fails_before THEN docs ELSE 0 END) AS removed,
        sum(CASE WHEN fails_here AND fails_before THEN docs ELSE 0 END) AS redundant,
        sum(CASE WHEN fails_here AND fails_once THEN docs ELSE 0 END) AS unique_fails,
        sum(CASE WHEN fails_here AND NOT fails_before THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN fails_here AND NOT fails_before THEN toxic ELSE 0 END) AS toxic_lost
    FROM rows GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM summed
"""
