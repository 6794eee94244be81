import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagetide.llm import filter_audit, queries
from tests.llm.conftest import SF_DIR
from tests.oracle import compare, connect


def test_query_equals_sql(spark):
    assert compare(queries.QUERIES["op12_filter_audit"](spark, SF_DIR), connect(SF_DIR), queries.ORACLE["op12_filter_audit"]) == ""


def plain_masks(rows):
    """Failing filters of (doc_id, text) rows, by plain rules."""
    texts = [(i, t or "") for i, t in rows]
    for doc_id, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        yield {
            name
            for name, fails in {
                "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and any(t == text and i is not None and i < doc_id for i, t in texts),
            }.items()
            if fails
        }


def plain_audit(rows, labels):
    """Every order run over every document, one after the other."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    found = {}
    masks = list(plain_masks([(r["doc_id"], r["text"]) for r in rows]))
    parts = {r["lang"] or "" for r in rows}
    shapley = Counter()
    for order in itertools.permutations("ABCDE"):
        for part in parts:
            left = [(r["doc_id"], m) for r, m in zip(rows, masks, strict=True) if (r["lang"] or "") == part]
            whole = list(left)
            for step, name in enumerate(order, 1):
                removed = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                shapley[part, name] += len(removed)
                found[part, "".join(order), step] = (
                    len(left), len(removed), sum(name in m for _, m in whole) - len(removed), sum(m == {name} for _, m in whole),
                    sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed),
                )
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def result(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in df.collect()}


def test_odd_rows_equal_plain_runs_of_all_orders(odd, labels):
    rows = odd.collect()
    assert result(filter_audit.audited(odd, labels)) == plain_audit(rows, [tuple(r) for r in labels.collect()])


def test_whole_table_equals_plain_runs(spark, given):
    docs = given[0].filter("doc_id < 120")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality", "toxic")
    assert result(filter_audit.audited(docs, labels)) == plain_audit(docs.collect(), [tuple(r) for r in labels.collect()])


@pytest.mark.parametrize("order", ["ABCDE", "EDCBA", "BADCE"])
def test_ranks_are_places_among_sorted_orders(order):
    assert ["".join(o) for o in itertools.permutations("ABCDE")].index(order) == filter_audit.lehmer_rank(order)


def test_copies_of_one_text_do_not_meet_in_one_task(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"))
    masks = filter_audit.failed(rows)
    assert masks.groupBy("mask").count().orderBy("mask").collect()[0]["count"] == 1
    sizes = masks.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 or masks.rdd.getNumPartitions() == 1
