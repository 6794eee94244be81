import re

import pytest

from pagetide.llm import mixing, queries
from tests.llm.conftest import SF_DIR
from tests.oracle import compare, connect


def test_query_equals_sql(spark):
    assert compare(queries.QUERIES["op1_mix_sources"](spark, SF_DIR), connect(SF_DIR), queries.ORACLE["op1_mix_sources"]) == ""


def test_sizes_targets_and_cuts(spark, odd):
    rows = mixing.mixed(odd).collect()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["source"], []).append(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")))
    assert {r["source"]: r["source_size"] for r in rows} == {s: sum(n) for s, n in texts.items()}
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(sum(map(sum, texts.values())))
    for source in texts:
        own = [r for r in rows if r["source"] == source]
        assert all(r["target"] <= 3 * r["source_size"] and r["taken"] <= 3 * r["size"] for r in own)
        assert 0 <= own[0]["target"] - sum(r["taken"] for r in own) < 3


def test_small_sources_stop_at_three_epochs_and_the_rest_is_reshared(spark):
    docs = spark.createDataFrame([(k, "w " * 100, "big") for k in range(20)] + [(100, "w " * 10, "small"), (101, "w", None)], "doc_id long, text string, source string")
    target = {r["source"]: r["target"] for r in mixing.mixed(docs).collect()}
    assert target["small"] == 30 and target[None] == 3
    assert target["big"] == 2011 - 33


def test_mixed_documents_follow_the_plan(spark, given):
    docs, _ = given
    plan = {r["doc_id"]: r for r in mixing.mixed(docs).collect()}
    copies = {r["doc_id"]: r["count"] for r in mixing.mixed_documents(docs).groupBy("doc_id").count().collect()}
    for doc_id, r in plan.items():
        assert abs(copies.get(doc_id, 0) * r["size"] - r["taken"]) <= r["size"] / 2
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_reruns_agree(spark, given):
    first, second = (sorted(map(tuple, mixing.mixed(given[0].repartition(n)).collect())) for n in (2, 5))
    assert first == second
