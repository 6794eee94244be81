"""Queries without SQL, against row-by-row rules on whole small tables."""

import re

from pyspark.sql import functions as F

from pagetide.operators import extract as X
from pagetide.operators import pages as P
from pagetide.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


def test_label_join_equals_row_rule(spark):
    texts = [
        "Price: $5\nprice：$6\nTitle : A b\n作者： 王\nbrand: cookie\nBrand: Acme", "no labels here", "updated: 1\nDate: 2\nPublished: 3", "a:b:c\nStatus: x: y",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "page_id LONG, text STRING")
    got = {(r.page_id, r.field): r.value for r in X.label_values(P.page_lines(rows, "text")).collect()}
    want = {}
    for page, text in enumerate(texts):
        for field, aliases in X.FIELD_ALIASES.items():
            for line in text.split("\n"):
                hit = re.match(r"^([^:：]+?)\s*[:：]\s*(.+)$", line)
                if not hit or hit[1].strip().lower() not in aliases or re.search(X.NOISE_VALUE, hit[2].lower()):
                    continue
                want.setdefault((page, field), hit[2].strip())
    assert got == want


def test_every_document_is_settled(spark):
    rows = catalog.QUERIES["document_extraction"](spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert {r.strategy for r in rows} <= {"specialized_rule", "rule_precheck", "fallback"}


def test_fallback_text_equals_row_rule(spark):
    noise = re.compile("|".join(X.FALLBACK_NOISE))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").withColumn("got", X.fallback_text())
    for r in docs.collect():
        kept = [s for s in (line.strip(" ") for line in r.text.split("\n")) if len(s) >= 10 and not noise.search(s)]
        assert r.got == ("\n\n".join(kept) or r.text)


def test_capped_pages_are_cut_by_the_rule(spark):
    rows = catalog.QUERIES["page_clean_text_capped"](spark, SF_DIR)
    assert rows.where(F.length("clean_text") > 2000 + 30).count() == 0
    whole = P.with_clean_text(P.parse_pages(spark.read.parquet(f"{SF_DIR}/pages.parquet"))).select("page_id", F.col("clean_text").alias("whole"))
    short = rows.join(whole, "page_id").where(F.length("whole") <= 2000)
    assert short.where(F.col("whole") != F.col("clean_text")).count() == 0
