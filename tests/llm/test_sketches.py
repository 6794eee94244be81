import hashlib
from collections import Counter

import numpy as np
import pytest

from pagetide.llm import sketches


def paragraphs(text):
    return Counter(p for p in map(str.strip, sketches._PARAGRAPH.findall(text or "")) if p)


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_edited_texts_fingerprints_and_likeness(given):
    docs, texts = given
    ids = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in sketches.compared_with_next(docs).collect()}
    assert set(rows) == set(ids)
    for k, i in enumerate(ids):
        text, following, row = texts[i], texts[ids[(k + 1) % len(ids)]], rows[i]
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert row["near_edited"] == pytest.approx(likeness(text, changed)) and row["near_next"] == pytest.approx(likeness(text, following))
    by_text = {}
    for i, row in rows.items():
        by_text.setdefault(texts[i], set()).add(row["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) == len({frozenset(paragraphs(t).items()) for t in texts.values()})


def test_order_of_null_and_repeated_ids(spark):
    rows = [(3, "A."), (1, "B."), (None, "C."), (2, "D. " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["edited_sha256"] for r in sketches.compared_with_next(docs).collect()}
    texts = dict(rows)
    for i, j in ((3, 2), (2, 1), (1, None), (None, 3)):
        assert found[i] == hashlib.sha256(sketches.edited(texts[i], texts[j]).encode()).hexdigest()


def test_large_differences_are_retried_until_all_is_recovered(spark):
    old, new = " ".join(f"Only old {k}." for k in range(900)), " ".join(f"Only new {k}." for k in range(700))
    shared = " Shared. Shared. Both."
    rows = sketches.version_differences(spark.createDataFrame([(1, old + shared, new + shared), (2, None, ""), (3, "x. y.", "x. y.")], "doc_id long, old string, new string"))
    rows = {r["doc_id"]: r for r in rows.collect()}
    removed, _ = sketches.digests([old])
    assert sorted(rows[1]["removed"]) == sorted(removed.view(np.int64).tolist()) and len(rows[1]["added"]) == 700
    assert rows[1]["likeness"] == pytest.approx(3 / 1603)
    assert rows[2]["likeness"] == 1 and rows[3]["likeness"] == 1 and not rows[3]["removed"]
