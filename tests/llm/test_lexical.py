import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pagetide.llm import lexical, queries
from tests.llm.conftest import SF_DIR, odd_rows
from tests.oracle import compare, connect

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, best=10):
    """All documents scored for all items."""
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, words = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    found = []
    for item, counts in asked.items():
        scores = []
        for i, c, n in docs:
            m = 100 - 75 + (75 * n * n_docs) // words
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in counts.items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        found += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:best], 1)]
    return sorted(found, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


def test_query_equals_sql(spark):
    assert compare(queries.QUERIES["op11_lexical_search"](spark, SF_DIR), connect(SF_DIR), queries.ORACLE["op11_lexical_search"]) == ""


def test_query_equals_brute_force(spark, given):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(queries.QUERIES["op11_lexical_search"](spark, SF_DIR)) == plain_search(given[1].items(), items)


def test_odd_rows_and_repeated_items(spark, odd):
    items = [(1, "one two THREE"), (1, "four"), (2, None), (None, "the of a"), (3, "--"), (4, "é\U0001f600 Σ 中文"), (5, "x" * 50_000), (6, "the " * 9)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert got(lexical.best_documents(odd, asked)) == plain_search([r[:2] for r in odd_rows()], items)


def test_rounds_and_small_buckets_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    names = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    docs = [(k, " ".join(rng.choices(names, k=rng.randint(0, 80)))) for k in range(1500)]
    items = [(k, " ".join(rng.choices(names, k=rng.randint(1, 12)))) for k in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    asked = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "ROUND_BYTES", 1000)
    assert got(lexical.best_documents(table, asked)) == plain_search(docs, items)


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_buckets_prune_without_loss(size):
    rng = np.random.default_rng(size)
    vocabulary, n = 40, 1000
    vectors = []
    for doc in range(n):
        own = np.sort(rng.choice(vocabulary, rng.integers(1, 12), replace=False))
        vectors.append((doc, own, rng.integers(1, 50, len(own)) * (1 + (own % 7 == 0) * 40)))
    vectors.sort(key=lambda v: -float((v[2] ** 2).sum()))
    items = [(np.sort(rng.choice(vocabulary, 5, replace=False)), rng.integers(1, 4, 5)) for _ in range(30)]
    search = lexical.Search(items, np.zeros(len(items), np.int64), 10)
    for at in range(0, n, size):
        part = vectors[at : at + size]
        lengths = np.array([math.sqrt(float((v[2] ** 2).sum())) for v in part])
        search.bucket(np.array([v[0] for v in part]), lengths, np.concatenate([v[1] for v in part]), np.concatenate([v[2] for v in part]), np.array([len(v[1]) for v in part]), vocabulary)
    for (own, counts), (ids, scores) in zip(items, search.found, strict=True):
        asked = dict(zip(own.tolist(), counts.tolist(), strict=True))
        want = sorted((-sum(asked.get(t, 0) * g for t, g in zip(v[1].tolist(), v[2].tolist(), strict=True)), v[0]) for v in vectors)[:10]
        assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)] == want
    if size <= 64:
        assert search.scored < n * len(items) / 2
