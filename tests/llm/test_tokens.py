import base64
import gc
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from pagetide.llm import bpe, queries, token_counts, token_files
from pagetide.llm.common import scratch
from tests.llm.conftest import SF_DIR, odd_rows

POOL = [*"aaaabbbbbAB ééßçñ \n\t .,'#%中文字日本   ́\U0001f600\x1c\x85123٣", "<|endoftext|>", "'s", "'ll", "  ", "aaaaaaa", "===", "<|startoftext|>", "Σ", "İ.", "ing,"]


def odd_texts(n=400):
    rng = random.Random(11)
    return ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.fixture(scope="module")
def table(spark):
    """Odd texts and odd rows, ids ascending over the rows, none null."""
    texts = odd_texts(150) + [r[1] for r in odd_rows()]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), [t or "" for t in texts]


def test_bpe_equals_the_library(spark, table):
    docs, texts = table
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.rank_file().splitlines())}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(docs)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {k: own.encode_ordinary(t) for k, t in enumerate(texts)}
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(encoded).collect()} == dict(enumerate(texts))


def test_bpe_query_digests(spark, given):
    _, texts = given
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.rank_file().splitlines())}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.QUERIES["op5_bpe_round_trip"](spark, SF_DIR).collect():
        ids = np.array(own.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_counts_equal_the_library(spark, table):
    docs, texts = table
    want = [len(e.ids) for e in library(token_counts.MODEL).encode_batch(texts, add_special_tokens=False)]
    rows = {r["doc_id"]: r for r in token_counts.token_counts(docs).collect()}
    assert [rows[k]["n_tokens"] for k in range(len(texts))] == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) and r["n_bytes"] == len(texts[k].encode()) for k, r in rows.items())


def test_array_merging_of_odd_words():
    with open(public_tokenizers.path(token_counts.MODEL), encoding="utf-8") as f:
        merges = token_counts.Merges(f.read())
    words = [w for t in odd_texts() for w in regex.findall(public_tokenizers.PATTERN, t.replace("<|endoftext|>", ""))]
    want = [len(e.ids) for e in library(token_counts.MODEL).encode_batch(words, add_special_tokens=False)]
    assert merges.count([w.encode() for w in words]).tolist() == want


def test_chunks_encode_like_whole_texts():
    model = library(token_files.MODEL)
    for text in odd_texts():
        assert token_files._ids_of(text.encode().split(), model)[0].tolist() == model.encode(text, add_special_tokens=False).ids, text


def test_chunks_met_before_encode_alike(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_CHUNKS", 40)
    model = library(token_files.MODEL)
    known = token_files.Known(model)
    texts = odd_texts()
    for k in range(0, len(texts), 10):
        chunks = sorted({c for t in texts[k : k + 10] for c in t.encode().split()})
        ids, sizes = known(chunks)
        want, sizes_wanted = token_files._ids_of(chunks, model)
        assert ids.tolist() == want.tolist() and sizes.tolist() == sizes_wanted.tolist() and len(known._ids) <= 40
    assert [x.tolist() for x in known([])] == [[], []]


def test_files_hold_all_ids_in_order(spark, table):
    docs, texts = table
    path = scratch(spark, "test-ids")
    token_files.write(docs, path)
    want = [[*e.ids, 2] for e in library(token_files.MODEL).encode_batch(texts, add_special_tokens=False)]
    assert {r["doc_id"]: r["ids"] for r in token_files.read(spark, path).collect()} == dict(enumerate(want))
    rows = sorted(token_files.listing(spark, path).collect())
    sizes = np.array([len(ids) for ids in want])
    assert [r["start"] for r in rows] == (np.cumsum(sizes) - sizes).tolist()
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(np.array(ids, "<u4").tobytes()) for ids in want]


def test_filters_on_the_id_reach_the_orc_scan(spark, table):
    path = scratch(spark, "test-ids")
    token_files.write(table[0], path)
    plan = token_files.read(spark, path).filter("doc_id = 7")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan


def test_repeated_ids_spread_over_files_in_one_order(spark):
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(400)] + [(k, "x") for k in range(20)], "doc_id long, text string")
    path = scratch(spark, "test-ids")
    token_files.write(docs, path)
    assert token_files.read(spark, path).filter("doc_id = 7").select("part").distinct().count() > 1
    rows = token_files.listing(spark, path).collect()
    place = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in rows)
    assert [p[2] for p in place] == sorted(r["doc_id"] for r in rows)
    assert all(a[0] + a[1] == b[0] for a, b in zip(place, place[1:], strict=False))


def test_no_cycles_are_looked_for_while_token_files_are_encoded():
    class Sent:
        value = library(token_files.MODEL).to_str()

    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["One, two", None], "text_hash": [5, 6]})
    encode = token_files._encode(Sent, np.zeros(0, np.int64), token_files.END_ID)
    for batch in encode(iter([rows])):
        assert not gc.isenabled() and len(batch.column("ids")[1]) == 1
    assert gc.isenabled()
