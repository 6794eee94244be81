import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given as given_texts
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagetide.llm import forced_cuts, queries
from tests.llm.conftest import SF_DIR, odd_rows
from tests.llm.test_tokens import odd_texts

POOL = [*"aZ09'’ \t\n\r\x0b\x0c\x1c\x1f\x00\x7f~@_-.", " ", " ", "　", "\u0085", "é", "ß", "中", "文", "́", "\U0001f600", "٣", "'s", "'ll", "'ve", "'re", "  ", "qz", "~'s", "<|endoftext|>", "<|endof", "text|>", "QX", "vq"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(forced_cuts.MODEL))


@pytest.fixture(scope="module")
def cutter():
    with open(public_tokenizers.path(forced_cuts.MODEL), encoding="utf-8") as f:
        return forced_cuts.Cutter(f.read())


def encoded(cutter, text):
    fragments, numbers, _, special = forced_cuts._numbered(cutter, [text])
    lists = [np.frombuffer(ids, "<u4").tolist() for ids in cutter.encode(fragments)]
    return [i for n, s in zip(numbers.tolist(), special.tolist(), strict=True) for i in ([s] if s >= 0 else lists[n])]


def test_certain_pairs_stand_in_no_token(cutter):
    for token in cutter.bytes[:-1]:
        assert not any(cutter.certain[a, b] for a, b in zip(token, token[1:], strict=False)), token
    assert cutter.certain.any() and (cutter.outer <= cutter.certain).all()
    assert cutter.outer[ord("e"), ord(" ")] and cutter.outer[ord("."), ord(" ")]


def test_fragments_encode_like_whole_texts(cutter, library):
    rng = random.Random(3)
    for _ in range(6000):
        text = "".join(rng.choice(POOL) for _ in range(rng.randint(0, 12)))
        assert encoded(cutter, text) == library.encode(text, add_special_tokens=False).ids, repr(text)
    for text in odd_texts():
        assert encoded(cutter, text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_any_text(cutter, library):
    @settings(max_examples=500, deadline=None)
    @given_texts(st.text(max_size=40))
    def check(text):
        assert encoded(cutter, text) == library.encode(text, add_special_tokens=False).ids

    check()


def test_query_digests(spark, given, library):
    _, texts = given
    for r in queries.QUERIES["op13_forced_cuts"](spark, SF_DIR).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_and_decode_tables(spark, library, monkeypatch):
    texts = odd_texts(150) + [r[1] for r in odd_rows()] + ["<|endoftext|>", "a<|endoftext|><|endoftext|>b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = forced_cuts.encode(docs)
    want = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    assert {r["doc_id"]: r["ids"] for r in out.collect()} == want
    assert {r["doc_id"]: r["text"] for r in forced_cuts.decode(out).collect()} == {k: t or "" for k, t in enumerate(texts)}
    parts = spark.createDataFrame([(1, [220, 39752]), (2, None), (3, want[0][:1]), (4, [50256])], "doc_id long, ids array<int>")
    for r in forced_cuts.decode(parts).collect():
        assert r["text"] == library.decode(r["ids"] or [], skip_special_tokens=False)
