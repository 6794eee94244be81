import random

import numpy as np
import pytest
import xxhash

from pagetide.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, codes):
    left, found = set(range(len(codes))), {}
    while left:
        stack, own = [left.pop()], []
        while stack:
            k = stack.pop()
            own.append(k)
            near = {j for j in left if (codes[k] ^ codes[j]).bit_count() <= 4}
            left -= near
            stack += near
        for k in own:
            found[ids[k]] = min(ids[j] for j in own)
    return found


@pytest.mark.parametrize("text", [None, "", " ", "A", "a b c", "Ä b C d e", "x\x0by\rz w v", "one two three four five six " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("subtree", [simhash.SUBTREE_CODES, 8])
def test_components_equal_all_pairs(spark, given, subtree):
    docs, texts = given
    rows = simhash.linked(docs, subtree).collect()
    ids = list(texts)
    codes = [plain_fingerprint(texts[i]) for i in ids]
    assert {r["doc_id"]: r["code"] % (1 << 64) for r in rows} == dict(zip(ids, codes, strict=True))
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_components(ids, codes)


@pytest.mark.parametrize("subtree", [16, 64])
def test_a_crowded_neighbourhood_is_cut_deeper_and_loses_no_link(spark, subtree):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    codes = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(250)} | {rng.getrandbits(64) for _ in range(50)}
    codes = sorted(codes)
    table = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long")
    got = {r["node"] % (1 << 64): r["root"] for r in simhash.code_components(table, subtree).collect()}
    want = plain_components(codes, codes)
    for a in codes:
        assert (a in got) == (sum(v == want[a] for v in want.values()) > 1)
    roots = {}
    for node, root in got.items():
        roots.setdefault(root, set()).add(want[node])
    assert all(len(v) == 1 for v in roots.values()) and len(roots) == len({want[a] for a in got})


def test_walk_over_two_sides():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    flips = np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (80, 3), dtype=np.uint64), axis=1)
    left, right = np.unique(base ^ flips[:40]), np.unique(base ^ flips[40:])
    codes, label = simhash.walk(left, right, limit=16)
    for i in range(len(left)):
        for j in range(len(left), len(codes)):
            x = int(codes[i] ^ codes[j])
            if x.bit_count() <= 4 and (x >> 32).bit_count() <= 2:
                assert label[i] == label[j]


def test_one_of_each_keeps_the_smallest_id(spark, given):
    docs, _ = given
    kept = simhash.one_of_each(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component_id"] for r in simhash.linked(docs).collect()})


def test_repeated_rows_leave_one(spark, odd):
    kept = simhash.one_of_each(odd).collect()
    rows = simhash.linked(odd).collect()
    assert len(kept) == len({r["root"] for r in rows})
