"""SimHash near-duplicates: fingerprints of word shingles, joined with themselves over a binary trie.

Two codes within 4 bits differ in at most 2 bits of their first or of their second half. So the trie is walked twice,
once with the halves exchanged, and a pair of nodes is dropped as soon as it differs in more than 2 of the bits read
within the leading half or in more than 4 of all. The upper levels are walked by Spark: each code is sent to every
pair of subtrees it can still link in, and subtrees that hold too many codes are cut deeper. A pair of subtrees is
walked in one task, which returns a spanning forest of the links found, not the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import components, one_row_per_root, releasing, stored

SHINGLE_WORDS = 4
SEED = 42
MOST_BITS = 4
HALF_BITS = MOST_BITS // 2
# Codes that a subtree should hold, and may hold before it is cut deeper.
SUBTREE_CODES = 1 << 14
STEP_BITS = 4
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text's 4-word shingles, repeats counted; 0 without words.

    Bit 63 of the result is the most significant bit of the hashes.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > SHINGLE_WORDS:
        starts, ends = starts[: 1 - SHINGLE_WORDS], ends[SHINGLE_WORDS - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(starts), _CHUNK):
        spans = zip(starts[k : k + _CHUNK].tolist(), ends[k : k + _CHUNK].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in spans], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(codes.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "code"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, code) for each row; code is the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(releasing(_fingerprint_batches), "doc_id long, text_hash long, code long")


class _Trie:
    """Sorted codes and, for each depth, the nodes: first code, number of codes and children of each."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.levels = [(np.zeros(min(1, len(codes)), np.int64), np.array([len(codes)][: len(codes)], np.int64))]
        self.children: list[np.ndarray] = []

    def level(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.levels) <= depth:
            self._deepen()
        return self.levels[depth]

    def _deepen(self) -> None:
        depth = len(self.levels)
        prefix = self.codes >> np.uint64(64 - depth)
        first = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
        parent = np.searchsorted(self.levels[-1][0], first, "right") - 1
        child = np.full((len(self.levels[-1][0]), 2), -1, np.int32)
        child[parent, (prefix[first] & np.uint64(1)).astype(np.int64)] = np.arange(len(first))
        self.children.append(child)
        self.levels.append((first, np.diff(np.append(first, len(self.codes)))))


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the components of i[k] and j[k]; label[x] is the smallest member of x's component."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(jumped := label[label], label):
            label[:] = jumped


def walk(left: np.ndarray, right: np.ndarray | None, limit: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Components among sorted distinct codes that link within the budgets: all codes, and each one's component number.

    right None: links inside left; else only links from left to right count, so components may miss links
    inside either side. limit bounds the node pairs expanded at once.
    """
    a = _Trie(left)
    b = a if right is None else _Trie(right)
    codes = left if right is None else np.concatenate((left, right))
    shift = 0 if right is None else len(left)
    label = np.arange(len(codes))
    stack = [(0, np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int8))] if len(left) and len(b.codes) else []
    while stack:
        depth, x, y, diff = stack.pop()
        if len(x) > limit:
            half = len(x) // 2
            stack += [(depth, x[:half], y[:half], diff[:half]), (depth, x[half:], y[half:], diff[half:])]
            continue
        (first_x, size_x), (first_y, size_y) = a.level(depth), b.level(depth)
        single = (size_x[x] == 1) & (size_y[y] == 1)
        i, j = first_x[x[single]], first_y[y[single]]
        near = np.bitwise_count(a.codes[i] ^ b.codes[j]) <= MOST_BITS
        _join_labels(label, i[near], j[near] + shift)
        x, y, diff = x[~single], y[~single], diff[~single]
        # Nodes whose codes are all in one component, the same for both, have nothing left to join.
        low_x, high_x = np.minimum.reduceat(label, first_x), np.maximum.reduceat(label[: len(a.codes)], first_x)
        if shift:
            low_x = np.minimum.reduceat(label[:shift], first_x)
        low_y, high_y = (low_x, high_x) if b is a else (np.minimum.reduceat(label[shift:], first_y), np.maximum.reduceat(label[shift:], first_y))
        open_ = (np.minimum(low_x[x], low_y[y]) != np.maximum(high_x[x], high_y[y])) & (depth < 64)
        x, y, diff = x[open_], y[open_], diff[open_]
        if not len(x):
            continue
        a.level(depth + 1)
        b.level(depth + 1)
        budget = HALF_BITS if depth < 32 else MOST_BITS
        parts = []
        for p, q in ((0, 1), (1, 0), (0, 0), (1, 1)):
            cx, cy, d = a.children[depth][x, p], b.children[depth][y, q], diff + (p != q)
            keep = (cx >= 0) & (cy >= 0) & (d <= budget)
            if right is None and (p, q) == (1, 0):
                keep &= x != y
            parts.append((cx[keep], cy[keep], d[keep].astype(np.int8)))
        stack.append((depth + 1, *(np.concatenate([part[k] for part in parts]) for k in range(3))))
    return codes, label


def _links(key: tuple, table: pa.Table) -> pa.Table:
    """Of one pair of subtrees: an edge from each linked code to the first of its component."""
    side, code = table.column("side").to_numpy(), table.column("code").to_numpy().view(np.uint64)
    turned = bool(key[0].as_py())
    code = np.where(turned, np.bitwise_or(code << np.uint64(32), code >> np.uint64(32)), code)
    left, right = np.unique(code[side == 0]), np.unique(code[side == 1])
    same = key[2].as_py() == key[3].as_py()
    codes, label = walk(left, None if same else right)
    moved = label != np.arange(len(codes))
    ends = [codes[moved], codes[label[moved]]]
    if turned:
        ends = [e << np.uint64(32) | e >> np.uint64(32) for e in ends]
    return pa.table({"a": pa.array(ends[0].view(np.int64)), "b": pa.array(ends[1].view(np.int64))})


def _bits(code: Column, start: int | Column, n: int) -> Column:
    """n bits of a code from bit `start` (0: the most significant)."""
    moved = F.call_function("shiftrightunsigned", code, F.lit(64 - n) - start) if n else F.lit(0).cast("long")
    return moved.bitwiseAND(F.lit((1 << n) - 1).cast("long")) if n else moved


def _masks(n: int, most: int) -> Column:
    return F.array([F.lit(m).cast("long") for m in range(1 << n) if m.bit_count() <= most])


def subtree_pairs(codes: DataFrame, subtree: int = SUBTREE_CODES) -> DataFrame:
    """Every code in every pair of subtrees that may hold a partner: turned, depth, low, high, side, code.

    A pair (low, high) of prefixes has the codes of low on side 0 and those of high on side 1. Prefixes that hold
    more than `subtree` codes are read STEP_BITS further, pair by pair, up to the whole code.
    """
    both = codes.select(F.lit(0).alias("turned"), "code").union(codes.select(F.lit(1), "code"))
    read = F.when(F.col("turned") == 0, F.col("code")).otherwise(F.shiftleft("code", 32).bitwiseOR(F.call_function("shiftrightunsigned", F.col("code"), F.lit(32))))
    n = codes.count()
    start = max(0, min(16, math.ceil(math.log2(max(1, n) / subtree))))
    masks = sorted(m for m in range(1 << start) if m.bit_count() <= HALF_BITS)
    rows = both.withColumn("own", _bits(read, 0, start)).withColumn("mask", F.explode(F.array([F.lit(m).cast("long") for m in masks])))
    rows = _paired(rows, F.col("own"), F.col("own").bitwiseXOR(F.col("mask"))).withColumn("depth", F.lit(start))
    columns = ["turned", "depth", "low", "high", "side", "code"]
    rows, done = rows.select(columns), []
    for depth in range(start, 64, STEP_BITS):
        step = min(STEP_BITS, 64 - depth)
        prefix = both.groupBy("turned", _bits(read, 0, depth).alias("prefix")).count().filter(F.col("count") > subtree * 2)
        if not prefix.limit(1).count():
            break
        # Only pairs of which a side is still too large are cut; the list of prefixes is at most 1/subtree of the codes.
        large = prefix.select("turned", F.col("prefix").alias("low"), F.lit(True).alias("large_low"))
        large2 = prefix.select("turned", F.col("prefix").alias("high"), F.lit(True).alias("large_high"))
        marked = rows.join(large, ["turned", "low"], "left").join(large2, ["turned", "high"], "left")
        is_large = F.coalesce("large_low", F.lit(False)) | F.coalesce("large_high", F.lit(False))
        done.append(marked.filter(~is_large).select(columns))
        marked = stored(marked.filter(is_large), "crowded")
        budget = HALF_BITS if depth + step <= 32 else MOST_BITS
        deeper = marked.withColumn("own", F.when(F.col("side") == 0, F.col("low")).otherwise(F.col("high")))
        deeper = deeper.withColumn("other", F.when(F.col("side") == 0, F.col("high")).otherwise(F.col("low")))
        deeper = deeper.withColumn("mask", F.explode(_masks(step, MOST_BITS)))
        next_bits = _bits(read, depth, step)
        deeper = deeper.withColumn("own", F.shiftleft("own", step).bitwiseOR(next_bits))
        deeper = deeper.withColumn("other", F.shiftleft("other", step).bitwiseOR(next_bits.bitwiseXOR(F.col("mask"))))
        deeper = deeper.filter(F.bit_count(F.col("own").bitwiseXOR(F.col("other"))) <= budget)
        rows = _paired(deeper.drop("low", "high", "side"), F.col("own"), F.col("other")).withColumn("depth", F.lit(depth + step)).select(columns)
    for d in done:
        rows = rows.union(d)
    return rows


def _paired(rows: DataFrame, own: Column, other: Column) -> DataFrame:
    return rows.withColumn("low", F.least(own, other)).withColumn("high", F.greatest(own, other)).withColumn("side", F.when(own <= other, 0).otherwise(1))


def code_components(codes: DataFrame, subtree: int = SUBTREE_CODES) -> DataFrame:
    """(node, root) for each distinct code that links with another one; codes has one row per code."""
    pairs = subtree_pairs(codes, subtree)
    edges = pairs.groupBy("turned", "depth", "low", "high").applyInArrow(_links, "a long, b long")
    return components(edges)


def linked(docs: DataFrame, subtree: int = SUBTREE_CODES) -> DataFrame:
    """(doc_id, text_hash, code, root, component_id) for each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links, root the code that names the component. Null and empty
    texts, and texts without words, have code 0 and link with every code of at most 4 ones. Rows with equal texts are
    always linked. A component of null ids alone has a null component_id. An empty table gives no rows; other columns
    are not looked at.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    codes = stored(rows.groupBy("code").agg(F.min("doc_id").alias("first_id")), "codes")
    roots = stored(code_components(codes.select("code"), subtree), "roots")
    labelled = codes.join(roots.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(labelled.select("code", "root").join(smallest, "root"), "named")
    return rows.join(named, "code").select("doc_id", "text_hash", "code", "root", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each component one row with its smallest doc_id (null only if it has no other).

    Columns as in docs, whatever their names. Of repeated rows one stays.
    """
    return one_row_per_root(docs, linked(docs))
