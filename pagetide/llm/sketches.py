"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A sketch adds each digest to one cell of each of three tables. The difference of two sketches holds only what differs
between the texts; peeling takes digests out of cells that hold a single one until all cells are empty. Where the
difference is too large for the cells, the pair is sketched again with four times as many.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import stored
from pagetide.llm.words import blocks, column

TABLES = 3
# Cells of a table in the published fingerprint; a retry has GROWTH times as many.
CELLS = 8
GROWTH = 4
# Paragraphs are lines cut at ends of sentences, and at so many characters where there are none.
LONGEST = 256
# Cells of all pairs that are peeled at once.
CELLS_AT_ONCE = 1 << 20
BLOCK_CHARS = 1 << 22
_PARAGRAPH = re.compile(rf"[^.!?\n]{{1,{LONGEST}}}[.!?]*|[.!?]+")
_REPEAT = np.uint64(0x9E3779B97F4A7C15)
_CHECK = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * _REPEAT
    x = (x ^ (x >> np.uint64(29))) * _CHECK
    return x ^ (x >> np.uint64(32))


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph digests of all texts one after the other, and the number of each text's. The k-th repeat of a paragraph
    within a text has a digest of its own."""
    parts = [[p for p in map(str.strip, _PARAGRAPH.findall(t)) if p] for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    plain = np.fromiter((xxhash.xxh64_intdigest(p) for own in parts for p in own), np.uint64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(parts)), sizes)
    order = np.lexsort((plain, owner))
    place = np.arange(len(plain))
    first = np.ones(len(plain), bool)
    first[1:] = (plain[order[1:]] != plain[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    repeat = np.empty(len(plain), np.uint64)
    repeat[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return plain + repeat * _REPEAT, sizes


def _cells(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each key in each table, tables one after the other; a smaller sketch's cell follows from a larger's."""
    mixed = _mix(keys)
    return [((mixed >> np.uint64(21 * t)) % np.uint64(cells)).astype(np.int64) + t * cells for t in range(TABLES)]


def sketch(keys: np.ndarray, owner: np.ndarray, n: int, cells: int) -> np.ndarray:
    """Count, key sum and check sum (modulo 2^64) of the cells of n sketches: an array (3, n, TABLES * cells)."""
    width = TABLES * cells
    out = np.zeros((3, n * width), np.uint64)
    check = _mix(keys ^ _CHECK)
    for at in _cells(keys, cells):
        at = at + owner * width
        np.add.at(out[0], at, np.uint64(1))
        np.add.at(out[1], at, keys)
        np.add.at(out[2], at, check)
    return out.reshape(3, n, width)


def peel(difference: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pair, key and side (1: only left, -1: only right) of what was recovered, and which pairs are empty now."""
    n = difference.shape[1]
    width = TABLES * cells
    count, key, check = (difference[k].reshape(-1) for k in range(3))
    count = count.view(np.int64)
    pairs, keys, sides = [], [], []
    look = np.flatnonzero(np.abs(count) == 1)
    while len(look):
        side = count[look]
        found = np.where(side > 0, key[look], np.uint64(0) - key[look])
        held = np.where(side > 0, check[look], np.uint64(0) - check[look])
        pair = look // width
        true = _mix(found ^ _CHECK) == held
        where = _cells(found, cells)
        true &= np.logical_or.reduce([look % width == w for w in where])
        pair, found, side = pair[true], found[true], side[true]
        if not len(pair):
            break
        # A digest that stands alone in several cells is taken once.
        order = np.lexsort((found, pair))
        once = np.ones(len(order), bool)
        once[1:] = (pair[order[1:]] != pair[order[:-1]]) | (found[order[1:]] != found[order[:-1]])
        pair, found, side = (x[order[once]] for x in (pair, found, side))
        pairs.append(pair)
        keys.append(found)
        sides.append(side)
        signed = side.astype(np.uint64)
        gone = _mix(found ^ _CHECK) * signed
        touched = []
        for at in _cells(found, cells):
            at = at + pair * width
            np.subtract.at(count, at, side)
            np.subtract.at(key, at, found * signed)
            np.subtract.at(check, at, gone)
            touched.append(at)
        look = np.unique(np.concatenate(touched))
        look = look[np.abs(count[look]) == 1]
    empty = ~(count.reshape(n, width).any(axis=1) | key.reshape(n, width).any(axis=1))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *pairs]), np.concatenate([none.astype(np.uint64), *keys]), np.concatenate([none, *sides]), empty


class Versions:
    """Texts as paragraph digests, to be compared pair by pair."""

    def __init__(self, texts: list[str]):
        self.keys, self.sizes = digests(texts)
        self.ends = np.cumsum(self.sizes)

    def _chosen(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.sizes[texts]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ends[texts] - ends, size)
        return self.keys[at], np.repeat(np.arange(len(texts)), size)

    def sketches(self, texts: np.ndarray, cells: int) -> np.ndarray:
        return sketch(*self._chosen(texts), len(texts), cells)

    def fingerprints(self, cells: int = CELLS) -> list[str]:
        """Base-64 of each text's cells: 16 bits of count, 48 of key sum and 16 of check sum each."""
        step = max(1, CELLS_AT_ONCE // (TABLES * cells))
        out: list[str] = []
        for k in range(0, len(self.sizes), step):
            count, key, check = self.sketches(np.arange(k, min(k + step, len(self.sizes))), cells)
            short = np.concatenate(
                [part.astype("<u8").view(np.uint8).reshape(*part.shape, 8)[:, :, :n] for part, n in ((count, 2), (key, 6), (check, 2))], axis=2
            )
            out += [base64.b64encode(row.tobytes()).decode() for row in short]
        return out

    def differences(self, left: np.ndarray, right: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair, digest and side of everything that differs between texts left[k] and right[k]."""
        found = []
        todo = np.arange(len(left))
        while len(todo):
            step = max(1, CELLS_AT_ONCE // (TABLES * cells))
            again = []
            for k in range(0, len(todo), step):
                part = todo[k : k + step]
                pair, key, side, empty = peel(self.sketches(left[part], cells) - self.sketches(right[part], cells), cells)
                done = empty[pair]
                found.append((part[pair[done]], key[done], side[done]))
                again.append(part[~empty])
            todo = np.concatenate(again)
            cells *= GROWTH
        pairs, keys, sides = ([f[k] for f in found] for k in range(3))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *pairs]), np.concatenate([none.astype(np.uint64), *keys]), np.concatenate([none, *sides])

    def likeness(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Shared paragraphs of all paragraphs of both texts, repeats counted; 1 if both have none."""
        pair, _, side = self.differences(left, right)
        only_left, only_right = (np.bincount(pair[side == s], minlength=len(left)) for s in (1, -1))
        shared = self.sizes[left] - only_left
        either = shared + only_left + only_right
        return np.where(either > 0, shared / np.maximum(1, either), 1.0)


def _version_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        texts = [t or "" for name in ("old", "new") for t in batch.column(name).to_pylist()]
        versions = Versions(texts)
        prints = versions.fingerprints()
        left, right = np.arange(n), np.arange(n) + n
        pair, key, side = versions.differences(left, right)
        lists = []
        for s in (1, -1):
            own = np.flatnonzero(side == s)
            own = own[np.lexsort((key[own], pair[own]))]
            ends = np.cumsum(np.bincount(pair[own], minlength=n))
            lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(key[own].view(np.int64))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(prints[:n]), pa.array(prints[n:]), *lists, pa.array(versions.likeness(left, right))],
            ["doc_id", "old_fingerprint", "new_fingerprint", "removed", "added", "likeness"],
        )


def version_differences(pairs: DataFrame) -> DataFrame:
    """Of each row (doc_id, old, new): both fingerprints, the digests of removed and added paragraphs, and the likeness.

    Null texts are empty; equal texts have equal fingerprints, no differences and likeness 1. An empty table gives no rows.
    """
    rows = pairs.select(F.col("doc_id").cast("long").alias("doc_id"), "old", "new")
    return rows.mapInArrow(
        _version_batches, "doc_id long, old_fingerprint string, new_fingerprint string, removed array<long>, added array<long>, likeness double"
    )


def _numbered(rows: DataFrame, bounds: list[int], name: str, up_to: bool) -> DataFrame:
    """rows with the number of sorted bounds below doc_id (up_to: or equal to it), by bisection."""
    size = 1 << len(bounds).bit_length()
    table = F.array([F.lit(b).cast("long") for b in bounds + [bounds[-1]] * (size - len(bounds))])
    rows = rows.withColumn(name, F.lit(0))
    step = size // 2
    while step:
        at = F.col(name) + step
        probe = F.element_at(table, at)
        passed = (at <= len(bounds)) & ((probe <= F.col("doc_id")) if up_to else (probe < F.col("doc_id")))
        rows = rows.withColumn(name, F.when(passed, at).otherwise(F.col(name)))
        step //= 2
    return rows


def _parts(rows: DataFrame, n: int) -> DataFrame:
    """rows with their range of doc_id in the column part, 0 to n - 1; null ids in 0. Rows of one id that is several
    quantiles at once are dealt out by the hash of their text."""
    bounds = (rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n).alias("b")).first()["b"] if n > 1 else None) or []
    if not bounds:
        return rows.withColumn("part", F.lit(0))
    rows = _numbered(_numbered(rows, bounds, "low", False), bounds, "high", True)
    share = F.least((F.col("text_hash") / F.lit(2.0**64) + 0.5), F.lit(1 - 2.0**-52))
    part = F.col("low") + F.floor(share * (F.col("high") - F.col("low") + 1)) * (F.col("high") > F.col("low")).cast("int")
    return rows.withColumn("part", F.coalesce(F.when(F.col("doc_id").isNotNull(), part), F.lit(0)).cast("int")).drop("low", "high")


def with_next(docs: DataFrame) -> DataFrame:
    """(part, tail, doc_id, text), dealt out by part and sorted so that each row is followed by the next document.

    The order is descending doc_id, null last, equal ids by a hash of their texts. Each part ends with a copy of the
    next part's first document (tail 1), the last part with the first document of all. Texts are shuffled once.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = _parts(rows.withColumn("text_hash", F.xxhash64("text")), n)
    # One row per part, n at most.
    heads = rows.groupBy("part").agg(F.max("doc_id").alias("head_id"))
    present = sorted((r["part"] for r in heads.select("part").collect()), reverse=True)
    before = dict(zip(present, [present[-1], *present], strict=False)) if present else {}
    heads = stored(heads.withColumnRenamed("part", "head_part"), "heads")
    same = (F.col("part") == F.col("head_part")) & F.col("doc_id").eqNullSafe(F.col("head_id"))
    first = rows.join(F.broadcast(heads), same).groupBy("part").agg(F.max_by("text", "text_hash").alias("text"))
    sent = F.element_at(F.create_map([x for p, q in before.items() for x in (F.lit(p), F.lit(q))]), F.col("part")) if before else F.col("part")
    tails = stored(first.select(sent.cast("int").alias("part"), "text"), "tails")
    every = rows.select("part", F.lit(0).alias("tail"), "doc_id", "text_hash", "text").union(
        tails.select("part", F.lit(1), F.lit(None).cast("long"), F.lit(0).cast("long"), "text")
    )
    return every.repartitionById(n, F.col("part")).sortWithinPartitions(F.desc("part"), "tail", F.desc_nulls_last("doc_id"), F.desc("text_hash")).drop("text_hash")


def edited(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by as many characters of the start of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: tuple | None = None
    for rows, texts in blocks(batches, BLOCK_CHARS):
        ids, tails = column(rows, "doc_id").to_pylist(), column(rows, "tail").to_pylist()
        if waiting:
            ids, tails, texts = [waiting[0], *ids], [0, *tails], [waiting[1], *texts]
        waiting = None if tails[-1] else (ids[-1], texts[-1])
        own = [k for k in range(len(texts) - 1) if not tails[k]]
        changed = [edited(texts[k], texts[k + 1]) for k in own]
        versions = Versions(texts + changed)
        prints = versions.fingerprints()
        here = np.array(own, np.int64)
        there = np.arange(len(own)) + len(texts)
        near = versions.likeness(np.concatenate((here, here)), np.concatenate((there, here + 1)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[k] for k in own], pa.int64()), pa.array([len(texts[k]) for k in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()), pa.array([prints[k] for k in own], pa.string()),
                pa.array(prints[len(texts) :], pa.string()), pa.array(near[: len(own)]), pa.array(near[len(own) :]),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its text edited with the next document, and how near it is to both.

    Rows of docs (doc_id, text) each give one row; null texts are empty, an only document is its own next. Two texts
    without a paragraph have likeness 1. An empty table gives no rows; other columns are not looked at.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(_compared, schema)
