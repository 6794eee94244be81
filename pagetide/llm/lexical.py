"""Ranked lexical search: the best documents of every item, found among impact vectors ordered by length.

A document is a vector over the items' terms; a coordinate, the impact, is what one occurrence of the term in an item
adds to the score. Vectors are dealt out by length, longest first, and cut into buckets of similar length. In a bucket
an item is dropped if its length times the bucket's cannot reach its tenth best score so far (Cauchy-Schwarz), or if
the bucket's largest coordinates cannot. For the others the terms with the smallest possible gain that together stay
below that score are set aside: a document must hold one of the remaining terms. Only those documents are scored, in
64-bit integers over all terms of the item. Nothing is lost: bounds are rounded up, ties stay in.

The longest vectors are searched first; the scores that they reach are the bounds that the others start from.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetide.llm.common import stored
from pagetide.llm.words import blocks, column

BEST = 10
# Items are searched in rounds whose texts have about this many bytes; what a round's items need is broadcast.
ROUND_BYTES = 16 << 20
# Share of the vectors, the longest ones, that are searched first.
LEADING = 1 / 32
# Coordinates of a bucket.
BUCKET_TERMS = 1 << 18
BLOCK_CHARS = 1 << 22
# Bounds in doubles are raised by this share, far above their rounding errors.
_SLACK = 1 + 1e-9
# Bytes that part terms become a space, A-Z become a-z.
_TERM_BYTES = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(0x80)).lower() + bytes(range(0x80, 0x100))
_VECTOR = "doc_id long, n long, terms array<int>, tfs array<int>"
_FOUND = "item int, doc_id long, score long"


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased."""
    return text.encode().translate(_TERM_BYTES).split()


def _ragged(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, pa.int32()))


def _vectors(vocabulary: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: k for k, term in enumerate(vocabulary.value)}
        size = len(number) + 1
        for rows, texts in blocks(batches, BLOCK_CHARS):
            counts, keys = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)]
            for k, text in enumerate(texts):
                words = terms_of(text)
                counts[k] = len(words)
                keys.append(np.fromiter(map(number.get, words, repeat(size - 1)), np.int64, len(words)) + k * size)
            found, tfs = np.unique(np.concatenate(keys), return_counts=True)
            doc, term = np.divmod(found, size)
            known = term < size - 1
            sizes = np.bincount(doc[known], minlength=len(texts))
            yield pa.RecordBatch.from_arrays(
                [column(rows, "doc_id"), pa.array(counts), _ragged(term[known], sizes), _ragged(tfs[known], sizes)], ["doc_id", "n", "terms", "tfs"]
            )

    return run


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _impacts(n: np.ndarray, terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, weights: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What one occurrence of each term in an item adds to the score of the document, in 64-bit integers."""
    m = 25 + 75 * n * documents // max(words, 1)
    return weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * np.repeat(m, sizes)))


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """n, terms, tfs and sizes of a batch of vectors."""
    terms, tfs = batch.column("terms"), batch.column("tfs")
    flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, tfs)]
    return (batch.column("n").to_numpy(), *flat, np.diff(terms.offsets.to_numpy()).astype(np.int64))


def _with_length(model: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, weights, documents, words = model.value
        for batch in batches:
            n, terms, tfs, sizes = _lists(batch)
            squares = _impacts(n, terms, tfs, sizes, weights, documents, words).astype(np.float64) ** 2
            starts = np.cumsum(sizes) - sizes
            length = np.sqrt(np.where(sizes > 0, np.add.reduceat(np.append(squares, 0.0), starts), 0.0)) if len(sizes) else squares
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length)], ["doc_id", "n", "terms", "tfs", "length"])

    return run


class Search:
    """The best documents of every item among the buckets seen so far."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], reached: np.ndarray, best: int):
        self.items = items
        self.best = best
        self.reached = reached.copy()
        self.lengths = np.array([math.sqrt(float((c.astype(np.float64) ** 2).sum())) for _, c in items])
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        self.scored = 0
        # All items' coordinates in one sequence, for bounds of all items at once.
        self.sizes = np.array([len(t) for t, _ in items], np.int64)
        self.terms = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in items)])
        self.counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in items)])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def bucket(self, doc_ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, impacts: np.ndarray, sizes: np.ndarray, vocabulary: int) -> None:
        """Search the vectors of a bucket: impacts by document; `sizes` has how many each has."""
        longest = float(lengths.max(initial=0.0))
        live = (self.sizes > 0) & (self.lengths * longest * _SLACK >= np.maximum(self.reached, 1))
        if not live.any():
            return
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(terms, kind="stable")
        postings, gains = owner[order], impacts[order]
        first = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        highest = np.zeros(vocabulary, np.int64)
        held = np.flatnonzero(np.diff(first))
        if len(held):
            highest[held] = np.maximum.reduceat(gains, first[held])
        possible = self.counts * highest[self.terms]
        upto = np.concatenate(([0], np.cumsum(possible)))
        live &= upto[self.starts + self.sizes] - upto[self.starts] >= np.maximum(self.reached, 1)
        scores = np.zeros(len(sizes), np.int64)
        for k in np.flatnonzero(live).tolist():
            at = slice(self.starts[k], self.starts[k] + self.sizes[k])
            own, counts, gain = self.terms[at], self.counts[at], possible[at]
            rising = np.argsort(gain, kind="stable")
            # Terms set aside: together they cannot reach the bound.
            aside = int(np.searchsorted(np.cumsum(gain[rising]), max(self.reached[k], 1), "left"))
            spans = [(int(first[t]), int(first[t + 1]), int(c)) for t, c in zip(own[rising], counts[rising], strict=True)]
            marked = [postings[i:j] for i, j, _ in spans[aside:] if j > i]
            if not marked:
                continue
            scores[:] = 0
            for i, j, c in spans[aside:]:
                scores[postings[i:j]] += c * gains[i:j]
            candidates = np.flatnonzero(scores)
            # With all of its other terms at their highest a document must still reach the bound.
            rest = int(gain[rising[:aside]].sum())
            candidates = candidates[scores[candidates] + rest >= self.reached[k]]
            exact = scores[candidates]
            for i, j, c in spans[:aside]:
                if j > i and len(candidates):
                    where = np.minimum(np.searchsorted(postings[i:j], candidates), j - i - 1)
                    exact += np.where(postings[i:j][where] == candidates, c * gains[i:j][where], 0)
            self.scored += len(candidates)
            self._keep(k, doc_ids[candidates], exact)

    def _keep(self, k: int, doc_ids: np.ndarray, scores: np.ndarray) -> None:
        inside = scores >= max(self.reached[k], 1)
        ids, kept = (np.concatenate(pair) for pair in zip(self.found[k], (doc_ids[inside], scores[inside]), strict=True))
        order = np.lexsort((ids, -kept))[: self.best]
        self.found[k] = ids[order], kept[order]
        if len(order) == self.best:
            self.reached[k] = max(self.reached[k], int(kept[order[-1]]))


def _searched(model: Broadcast, best: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, documents, words, reached = model.value
        search = Search(items, reached, best)
        held, size = [], 0

        def flush() -> None:
            n, terms, tfs, sizes = (np.concatenate(x) for x in zip(*(_lists(b) for b in held), strict=True))
            impacts = _impacts(n, terms, tfs, sizes, weights, documents, words)
            # Null ids come last among equal scores; no id is as large as the number that stands for them.
            ids = column(held, "doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
            search.bucket(ids, column(held, "length").to_numpy(), terms, impacts, sizes, len(weights))

        for batch in batches:
            start, ends = 0, batch.column("terms").offsets.to_numpy()
            while start < batch.num_rows:
                stop = min(batch.num_rows, max(start + 1, int(np.searchsorted(ends, ends[start] + BUCKET_TERMS - size, "right")) - 1))
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop] - ends[start])
                start = stop
                if size >= BUCKET_TERMS or start < batch.num_rows:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        for k, (ids, scores) in enumerate(search.found):
            none = ids == np.iinfo(np.int64).max
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), k, np.int32)), pa.array(ids, pa.int64(), mask=none), pa.array(scores)], ["item", "doc_id", "score"])

    return run


def _round(docs: DataFrame, own: list, best: int) -> DataFrame | None:
    """(item_id, doc_id, score): candidates for the best documents of the items of a round, rows (item_id, text)."""
    spark = docs.sparkSession
    counts: dict = {}
    for item_id, text in own:
        held = counts.setdefault(item_id, {})
        for term in terms_of(text or ""):
            held[term] = held.get(term, 0) + 1
    vocabulary = sorted({term for held in counts.values() for term in held})
    number = {term: k for k, term in enumerate(vocabulary)}
    names = list(counts)
    items = [(np.array([number[t] for t in held], np.int64), np.array(list(held.values()), np.int64)) for held in counts.values()]
    if not vocabulary:
        return None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vectors = stored(rows.mapInArrow(_vectors(spark.sparkContext.broadcast(vocabulary)), _VECTOR), "vectors")
    totals = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row for each term of the round's items.
    holding = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[r["term"]] = r["count"]
    documents, words = totals
    weights = np.array([weight(documents, h) for h in holding.tolist()], np.int64)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = spark.sparkContext.broadcast((items, weights, documents, words))
    held = vectors.filter(F.size("terms") > 0).mapInArrow(_with_length(model), _VECTOR + ", length double")
    # Vectors of one length, such as copies, are told apart by their ids.
    order = [F.col("length").desc(), F.xxhash64("doc_id", "n")]
    dealt = stored(held.repartitionByRange(n, *order).sortWithinPartitions(F.col("length").desc()), "by-length")
    leading = dealt.agg(F.percentile_approx("length", 1 - LEADING, 1000)).first()[0]
    if leading is None:
        return None

    def search(part: DataFrame, reached: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((items, weights, documents, words, reached))
        return part.mapInArrow(_searched(sent, best), _FOUND)

    first = stored(search(dealt.filter(F.col("length") >= leading), np.zeros(len(items), np.int64)), "leading")
    reached = np.zeros(len(items), np.int64)
    for r in ranked(first, best).filter(F.col("rank") == best).select("item", "score").collect():
        reached[r["item"]] = r["score"]
    found = first.unionByName(search(dealt.filter(F.col("length") < leading), reached))
    named = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")
    return found.join(named, "item").select("item_id", "doc_id", "score")


def ranked(found: DataFrame, best: int, key: str = "item") -> DataFrame:
    """The rows with the best scores of each item, numbered from 1; equal scores by doc_id, null last."""
    place = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= best)


def best_documents(docs: DataFrame, benchmark: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the `best` documents of each item, of docs (doc_id, text) and benchmark (item_id, text).

    Rows of benchmark with one item_id are one item, whose terms are those of all of them. Each row of docs is a document,
    also if ids repeat; null and empty texts have no terms and no score. Equal scores stand by ascending doc_id, null last.
    Items without a document that shares a term have no rows, nor has an empty table. Other columns are not looked at.

    Items are taken in rounds of about ROUND_BYTES of text, by a hash of the id, so what is broadcast does not grow with
    the tables; each round reads all documents.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rounds = max(1, math.ceil(size / ROUND_BYTES))
    found = []
    for k in range(rounds):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == k).collect()
        part = _round(docs, [(r["item_id"], r["text"]) for r in own], best)
        if part is not None:
            found.append(ranked(part, best, "item_id"))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole.select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH words AS (
    SELECT doc_id, row_number() OVER () AS row_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
sizes AS (SELECT row_id, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
tfs AS (
    SELECT row_id, term, CAST(count(*) AS BIGINT) AS tf
    FROM (SELECT row_id, unnest(terms) AS term FROM sizes) GROUP BY row_id, term),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), totals),
asked AS (
    SELECT item_id, term, CAST(count(*) AS BIGINT) AS c
    FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
    GROUP BY item_id, term),
scores AS (
    SELECT a.item_id, s.doc_id, s.row_id,
        CAST(sum(a.c * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * s.n * o.docs) // o.words)))) AS BIGINT) AS score
    FROM asked a JOIN tfs t ON t.term = a.term JOIN weights w ON w.term = a.term
        JOIN sizes s ON s.row_id = t.row_id, totals o
    GROUP BY a.item_id, s.doc_id, s.row_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""
