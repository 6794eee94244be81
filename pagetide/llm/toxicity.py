"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import releasing, remainder
from pagetide.llm.words import WordIndex, blocks, column

FOLDS, HELD_OUT = 5, 0
# The fit takes at most so many labelled documents, in order of a hash of their ids, each with all its features; no
# further document is taken once those before have so many features together, which its one task holds in memory.
SAMPLE_DOCUMENTS = 12_000
SAMPLE_FEATURES = 48_000_000
HASH_BITS = 20
SCORED_CHARS = 1 << 22
# The same in the filter, whose workers also hold whole rows.
FILTERED_CHARS = 1 << 20
# Letters of the beginnings of longer words that are features of their own.
BEGINNINGS = (4, 8)
# What occurs in a single document cannot pass L1 in so many epochs, so that no document is learned by heart.
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
_WORD = re.compile(r"\w+")
# Odd multipliers that keep the second word of a pair, and pairs with a gap, apart from single words.
_NEXT, _AFTER_NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Hasher:
    """Features of texts: single words, their beginnings, pairs of neighbours and pairs with one word between, hashed to
    HASH_BITS bits. Beginnings let the forms and compounds of a word share what was learned of one of them."""

    def __init__(self) -> None:
        self._index = WordIndex()
        self._hashes = np.zeros((1 + len(BEGINNINGS), 0), np.uint64)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Feature numbers of each text, repeats and all."""
        numbers = [self._index(_WORD.findall(t.lower())) for t in texts]
        new = self._index.words()[self._hashes.shape[1] :]
        made = [[xxhash.xxh64_intdigest(w) for w in new]]
        made += [[xxhash.xxh64_intdigest(w[:n] + "-" * (len(w) > n)) for w in new] for n in BEGINNINGS]
        self._hashes = np.concatenate((self._hashes, np.array(made, np.uint64).reshape(len(made), -1)), axis=1)
        return [self._features(self._hashes[:, n]) for n in numbers]

    @staticmethod
    def _features(hashes: np.ndarray) -> np.ndarray:
        h = hashes[0]
        pairs, gaps = h[:-1] * _NEXT + h[1:], h[:-2] * _AFTER_NEXT + h[2:]
        mixed = np.concatenate((hashes.ravel(), pairs, gaps)) * _NEXT
        return (mixed >> np.uint64(64 - HASH_BITS)).astype(np.int32)


class Ftrl:
    """FTRL-proximal: each coordinate has a rate of its own, and L1 keeps at zero what carries little."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.bias = size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        # The bias has no penalty.
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(at == self.bias, 0.0, L1), 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, self.bias)
        w = self.weights(at)
        error = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30.0, 30.0))) - label
        self.z[at] += error - (np.sqrt(self.n[at] + error * error) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += error * error


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in blocks(batches):
        features = [np.unique(f) for f in Hasher()(texts)]
        offsets = np.concatenate(([0], np.cumsum([len(f) for f in features])))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(features)))
        yield pa.RecordBatch.from_arrays([column(rows, c) for c in ("place", "toxic", "text_hash")] + [lists], ["place", "toxic", "text_hash", "features"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels: list[int] = []
    features: list[np.ndarray] = []
    total = 0
    for batch in batches:
        for label, found in zip(batch.column("toxic").to_pylist(), batch.column("features"), strict=True):
            if total < SAMPLE_FEATURES:
                labels.append(label)
                features.append(found.values.to_numpy().copy())
                total += len(features[-1])
    model = Ftrl(1 << HASH_BITS)
    for _ in range(EPOCHS):
        for f, label in zip(features, labels, strict=True):
            model.learn(f, label)
    weights = model.weights(np.arange(len(model.z)))
    kept = np.flatnonzero(weights)
    yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), pa.array(weights[kept])], ["feature", "weight"])


def learn(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> np.ndarray:
    """Weights by feature, the bias last, from docs (doc_id, text) and labels (doc_id, toxic).

    Labels are null-free, outside the held-out fold and of documents that are there; of several for an id the largest
    counts, of several texts of an id the one with the smallest hash. The sample is bounded, so one task fits it, and the
    driver gets the weights that are not zero.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.filter(F.col("toxic").isin(0, 1) & (remainder("doc_id", folds) != held_out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.withColumn("place", F.md5(F.concat(F.lit("toxic:"), F.col("doc_id").cast("string")).cast("binary")))
    ids = F.col("doc_id").cast("long").alias("doc_id")
    chosen = chosen.join(docs.select(ids), "doc_id", "left_semi").orderBy("place").limit(SAMPLE_DOCUMENTS)
    # At most SAMPLE_DOCUMENTS ids are broadcast; the texts stay where they are read.
    rows = docs.select(ids, "text").join(F.broadcast(chosen), "doc_id").select("place", "toxic", F.xxhash64("text").alias("text_hash"), "text")
    hashed = rows.mapInArrow(releasing(_hashed), "place string, toxic int, text_hash long, features array<int>")
    one = hashed.groupBy("place").agg(F.min_by(F.struct("toxic", "features"), "text_hash").alias("one")).select("place", "one.toxic", "one.features")
    fitted = one.coalesce(1).sortWithinPartitions("place").mapInArrow(releasing(_fit), "feature int, weight double")
    weights = np.zeros((1 << HASH_BITS) + 1, np.float32)
    table = fitted.toArrow()
    weights[table.column("feature").to_numpy()] = table.column("weight").to_numpy()
    return weights


def _scores(texts: list[str], weights: np.ndarray, chars: int = SCORED_CHARS) -> np.ndarray:
    """Chance of the label; each feature counts once in a text."""
    sums = np.full(len(texts), float(weights[-1]))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    # Features of so many characters of text are held at once.
    for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends // chars)) + 1):
        for k, found in zip(part, Hasher()([texts[k] for k in part]), strict=True):
            sums[k] += weights[np.unique(found[weights[found] != 0])].sum(dtype=np.float64)
    return 1.0 / (1.0 + np.exp(-np.clip(sums, -30.0, 30.0)))


def _predict(weights: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches):
            score = _scores(texts, weights.value)
            yield pa.RecordBatch.from_arrays(
                [column(rows, "doc_id"), column(rows, "held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text).

    Null texts are empty; an empty text, and every text when there is nothing to learn from, has the score of the bias
    alone (0.5 without labels). Null ids are not held out. An empty table gives no rows; other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    held = F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text")
    return rows.mapInArrow(_predict(sent), "doc_id long, held_out boolean, score double, predicted int")


def _accept(weights: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _scores([t or "" for t in batch.column("text").to_pylist()], weights.value, FILTERED_CHARS) < 0.5
            yield batch.filter(pa.array(keep))

    return run


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic; columns as in docs. Null and empty texts have the score of the bias
    alone; an empty table gives no rows. Without anything to learn from every row is kept."""
    weights = learn(docs, labels)
    if not weights.any():
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.mapInArrow(releasing(_accept(sent)), docs.schema)
