"""Language-model scores by masked pseudo-likelihood.

A small network predicts a word from the two words on either side of it: first one of CLASSES classes, then the word
within its class. It is fitted on every word of all documents once: each of ROUNDS rounds masks its own part of the
words, each partition of the corpus trains a copy, and the copies are averaged by the words they saw. A document's score is the sum of the log
probabilities of all its words, each given its neighbours. The network knows VOCABULARY entries, of which RARE stand for
all rarer words; a rarer word's probability is that of its entry times its share in the entry.
"""

from __future__ import annotations

import ctypes
import string
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import stored
from pagetide.llm.words import WordIndex, blocks, column, gather, pack_numbers, pack_words, unpack_numbers, unpack_words

CLASSES = 64
CLASS_WORDS = 64
# Entries of the vocabulary for rarer words, shared by hash.
RARE = 256
VOCABULARY = CLASSES * CLASS_WORDS
WIDTH = 24
SIDE = 2
# Each word is masked, and so learned from, in one of the rounds.
ROUNDS = 2
RATE = 0.3
BATCH = 8192
# The network's outputs are held within this on either side.
LARGEST = np.float32(60)
SCORED_AT_ONCE = 1 << 13
PIECE = 1 << 14
BLOCK_CHARS = 1 << 23
# Words are counted in so many buckets at least, and in more where there are more blocks to a bucket.
BUCKETS = 32
BLOCKS_A_BUCKET = 8
_AROUND = tuple(k for k in range(-SIDE, SIDE + 1) if k)
_EDGES = string.punctuation.encode()
# Names of glibc's mallopt.
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3


def _word(chunk: bytes) -> bytes:
    """What stands between blanks, in lower case, without ASCII punctuation at its ends (if anything is left)."""
    return chunk.strip(_EDGES).lower() or chunk


def _split(text: str) -> list[bytes]:
    return text.encode().split()


_NUMBERED = "ids array<long>, sizes array<int>, seeds array<long>, words array<binary>, seen binary"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of texts: their ids, numbers of words and hashes, the distinct words of the block, and, one
    text after the other, the place of each word among those."""
    for rows, texts in blocks(batches, BLOCK_CHARS):
        chunks, index = WordIndex(), WordIndex()
        places = [chunks(_split(t)) for t in texts]
        number = index([_word(c) for c in chunks.words()])
        seen = number[np.concatenate(places)] if len(number) else number
        seeds = [zlib.crc32(t.encode()) for t in texts]
        values = [(column(rows, "doc_id").to_pylist(), pa.int64()), ([len(p) for p in places], pa.int32()), (seeds, pa.int64()), (index.words(), pa.binary())]
        arrays = [pa.array([v], pa.list_(t)) for v, t in values] + [pa.array([pack_numbers(seen)], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["ids", "sizes", "seeds", "words", "seen"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
    """ids, sizes, seeds, words and seen of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, sizes, seeds, words = (batch.column(c)[k].values for c in ("ids", "sizes", "seeds", "words"))
            seen = unpack_numbers(batch.column("seen")[k].as_py())
            yield ids, sizes.to_numpy().astype(np.int64), seeds.to_numpy(), words.to_numpy(zero_copy_only=False).tolist(), seen


def numbered(docs: DataFrame) -> DataFrame:
    """The texts of docs (doc_id, text) as blocks of numbered words, stored, so that they are taken apart only once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(_numbered, _NUMBERED), "numbered")


def _by_bucket(words: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket of words that has any, with the places of its words; a hash deals them out."""
    bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) // RARE % buckets
    order = np.argsort(bucket, kind="stable")
    for b, part in _slices(bucket[order]):
        yield b, order[part]


_COUNTED = "bucket int, words binary, n binary"


def _count(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, words, seen in _unpacked(batches):
            n = np.bincount(seen, minlength=len(words))
            found = [(b, pack_words([words[k] for k in at.tolist()]), pack_numbers(n[at])) for b, at in _by_bucket(words, buckets)]
            if found:
                columns = zip(zip(*found, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["bucket", "words", "n"])

    return run


_TOTALS = "bucket int, words binary, n binary, top array<binary>, top_n array<long>, entries array<long>"


def _total(table: pa.Table) -> pa.Table:
    """Of one bucket: its distinct words with their counts over all blocks (64 bits each), the most frequent of them,
    ties by their bytes, and the sums for the shared entries."""
    index = WordIndex()
    number = np.concatenate([index(unpack_words(w)) for w in table["words"].to_pylist()])
    times = np.concatenate([unpack_numbers(n) for n in table["n"].to_pylist()])
    words = index.words()
    n = np.bincount(number, times, len(words)).astype(np.int64)
    wanted = min(VOCABULARY - RARE, len(words))
    least = np.partition(n, len(n) - wanted)[len(n) - wanted]
    top = sorted((-int(n[k]), words[k]) for k in np.flatnonzero(n >= least).tolist())[:wanted]
    entries = np.bincount(_entries(words), n, RARE).astype(np.int64)
    values = {"words": pack_words(words), "n": n.tobytes(), "top": [w for _, w in top], "top_n": [-k for k, _ in top], "entries": entries.tolist()}
    return pa.table({"bucket": table["bucket"][:1], **{name: [v] for name, v in values.items()}})


def _entries(words: list[bytes]) -> np.ndarray:
    """The shared entry that stands for each word if it is a rare one."""
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % RARE


class Vocabulary:
    """Numbers of words, most frequent first, and the counts of all entries; rarer words share the last RARE entries.

    rest: how often the words of each shared entry occur.
    """

    def __init__(self, words: list[bytes], counts: list[int], rest: np.ndarray):
        self.number = {w: k for k, w in enumerate(words)}
        self.rest = rest
        self.counts = np.ones(VOCABULARY)
        self.counts[: len(counts)] += counts
        self.counts[-RARE:] += rest

    def __call__(self, words: list[bytes]) -> np.ndarray:
        rare = VOCABULARY - RARE
        return np.array([self.number.get(w, -1) if w in self.number else rare + zlib.crc32(w) % RARE for w in words], np.int64).reshape(-1)


def _buckets(texts: DataFrame) -> int:
    return max(BUCKETS, texts.count() // BLOCKS_A_BUCKET)


def word_counts(texts: DataFrame) -> DataFrame:
    """How often each word occurs in the numbered texts, as a row for each bucket of words, stored.

    Blocks send their words packed, so that Spark moves a row for each block and bucket, not for each word; a bucket
    meets as many words as BLOCKS_A_BUCKET blocks hold, or, of few blocks, fewer.
    """
    buckets = _buckets(texts)
    counted = texts.mapInArrow(_count(buckets), _COUNTED)
    return stored(counted.groupBy("bucket").applyInArrow(_total, _TOTALS), "words")


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    """From the counts of all words; the driver gets the VOCABULARY - RARE most frequent, ties by their bytes."""
    counts = word_counts(numbered(docs)) if counts is None else counts
    most = counts.select(F.explode(F.arrays_zip("top", "top_n")).alias("w")).select(F.col("w.top").alias("word"), F.col("w.top_n").alias("n"))
    top = most.orderBy(F.desc("n"), "word").limit(VOCABULARY - RARE).collect()
    rest = np.zeros(RARE)
    for entry, n in counts.select(F.posexplode("entries").alias("entry", "n")).groupBy("entry").agg(F.sum("n")).collect():
        rest[entry] = n
    for r in top:
        rest[zlib.crc32(r["word"]) % RARE] -= r["n"]
    return Vocabulary([bytes(r["word"]) for r in top], [r["n"] for r in top], rest)


class Network:
    """Parameters in one array; the named parts are views of it. The biases are the last rows of to_class and to_word."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        shapes = {
            "embed": (VOCABULARY + 1, WIDTH), "place": (len(_AROUND), WIDTH), "to_class": (WIDTH + 1, CLASSES),
            "to_word": (CLASSES, WIDTH + 1, CLASS_WORDS),
        }
        at = 0
        for name, shape in shapes.items():
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size
        self.class_bias, self.word_bias = self.to_class[-1], self.to_word[:, -1]

    @staticmethod
    def size() -> int:
        return (VOCABULARY + 1) * WIDTH + len(_AROUND) * WIDTH + (WIDTH + 1) * (CLASSES + VOCABULARY)

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Small random vectors; the biases are those of the word counts, so training starts from the unigram model."""
        net = cls(np.zeros(cls.size(), np.float32))
        rng = np.random.default_rng(7)
        net.embed[:-1] = rng.normal(0, 0.3, net.embed[:-1].shape)
        net.place[:] = 1.0 / len(_AROUND)
        by_class = counts.reshape(CLASSES, CLASS_WORDS)
        net.class_bias[:] = np.log(by_class.sum(axis=1) / counts.sum())
        net.word_bias[:] = np.log(by_class / by_class.sum(axis=1, keepdims=True))
        return net

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """Of each row of vectors around a word; behind it a one, for the bias."""
        h = np.ones((len(context), WIDTH + 1), self.flat.dtype)
        np.einsum("njw,jw->nw", context, self.place, out=h[:, :WIDTH])
        return h

    def within_class(self, h: np.ndarray, parts: list[tuple[int, slice]]) -> np.ndarray:
        """The outputs for the words of each row's class; parts: the classes and where their rows stand."""
        x = np.empty((len(h), CLASS_WORDS), h.dtype)
        for c, part in parts:
            np.matmul(h[part], self.to_word[c], out=x[part])
        return x

    def log_probabilities(self, around: np.ndarray, words: np.ndarray) -> np.ndarray:
        order = np.argsort(_short(words), kind="stable")
        h, words = self.hidden(self.embed.take(around.take(order, axis=0), axis=0)), words[order]
        cls, within = words // CLASS_WORDS, words % CLASS_WORDS
        out = np.empty(len(words))
        out[order] = _log_share(h @ self.to_class, cls) + _log_share(self.within_class(h, list(_slices(cls))), within)
        return out

    def learn(self, around: np.ndarray, words: np.ndarray, squares: Network) -> None:
        """One step of Adagrad on a batch; squares holds the sums of squared gradients.

        The batch is taken in order of its words, so that those of a class stand together.
        """
        rows = np.arange(len(words))
        order = np.argsort(_short(words), kind="stable")
        around, words = around.take(order, axis=0), words[order]
        context = self.embed.take(around, axis=0)
        h = self.hidden(context)
        cls, within = words // CLASS_WORDS, words % CLASS_WORDS
        slope = Network(np.zeros_like(self.flat))
        d = _softmax(h @ self.to_class)
        d[rows, cls] -= 1
        dh = d @ self.to_class[:-1].T
        slope.to_class[:] = h.T @ d
        parts = list(_slices(cls))
        d = _softmax(self.within_class(h, parts))
        d[rows, within] -= 1
        for c, part in parts:
            own = d[part]
            dh[part] += own @ self.to_word[c, :-1].T
            np.matmul(h[part].T, own, out=slope.to_word[c])
        at, by_width, place = around.T.astype(np.intp).ravel(), dh.T.astype(np.float64), self.place.T.astype(np.float64)
        for w in range(WIDTH):
            slope.embed[:, w] = np.bincount(at, np.multiply.outer(place[w], by_width[w]).ravel(), VOCABULARY + 1)
        slope.place[:] = np.einsum("nw,njw->jw", dh, context)
        # The blank beside a text stays zero.
        slope.embed[-1] = 0
        squares.flat += slope.flat * slope.flat
        self.flat -= RATE * slope.flat / np.sqrt(squares.flat + np.float32(1e-6))


def _short(numbers: np.ndarray) -> np.ndarray:
    """Word numbers as 16 bits, which numpy sorts by radix."""
    return numbers.astype(np.uint16)


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, and their sums; x is overwritten. Held within LARGEST, so that none is infinite and no sum zero."""
    np.exp(np.clip(x, -LARGEST, LARGEST, out=x), out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def _softmax(x: np.ndarray) -> np.ndarray:
    """Of each row; x is overwritten."""
    x, total = _exponentials(x)
    x /= total[:, None]
    return x


def _log_share(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The log softmax of each row at its chosen column; x is overwritten."""
    x, total = _exponentials(x)
    return np.log(x[np.arange(len(x)), chosen].astype(np.float64) / total)


def _slices(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Of sorted keys, each key with where it stands."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=False):
        yield int(keys[i]), slice(i, j)


def _prepare_worker() -> None:
    """Products here are so small that a second OpenBLAS thread only waits, at the CPU time of the first. Arrays of a step
    are made again for each step, so freed memory is kept between steps instead of being asked for page by page."""
    if keep := getattr(ctypes.CDLL(None), "mallopt", None):
        keep(_MMAP_THRESHOLD, 1 << 22)
        keep(_TRIM_THRESHOLD, 1 << 25)
    for path in Path(np.__file__).parents[1].glob("numpy.libs/libscipy_openblas*"):
        set_threads = getattr(ctypes.CDLL(str(path)), "scipy_openblas_set_num_threads64_", None)
        if set_threads:
            set_threads(1)


def _sequences(sizes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' vocabulary numbers behind one another, each text between SIDE blanks, and the places of the words.

    number: those of the texts' words, one text after the other; sizes: words of each text.
    """
    places = np.arange(len(number)) + SIDE * (1 + np.repeat(np.arange(len(sizes)), sizes))
    line = np.full(len(number) + SIDE * (len(sizes) + 1), VOCABULARY, np.uint16)
    line[places] = number
    return line, places


def _around(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([line[at + k] for k in _AROUND], axis=1)


def _rounds(seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The round that masks each word, by a hash of its text and its position there."""
    start = seeds.astype(np.uint64)
    position = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    mixed = (np.repeat(start, sizes) + position.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(40)) % np.uint64(ROUNDS)


def _train(numbers: Broadcast, flat: Broadcast, number: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _prepare_worker()
        net, squares = Network(flat.value.copy()), Network(np.zeros(Network.size(), np.float32))
        rng = np.random.default_rng(number)
        learned = 0
        for _, sizes, seeds, words, seen in _unpacked(batches):
            line, places = _sequences(sizes, numbers.value(words)[seen])
            masked = rng.permutation(places[_rounds(seeds, sizes) == number])
            for k in range(0, len(masked), BATCH):
                at = masked[k : k + BATCH]
                net.learn(_around(line, at), line[at], squares)
            learned += len(masked)
        if learned:
            pieces = range(0, len(net.flat), PIECE)
            values = pa.array([(net.flat[k : k + PIECE] - flat.value[k : k + PIECE]).tolist() for k in pieces], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(range(len(pieces))), pa.int32()), pa.array([float(learned)] * len(pieces)), values], ["piece", "weight", "change"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted mean of the changes of each piece, summed as they come in."""
    sums: dict[int, np.ndarray] = {}
    weights: dict[int, float] = {}
    for batch in batches:
        for piece, weight, change in zip(batch.column("piece").to_pylist(), batch.column("weight").to_pylist(), batch.column("change"), strict=True):
            sums[piece] = sums.get(piece, 0.0) + change.values.to_numpy().astype(np.float64) * weight
            weights[piece] = weights.get(piece, 0.0) + weight
    if sums:
        values = pa.array([(s / weights[p]).tolist() for p, s in sums.items()], pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), values], ["piece", "change"])


def learn(texts: DataFrame, words: Vocabulary) -> np.ndarray:
    """Parameters from all numbered texts. Their size is fixed, whatever the corpus."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(words)
    flat = Network.start(words.counts).flat
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in range(ROUNDS):
        start = spark.sparkContext.broadcast(flat)
        copies = texts.mapInArrow(_train(sent, start, k), "piece int, weight double, change array<float>")
        mean = copies.repartition(n, "piece").mapInArrow(_average, "piece int, change array<float>").toArrow()
        flat = flat.copy()
        for piece, change in zip(mean.column("piece").to_pylist(), mean.column("change"), strict=True):
            flat[piece * PIECE : (piece + 1) * PIECE] += change.values.to_numpy()
    return flat


_HALF_SCORED = "block long, place int, doc_id long, n_words long, log_likelihood double, bucket int, words binary, sizes binary, rows binary, times binary"
_OF_TEXT = {"block": pa.int64(), "place": pa.int32(), "doc_id": pa.int64(), "n_words": pa.int64(), "log_likelihood": pa.float64()}
_OF_BUCKET = {"bucket": pa.int32(), "words": pa.binary(), "sizes": pa.binary(), "rows": pa.binary(), "times": pa.binary()}


def _score(numbers: Broadcast, flat: Broadcast, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the network's sum for each text of a block, then a row for each bucket of the block's words outside the
    vocabulary, packed: the words, in how many of its texts each stands, in which, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _prepare_worker()
        net = Network(flat.value)
        block = TaskContext.get().partitionId() << 32
        for ids, sizes, _, words, seen in _unpacked(batches):
            line, places = _sequences(sizes, numbers.value(words)[seen])
            found = [net.log_probabilities(_around(line, at), line[at]) for at in (places[k : k + SCORED_AT_ONCE] for k in range(0, len(places), SCORED_AT_ONCE))]
            upto = np.concatenate(([0.0], np.cumsum(np.concatenate([np.zeros(0), *found]))))
            ends = np.cumsum(sizes)
            n = len(ids)
            yield _half_scored({"block": [block] * n, "place": range(n), "doc_id": ids, "n_words": sizes, "log_likelihood": upto[ends] - upto[ends - sizes]})
            rare = line[places] >= VOCABULARY - RARE
            pairs, times = np.unique(seen[rare].astype(np.int64) * n + np.repeat(np.arange(n), sizes)[rare], return_counts=True)
            which, first, size = np.unique(pairs // n, return_index=True, return_counts=True)
            outside = [words[k] for k in which.tolist()]
            packed = []
            for bucket, at in _by_bucket(outside, buckets):
                rows, _ = gather(pairs % n, first, size, at)
                often, _ = gather(times, first, size, at)
                packed.append((bucket, pack_words([outside[k] for k in at.tolist()]), *map(pack_numbers, (size[at], rows, often))))
            if packed:
                yield _half_scored({"block": [block] * len(packed), **dict(zip(_OF_BUCKET, zip(*packed, strict=True), strict=True))})
            block += 1

    return run


def _half_scored(columns: dict[str, Iterable]) -> pa.RecordBatch:
    """With nulls in the columns that are not given."""
    types = _OF_TEXT | _OF_BUCKET
    n = len(columns["block"])
    arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, list(types))


_SHARED = "block long, bucket int, sizes binary, rows binary, times binary, log_shares binary"


def _with_shares(rest: np.ndarray) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of one bucket: the blocks' words and the counts of all words; each word's log share in its entry of rest."""

    def run(outside: pa.Table, counts: pa.Table) -> pa.Table:
        index = WordIndex()
        words = [w for row in counts["words"].to_pylist() for w in unpack_words(row)]
        index(words)
        n = np.frombuffer(b"".join(counts["n"].to_pylist()), np.int64)
        share = np.log(n) - np.log(np.maximum(1, rest))[_entries(words)]
        shares = [share[index(unpack_words(row))].tobytes() for row in outside["words"].to_pylist()]
        return outside.drop_columns("words").append_column("log_shares", pa.array(shares, pa.binary()))

    return run


def _add_shares(table: pa.Table) -> pa.Table:
    """Of one block: each text's sum with the log shares of its words outside the vocabulary."""
    of_text = pc.is_valid(table["place"])
    texts, packed = table.filter(of_text).sort_by("place"), table.filter(pc.invert(of_text)).sort_by("bucket")
    sums, n = texts["log_likelihood"].to_numpy().copy(), texts["n_words"].to_numpy()
    for row in packed.select(["sizes", "rows", "times", "log_shares"]).to_pylist():
        sizes, rows, times = (unpack_numbers(row[c]) for c in ("sizes", "rows", "times"))
        sums += np.bincount(rows, np.repeat(np.frombuffer(row["log_shares"]), sizes) * times, len(sums))
    mean = np.round(np.where(n > 0, sums / np.maximum(1, n), 0.0), 4)
    return pa.table({"doc_id": texts["doc_id"], "n_words": texts["n_words"], "log_likelihood": np.round(sums, 2), "score": mean})


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_likelihood, score) for each row of docs (doc_id, text); score is the mean for a word.

    A word outside the vocabulary has the probability of its shared entry times its share in the occurrences of that
    entry's words, from the stored counts of all words. Values are natural logarithms, rounded to 2 and 4 places. Null
    texts, and texts of white space alone, have no words and 0 for both. An empty table gives no rows; other columns
    are not looked at.
    """
    texts = numbered(docs)
    counts = word_counts(texts)
    words = vocabulary(docs, counts)
    flat = learn(texts, words)
    context = docs.sparkSession.sparkContext
    buckets = _buckets(texts)
    half = stored(texts.mapInArrow(_score(context.broadcast(words), context.broadcast(flat), buckets), _HALF_SCORED), "half-scored")
    outside = half.filter("place is null").select("block", "bucket", "words", "sizes", "rows", "times")
    counted = counts.select("bucket", "words", "n")
    shares = outside.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(_with_shares(words.rest), _SHARED)
    both = half.filter("place is not null").select("block", "place", "doc_id", "n_words", "log_likelihood").unionByName(
        shares, allowMissingColumns=True
    )
    return both.groupBy("block").applyInArrow(_add_shares, "doc_id long, n_words long, log_likelihood double, score double")
