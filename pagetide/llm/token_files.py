"""Token ids as ORC files: in ascending order of document, with row indexes and a Bloom filter on the document id."""

from __future__ import annotations

import gc
import os
import string
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagetide.llm.common import stored
from pagetide.llm.words import WordIndex, blocks, column, gather

MODEL = "word_bpe_49k.json"
END_ID = 2
# Documents between two entries of the row index, and the chance of a needless read that the Bloom filter leaves.
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "compression": "zstd"}
SENT_WORDS = 20_000
BATCH_IDS = 1 << 20
# Chunks whose ids a worker keeps at hand for the blocks and tasks after; others are encoded again when they come back.
KEPT_CHUNKS = 600_000


@lru_cache(maxsize=2)
def _tokenizer(model: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_str(model)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for the code points from 256 on."""
    hidden = [b for b in range(256) if not (0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or b >= 0xAE)]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()
# Words of letters below this code point have one form only: composed, and lower-cased letter by letter.
_LATIN = "\u0250"


def _plain(chunk: str) -> tuple[str, ...]:
    """A chunk as parts that the tokenizer encodes alike on their own: a word and the ASCII punctuation after it."""
    if chunk.isascii() and chunk.isalpha():
        return (chunk.lower(),)
    body = chunk.rstrip(string.punctuation)
    if not body.isalpha():
        return (chunk,)
    low = body.lower()
    if body.isascii() or low.isalpha() and max(low) < _LATIN:
        body = low
    elif not low.isalpha():
        return (chunk,)
    return (body,) if len(body) == len(chunk) else (body, chunk[len(body) :])


def _encoded(words: list[str], tokenizer: Tokenizer) -> list[list[int]]:
    """Ids of each word. Lower-case Latin words pass the normalizer and the splitter as they are, so they go to the
    model itself, in the byte-level alphabet; all others go through the whole tokenizer."""
    ids: list[list[int]] = [[]] * len(words)
    merge = tokenizer.model.tokenize
    others = []
    for k, word in enumerate(words):
        if not (word.isalpha() and word.islower()):
            others.append(k)
        elif word.isascii():
            ids[k] = [t.id for t in merge(word)]
        elif max(word) < _LATIN:
            ids[k] = [t.id for t in merge(word.encode().decode("latin-1").translate(_LETTERS))]
        else:
            others.append(k)
    for at in range(0, len(others), SENT_WORDS):
        part = others[at : at + SENT_WORDS]
        for k, e in zip(part, tokenizer.encode_batch_fast([words[k] for k in part], add_special_tokens=False), strict=True):
            ids[k] = e.ids
    return ids


def _ids_of(chunks: list[bytes], tokenizer: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the chunks, one after the other, and how many each has. A text's white space ends every token, so the ids
    of a text are those of its chunks between white space."""
    # Chunks hold no white space.
    parts = list(map(_plain, b" ".join(chunks).decode().split(" "))) if chunks else []
    index = WordIndex()
    order = index(list(chain.from_iterable(parts)))
    ids = _encoded(index.words(), tokenizer)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
    found, per_part = gather(flat, np.cumsum(sizes) - sizes, sizes, order)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    upto = np.concatenate(([0], np.cumsum(per_part)))[np.concatenate(([0], ends)).astype(np.int64)]
    return found, np.diff(upto)


class Known:
    """Ids of chunks as `_ids_of` gives them; those of chunks met before are at hand. Beyond KEPT_CHUNKS only the
    chunks of the last block stay, as far as they fit, those that had come back first."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self._tokenizer = tokenizer
        self._ids: dict[bytes, bytes] = {}

    def __call__(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self._ids.get(c) for c in chunks]
        new = [k for k, known in enumerate(ids) if known is None]
        flat, sizes = _ids_of([chunks[k] for k in new], self._tokenizer)
        ends = (np.cumsum(sizes) * 4).tolist()
        raw = flat.tobytes()
        if len(self._ids) + len(new) > KEPT_CHUNKS:
            self._ids = {c: known for c, known in zip(chunks, ids, strict=True) if known is not None}
        room = max(0, KEPT_CHUNKS - len(self._ids))
        for n, (k, start, end) in enumerate(zip(new, [0, *ends], ends, strict=False)):
            ids[k] = raw[start:end]
            if n < room:
                self._ids[chunks[k]] = ids[k]
        return np.frombuffer(b"".join(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


@lru_cache(maxsize=1)
def _known(model: str) -> Known:
    return Known(_tokenizer(model))


def _encode(model: Broadcast, bounds: np.ndarray, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Millions of small lists come and go without a cycle among them; looking for cycles took a fifth of the time.
        gc.disable()
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(model.value)
        for rows, texts in blocks(batches):
            index = WordIndex()
            sequences = [index(text.encode().split()) for text in texts]
            ids, sizes = known(index.words())
            # The end id is one more "chunk".
            ids, sizes = np.append(ids, np.uint32(end_id)), np.append(sizes, 1)
            starts = np.cumsum(sizes) - sizes
            end = np.array([len(sizes) - 1], np.uint32)
            doc_ids, hashes = column(rows, "doc_id"), column(rows, "text_hash")
            part = _part(doc_ids, hashes, bounds)
            doc = 0
            while doc < len(texts):
                last, words = doc, 0
                while last < len(texts) and words < BATCH_IDS // 2:
                    words += len(sequences[last]) + 1
                    last += 1
                chunks = np.concatenate([x for k in range(doc, last) for x in (sequences[k], end)])
                found, size = gather(ids, starts, sizes, chunks)
                ends = np.cumsum([len(sequences[k]) + 1 for k in range(doc, last)])
                offsets = np.concatenate(([0], np.cumsum(size)[ends - 1]))
                values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[doc:last], pa.int32()), doc_ids[doc:last], hashes[doc:last], values], ["part", "doc_id", "text_hash", "ids"]
                )
                doc = last

    return run


def _part(doc_ids: pa.Array, hashes: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """The file of each row: the number of bounds below its id; rows of an id that is several bounds at once are dealt
    out over those by their hash. Null ids come first."""
    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    share = (hashes.to_numpy(zero_copy_only=False).astype(np.float64) / 2.0**64 + 0.5).clip(0, 1 - 2.0**-52)
    part = low + np.floor(share * (high - low + 1) * (high > low)).astype(np.int64)
    return np.where(doc_ids.is_null().to_numpy(zero_copy_only=False), 0, part)


def write(docs: DataFrame, path: str, model_path: str | None = None, end_id: int = END_ID) -> None:
    """Write (doc_id, text_hash, ids) of docs (doc_id, text) as ORC files below path, one for each range of ids.

    Files and the rows within are in ascending order of doc_id, null first, equal ids by a hash of their texts. ids are
    those of the tokenizer file without added begin and end, then end_id; null and empty texts have end_id alone.
    An empty table writes files without rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    with open(model_path or public_tokenizers.path(MODEL), encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    shares = [k / n for k in range(1, n)]
    bounds = (rows.agg(F.percentile_approx("doc_id", shares, 100 * n).alias("b")).first()["b"] if shares else None) or []
    encoded = rows.mapInArrow(_encode(model, np.array(bounds, np.int64), end_id), "part int, doc_id long, text_hash long, ids array<int>")
    dealt = encoded.repartitionById(n, F.col("part")).sortWithinPartitions("part", "doc_id", "text_hash")
    dealt.write.options(**ORC_OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_id, text_hash and ids from the files; stripes are read in parallel, filters on doc_id skip stripes."""
    return spark.read.schema("part int, doc_id long, text_hash long, ids array<int>").orc(path)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat, offsets = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("part"), batch.column("doc_id"), batch.column("text_hash"), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())],
            ["part", "doc_id", "text_hash", "n_tokens", "ids_crc32"],
        )


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files: start is the number of ids before it."""
    rows = stored(read(spark, path).mapInArrow(_checked, "part int, doc_id long, text_hash long, n_tokens long, ids_crc32 long"), "listing")
    # One row per file: the parts are as many as the session's shuffle partitions at most.
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return rows.join(F.broadcast(before), "part").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
