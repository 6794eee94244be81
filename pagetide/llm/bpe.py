"""Byte-level BPE encoding and decoding by a shuffle of distinct words.

Texts are cut into pre-tokens. A block of texts keeps its sequence of word numbers, the positions, at home, in a table
bucketed by block; only its distinct words travel, dealt out by a hash of the word. Where all blocks' copies of a word
meet it is encoded once, and the ids go back to the blocks, which put them in the words' places.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import releasing, scratch
from pagetide.llm.words import BLOCK_CHARS, WordIndex, blocks, column, gather, pack_numbers, pack_words, unpack_numbers, unpack_words

RANKS = "byte_bpe_multi_50k.tiktoken"
# Distinct words whose ids a task keeps at hand; beyond that it starts anew and encodes a word again when it comes back.
KEPT_WORDS = 300_000
# Ids in one output batch.
BATCH_IDS = 1 << 20
_BLOCK = "block long, doc_ids array<long>, lengths array<int>, numbers binary, spread binary, words array<struct<bucket:int,data:binary>>"


def rank_file(path: str | None = None) -> bytes:
    """The contents of a rank file; some hundred thousand lines at most, a fixed vocabulary."""
    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def _ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}


@lru_cache(maxsize=2)
def _word_encoding(lines: bytes) -> tiktoken.Encoding:
    """Merges within a whole string: the strings given to it are pre-tokens already."""
    return tiktoken.Encoding("word", pat_str=r"[\s\S]+", mergeable_ranks=_ranks(lines), special_tokens={})


@lru_cache(maxsize=2)
def _token_bytes(lines: bytes) -> list[bytes]:
    """The token-byte table: bytes by id, empty where an id is free."""
    ranks = _ranks(lines)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _to_blocks(buckets: int, pattern: str, chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        number = TaskContext.get().partitionId() << 32
        for rows, texts in blocks(batches, chars):
            index = WordIndex()
            sequences = [index(find(text)) for text in texts]
            words = [w.encode() for w in index.words()]
            bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(buckets)
            order = np.argsort(bucket, kind="stable")
            present, first = np.unique(bucket[order], return_index=True)
            packs = [
                {"bucket": int(b), "data": pack_words([words[k] for k in part])}
                for b, part in zip(present, np.split(order, first[1:]) if len(first) else [], strict=True)
            ]
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "block": number, "doc_ids": column(rows, "doc_id").to_pylist(), "lengths": [len(s) for s in sequences],
                        "numbers": pack_numbers(np.concatenate(sequences)), "spread": pack_numbers(bucket), "words": packs,
                    }
                ],
                pa.schema(
                    [
                        ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("numbers", pa.binary()),
                        ("spread", pa.binary()), ("words", pa.list_(pa.struct([("bucket", pa.int32()), ("data", pa.binary())]))),
                    ]
                ),
            )
            number += 1

    return run


def _encode_words(lines: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _word_encoding(lines.value).encode_ordinary
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for data in batch.column("data"):
                words = unpack_words(data.as_py())
                if len(known) > KEPT_WORDS:
                    known.clear()
                for word in words:
                    if word not in known:
                        known[word] = np.array(encode(word.decode()), "<u4").tobytes()
                ids = [known[word] for word in words]
                sizes = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                out.append({"sizes": pack_numbers(sizes), "ids": pack_numbers(np.frombuffer(b"".join(ids), "<u4"))})
            packed = pa.array(out, pa.struct([("sizes", pa.binary()), ("ids", pa.binary())]))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), packed], ["block", "bucket", "packed"])
        # The worker goes on to other stages, which have no use for the encoder.
        _word_encoding.cache_clear()
        _ranks.cache_clear()

    return run


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of the block's words, put in the places of the words."""
    for batch in batches:
        for k in range(batch.num_rows):
            doc_ids, lengths, numbers, spread, packs = (batch.column(c)[k] for c in ("doc_ids", "lengths", "numbers", "spread", "packs"))
            packs = sorted(packs.as_py() or [], key=lambda p: p["bucket"])
            none = np.zeros(0, np.uint32)
            sizes = np.concatenate([none, *(unpack_numbers(p["packed"]["sizes"]) for p in packs)]).astype(np.int64)
            ids = np.concatenate([none, *(unpack_numbers(p["packed"]["ids"]) for p in packs)])
            place = np.argsort(unpack_numbers(spread.as_py()), kind="stable")
            starts, by_number = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            starts[place], by_number[place] = np.cumsum(sizes) - sizes, sizes
            sequence, lengths = unpack_numbers(numbers.as_py()), lengths.values.to_numpy().astype(np.int64)
            ends = np.cumsum(lengths)
            per_doc = np.concatenate(([0], np.cumsum(by_number[sequence])))[np.concatenate(([0], ends))]
            doc = 0
            while doc < len(lengths):
                last = max(doc + 1, int(np.searchsorted(per_doc, per_doc[doc] + BATCH_IDS, "right")) - 1)
                part, _ = gather(ids, starts, by_number, sequence[ends[doc] - lengths[doc] : ends[last - 1]])
                lists = pa.ListArray.from_arrays(pa.array(per_doc[doc : last + 1] - per_doc[doc], pa.int32()), pa.array(part.view(np.int32)))
                yield pa.RecordBatch.from_arrays([doc_ids.values[doc:last], lists], ["doc_id", "ids"])
                doc = last


def encode(
    docs: DataFrame, lines: bytes | None = None, pattern: str = public_tokenizers.PATTERN, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, ids) for each row of docs (doc_id, text), ids as int array; lines: the contents of a rank file.

    Each match of the pattern is encoded for itself, special tokens are not known. Null and empty texts have no ids.
    Rows may repeat and ids may be null. An empty table gives no rows; other columns are not looked at. Smaller blocks
    take less memory, and let more copies of a word travel.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(lines or rank_file())
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 16)
    table = f"bpe_blocks_{uuid.uuid4().hex}"
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(_to_blocks(n, pattern, block_chars)), _BLOCK)
    found.write.bucketBy(n, "block").option("path", scratch(spark, "bpe")).format("parquet").saveAsTable(table)
    stored = spark.table(table)
    words = stored.select("block", F.explode("words").alias("w")).select("block", "w.bucket", "w.data")
    encoded = words.repartition(n, "bucket").mapInArrow(releasing(_encode_words(sent)), "block long, bucket int, packed struct<sizes:binary,ids:binary>")
    packs = encoded.groupBy("block").agg(F.collect_list(F.struct("bucket", "packed")).alias("packs"))
    joined = stored.select("block", "doc_ids", "lengths", "numbers", "spread").join(packs, "block", "left")
    return joined.mapInArrow(releasing(_reassemble), "doc_id long, ids array<int>")


def _decoded(ids: list[int], table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def _decode(lines: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(lines.value)
        for batch in batches:
            decoded = pa.array([_decoded(ids or [], table) for ids in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), decoded], ["doc_id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, lines: bytes | None = None) -> DataFrame:
    """encoded (doc_id, ids) with the bytes that the ids stand for, by the token-byte table; null ids: no bytes."""
    sent = encoded.sparkSession.sparkContext.broadcast(lines or rank_file())
    return encoded.select("doc_id", "ids").mapInArrow(_decode(sent), "doc_id long, ids array<int>, decoded binary")


def _digests(lines: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(lines.value)
        for batch in batches:
            lists = batch.column("ids")
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            parts = [flat[i:j] for i, j in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(p) for p in parts], pa.int64()),
                    pa.array([hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts], pa.string()),
                    pa.array([hashlib.sha256(_decoded(p.tolist(), table)).hexdigest() for p in parts], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def digests(encoded: DataFrame, lines: bytes | None = None) -> DataFrame:
    """Of encoded (doc_id, ids): n_tokens, and the SHA-256 of the ids and of the bytes they decode to."""
    sent = encoded.sparkSession.sparkContext.broadcast(lines or rank_file())
    return encoded.mapInArrow(releasing(_digests(sent)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
