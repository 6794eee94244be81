"""Blocks of texts as numbered words: each distinct word of a block once, texts as sequences of numbers."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard

# A block ends when its texts reach this many characters; a longer text is a block of its own.
BLOCK_CHARS = 1 << 24


class WordIndex:
    """Numbers words in order of first appearance."""

    def __init__(self) -> None:
        self._numbers: dict = defaultdict(count().__next__)

    def __call__(self, words: list) -> np.ndarray:
        return np.fromiter(map(self._numbers.__getitem__, words), np.uint32, len(words))

    def words(self) -> list:
        return list(self._numbers)


def blocks(batches: Iterable[pa.RecordBatch], chars: int = BLOCK_CHARS) -> Iterator[tuple[list[pa.RecordBatch], list[str]]]:
    """Consecutive rows with their texts (null: empty), cut where the texts reach `chars` characters."""
    rows: list[pa.RecordBatch] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        start = 0
        for k, text in enumerate(batch.column("text").to_pylist()):
            texts.append(text or "")
            size += len(texts[-1])
            if size >= chars:
                rows.append(batch.slice(start, k + 1 - start))
                yield rows, texts
                rows, texts, size, start = [], [], 0, k + 1
        if start < batch.num_rows:
            rows.append(batch.slice(start))
    if rows:
        yield rows, texts


def column(rows: list[pa.RecordBatch], name: str) -> pa.Array:
    """A column of a block's rows as one array."""
    return pa.concat_arrays([r.column(name) for r in rows])


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[starts[i] : starts[i] + lengths[i]] for i in index, one after the other, and the length of each."""
    size = lengths[index]
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[index] - (ends - size), size)
    return values[at], size


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed by byte planes."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(planes)


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), "<u4", len(words))
    head = np.array([len(words)], "<u4").tobytes() + lengths.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n).tolist()
    return [raw[i:j] for i, j in zip([4 + 4 * n, *ends], ends, strict=False)]
