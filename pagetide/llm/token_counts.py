"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a block of texts lie behind one another in one array of symbols. In each round every
sequence merges all places of the pair that has its lowest rank; sequences without a pair that merges drop out.
What survives is counted, and a text has the sum of its pre-tokens.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm.words import WordIndex, blocks, column

MODEL = "byte_bpe_50k.json"
LIMIT = 1024
_NEVER = np.iinfo(np.int32).max


class Merges:
    """The merges of a byte-level BPE model file as arrays sorted by pair."""

    def __init__(self, model: str):
        spec = json.loads(model)
        vocabulary = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        # Printable Latin-1 bytes stand for themselves in the file, the others for the code points from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.symbols = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        self.size = max(vocabulary.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64).reshape(-1)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64).reshape(-1)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), _NEVER, np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NEVER)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        left = lengths.copy()
        symbols = self.symbols[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(symbols) > 1:
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            rank = self.rank(symbols[inside] * self.size + symbols[inside + 1])
            inside, rank = inside[rank < _NEVER], rank[rank < _NEVER]
            if not len(inside):
                break
            first = np.flatnonzero(np.concatenate(([True], owner[inside[1:]] != owner[inside[:-1]])))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(rank))))
            at, rank = inside[rank == lowest], rank[rank == lowest]
            # In a run of one repeated symbol every second place merges, from the left.
            k = np.arange(len(at))
            new_run = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])))
            even = (k - np.maximum.accumulate(np.where(new_run, k, 0))) % 2 == 0
            at, rank = at[even], rank[even]
            symbols[at] = self.merged[rank]
            left -= np.bincount(owner[at], minlength=len(left))
            # Only sequences that merged go on, without the second symbols.
            live = np.zeros(len(left), bool)
            live[owner[at]] = True
            stay = live[owner]
            stay[at + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return left


@lru_cache(maxsize=2)
def _merges(model: str) -> Merges:
    return Merges(model)


def _counts(model: Broadcast, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(model.value)
        find = regex.compile(public_tokenizers.PATTERN).findall
        special = regex.compile("|".join(map(regex.escape, merges.special)) or r"(?!)")
        for rows, texts in blocks(batches):
            index = WordIndex()
            parts, extra = [], np.zeros(len(texts), np.int64)
            for k, text in enumerate(texts):
                pieces = special.split(text) if "<" in text or len(merges.special) > 1 else [text]
                extra[k] = len(pieces) - 1
                parts.append([index(find(piece)) for piece in pieces])
            left = merges.count([w.encode() for w in index.words()])
            n_tokens = extra + np.array([sum(int(left[p].sum()) for p in own) for own in parts], np.int64).reshape(-1)
            n_bytes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [column(rows, "doc_id"), n_bytes, pa.array(n_tokens), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text); path: a byte-level BPE model file.

    An added token of the file inside a text counts as one token and parts the text, as the file's library has it by
    default. Null and empty texts have 0 bytes and tokens. An empty table gives no rows; other columns are not looked at.
    """
    with open(path or public_tokenizers.path(MODEL), encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_counts(model, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
