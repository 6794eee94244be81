"""Byte-level BPE with certain cuts: two neighbouring bytes that stand together in no token of the vocabulary.

No merge can join such a pair, since every symbol that merging makes is a token. So a text falls into fragments that
are encoded each on its own, and the ids of the text are those of its fragments, one after the other. A fragment is
encoded once for a worker, however often it stands in the texts.

The library cuts a text by a pattern before it merges, and what the pattern makes of a place may hang on what stands
around it. The first cuts are therefore only those certain pairs at which the pattern ends a match, or stays within
a run of one kind of character, on either side alone just as in the whole text (`_outer`). The pattern and the
remaining certain cuts are applied inside the distinct fragments.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagetide.llm.words import WordIndex, blocks, column, gather

MODEL = "byte_bpe_50k.json"
# Characters of texts that are cut at a time; a longer text is a block of its own and is cut whole.
BLOCK_CHARS = 1 << 22
# Fragments whose ids a worker keeps at hand; beyond that it starts anew and encodes a fragment again when it comes back.
KEPT_FRAGMENTS = 400_000
# Longer fragments are not kept.
KEPT_BYTES = 64
BATCH_IDS = 1 << 20
# ASCII white space by all accounts, and the separators that some libraries count as white space too.
_SPACE, _SEPARATORS = b"\t\n\x0b\x0c\r ", b"\x1c\x1d\x1e\x1f"


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for the code points from 256 on."""
    shown = [b for b in range(256) if 0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or b >= 0xAE]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Cutter:
    """A byte-level BPE file with its table of cuts and its table of token bytes."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(model)
        letters = _byte_letters()
        byte_of = {ord(c): b for b, c in enumerate(letters)}
        own = {token: bytes(map(byte_of.__getitem__, map(ord, token))) for token in spec["model"]["vocab"] if all(ord(c) in byte_of for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*spec["model"]["vocab"].values(), *self.special.values()], default=-1))
        for token, number in spec["model"]["vocab"].items():
            self.bytes[number] = own.get(token, token.encode())
        for token, number in self.special.items():
            self.bytes[number] = token.encode()
        joined = np.zeros((256, 256), bool)
        for token in own.values():
            pairs = np.frombuffer(token, np.uint8)
            joined[pairs[:-1], pairs[1:]] = True
        self.certain = ~joined
        self.outer = self.certain & _outer()
        self._letters = dict(enumerate(letters))
        self._merge = Tokenizer.from_str(model).model.tokenize
        self._match = regex.compile(public_tokenizers.PATTERN).findall
        self._split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.known: dict[bytes, bytes] = {}

    def encode(self, fragments: list[bytes]) -> list[bytes]:
        """Ids of each fragment: the pattern's matches, cut at all certain pairs; each distinct piece by the model alone."""
        data = b"".join(fragments)
        if not data:
            return [b""] * len(fragments)
        lengths = np.fromiter((len(m.encode()) for f in fragments for m in self._match(f.decode())), np.int64)
        values = np.frombuffer(data, np.uint8)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = self.certain[values[:-1], values[1:]]
        cut[0] = cut[np.cumsum(lengths)] = True
        places = np.flatnonzero(cut)
        letters, edges = data.decode("latin-1").translate(self._letters), places.tolist()
        index = WordIndex()
        numbers = index([letters[i:j] for i, j in zip(edges, edges[1:], strict=False)])
        found = [[t.id for t in self._merge(piece)] for piece in index.words()]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        ids, per_piece = gather(flat, np.cumsum(sizes) - sizes, sizes, numbers)
        ends = np.cumsum(np.fromiter(map(len, fragments), np.int64, len(fragments)))
        upto = (4 * np.concatenate(([0], np.cumsum(per_piece)))[np.searchsorted(places, ends)]).tolist()
        packed = ids.astype("<u4").tobytes()
        return [packed[i:j] for i, j in zip([0, *upto], upto, strict=False)]

    def ids_of(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the fragments, one after the other, and how many each has."""
        if len(self.known) > KEPT_FRAGMENTS:
            self.known.clear()
        new = [f for f in fragments if f not in self.known]
        self.known.update(zip(new, self.encode(new), strict=True))
        lists = list(map(self.known.__getitem__, fragments))
        for fragment in new:
            if len(fragment) > KEPT_BYTES:
                del self.known[fragment]
        return np.frombuffer(b"".join(lists), "<u4"), np.fromiter(map(len, lists), np.int64, len(lists)) // 4

    def parts(self, text: str) -> tuple[list[str], list[int]]:
        """The text between special tokens, and the ids of the special tokens between these parts."""
        if not any(token in text for token in self.special):
            return [text], []
        return self._split.split(text), [self.special[token] for token in self._split.findall(text)]


def _outer() -> np.ndarray:
    """Pairs of bytes at which the pattern works alike on the whole text and on the two sides alone.

    After white space the pattern looks at what follows: only more ASCII white space may be cut off there, which splits
    the run where a certain pair splits it anyhow. After another ASCII character every pair may be cut at its boundary
    but those around an apostrophe, which may begin a contraction (fixed by the pattern: 's 't 're 've 'm 'll 'd).
    A byte that goes on a character never begins a side.
    """
    left, right = np.arange(256)[:, None], np.arange(256)[None, :]
    space, odd = (np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for chars in (_SPACE, _SEPARATORS))
    solid = (left < 0x80) & ~(space | odd)[:, None] & (left != ord("'"))
    starts = (right < 0x80) | (right >= 0xC0)
    safe = solid & starts
    alnum = np.array([b < 0x80 and chr(b).isalnum() for b in range(256)])
    safe[~alnum, ord("'")] = False
    for a, b in ("re", "ve", "ll"):
        safe[ord(a), ord(b)] = False
    return safe | space[None, :]


@lru_cache(maxsize=1)
def _cutter(model: str) -> Cutter:
    return Cutter(model)


def _numbered(cutter: Cutter, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct fragments of the texts, the sequence of their numbers, how many each text has, and special ids.

    A special token stands in the sequence as a fragment of its own, with its id; ordinary fragments have -1 there.
    """
    index = WordIndex()
    data, marks = [], []
    for k, text in enumerate(texts):
        parts, specials = cutter.parts(text)
        for part, number in zip(parts, [*specials, -1], strict=True):
            data.append(part.encode())
            marks.append((k, number))
    joined = np.frombuffer(b"".join(data), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
    cut = np.zeros(len(joined) + 1, bool)
    if len(joined) > 1:
        cut[1:-1] = cutter.outer[joined[:-1], joined[1:]]
    cut[0] = cut[ends] = True
    places = np.flatnonzero(cut)
    raw = joined.tobytes()
    edges = places.tolist()
    numbers = index([raw[i:j] for i, j in zip(edges, edges[1:], strict=False)]) if len(joined) else np.zeros(0, np.uint32)
    upto = np.searchsorted(places, ends)
    starts = np.concatenate(([0], upto[:-1])).astype(np.int64)
    # A fragment that is a special token follows the last fragment of the part before it.
    owner = np.repeat(np.fromiter((k for k, _ in marks), np.int64, len(marks)), upto - starts)
    special = np.full(len(numbers), -1, np.int64)
    extra = [(int(end), k, number) for end, (k, number) in zip(upto, marks, strict=True) if number >= 0]
    if extra:
        at = [end for end, _, _ in extra]
        numbers, special = np.insert(numbers, at, 0), np.insert(special, at, [number for _, _, number in extra])
        owner = np.insert(owner, at, [k for _, k, _ in extra])
    sizes = np.bincount(owner, minlength=len(texts))
    return index.words(), numbers, sizes, special


def _encode(model: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter(model.value)
        for rows, texts in blocks(batches, BLOCK_CHARS):
            fragments, numbers, sizes, special = _numbered(cutter, texts)
            ids, lengths = cutter.ids_of(fragments)
            # Special tokens are further "fragments" of one id each.
            present = np.unique(special[special >= 0])
            numbers = np.where(special >= 0, len(fragments) + np.searchsorted(present, special), numbers).astype(np.int64)
            ids, lengths = np.concatenate([ids, present.astype(np.uint32)]), np.concatenate([lengths, np.ones(len(present), np.int64)])
            starts = np.cumsum(lengths) - lengths
            ends = np.cumsum(sizes)
            per_doc = np.concatenate(([0], np.cumsum(lengths[numbers])))[np.concatenate(([0], ends))]
            doc_ids, doc = column(rows, "doc_id"), 0
            while doc < len(texts):
                last = max(doc + 1, int(np.searchsorted(per_doc, per_doc[doc] + BATCH_IDS, "right")) - 1)
                found, _ = gather(ids, starts, lengths, numbers[ends[doc] - sizes[doc] : ends[last - 1]])
                lists = pa.ListArray.from_arrays(pa.array(per_doc[doc : last + 1] - per_doc[doc], pa.int32()), pa.array(found.view(np.int32)))
                yield pa.RecordBatch.from_arrays([doc_ids[doc:last], lists], ["doc_id", "ids"])
                doc = last

    return run


def _model(docs: DataFrame, path: str | None) -> Broadcast:
    """The model file, some megabytes at most, read on the driver."""
    with open(path or public_tokenizers.path(MODEL), encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) for each row of docs (doc_id, text), ids as int array; path: a byte-level BPE model file whose
    pattern is the published one and whose added tokens are taken literally.

    An added token inside a text gives its own id. Null and empty texts have no ids. Rows may repeat and ids of documents
    may be null. An empty table gives no rows; other columns are not looked at. No row is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encode(_model(docs, path)), "doc_id long, ids array<int>")


def _decoded(ids: list[int], table: list[bytes]) -> str:
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")


def _decode(model: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _cutter(model.value).bytes
        for batch in batches:
            texts = pa.array([_decoded(ids or [], table) for ids in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), texts], ["doc_id", "ids", "text"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (doc_id, ids) with the text that the ids stand for, special tokens included; bytes that are no UTF-8 give
    replacement characters, null ids the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(_model(encoded, path)), "doc_id long, ids array<int>, text string")


def _digests(model: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _cutter(model.value).bytes
        for batch in batches:
            lists = batch.column("ids")
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            parts = [flat[i:j] for i, j in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(p) for p in parts], pa.int64()),
                    pa.array([hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts], pa.string()),
                    pa.array([hashlib.sha256(_decoded(p.tolist(), table).encode()).hexdigest() for p in parts], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Of encoded (doc_id, ids): n_tokens, and the SHA-256 of the ids and of the text that they decode to."""
    return encoded.mapInArrow(_digests(_model(encoded, path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
