"""Language ID by cross-parsing: a text is cut into the longest phrases that a language's sample contains.

A suffix automaton of each language's sample gives the longest match from any place. The language whose sample needs
the fewest phrases, each weighed with the bits that a place in the sample takes, is the nearest. Texts are parsed many
at a time: segments of all texts of a batch step through the automata of all languages together, as array lookups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetide.llm.common import releasing, remainder

# The fit takes at most so many distinct texts of each language, in order of a hash, whatever the number of languages,
# and of each so many characters at a place that a hash chooses.
SAMPLE_TEXTS = 64
SAMPLE_CHARS = 512
# Automata of all languages are tables up to so many cells together, beyond that sorted lists of their edges.
TABLE_CELLS = 1 << 25
FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"
# A text whose phrases in its best language are shorter than this, in bytes, is in no language that was learned.
SHORTEST_PHRASE = 2.0
# A text is parsed in segments of so many bytes, each from its start; so many bytes go at once.
SEGMENT = 512
LANE_BYTES = 1 << 22
Sample = tuple[tuple[str, bytes], ...]


def normal(text: str) -> bytes:
    """Lower case, and each run of ASCII characters other than letters as one blank."""
    return b" ".join(text.lower().encode().translate(_ASCII).split())


_ASCII = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def suffix_automaton(sample: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of the sample; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in sample:
        state = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = state
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return edges


class Parser:
    """The automata of all languages: from states (rows) by the bytes that occur in any sample (columns)."""

    def __init__(self, sample: Sample, cells: int = TABLE_CELLS):
        self.languages = [lang for lang, _ in sample]
        self.bits = np.array([np.log2(len(text) + 1) for _, text in sample])
        used = sorted(set(b"".join(text for _, text in sample)))
        self.code = np.full(256, len(used), np.int32)
        self.code[used] = np.arange(len(used))
        self.width = len(used) + 1
        # Row 0 is a dead end, row 1 the start; states are row numbers times the width.
        self.start = self.width
        # For each language: places in ascending order, and where each leads.
        self._edges = []
        rows_used = 0
        for _, text in sample:
            edges = suffix_automaton(text)
            rows = np.repeat(np.arange(len(edges)), [len(e) for e in edges]) + 1
            columns = self.code[np.fromiter((c for e in edges for c in e), np.int64)]
            to = np.fromiter((t for e in edges for t in e.values()), np.int64) + 1
            at = rows * self.width + columns
            order = np.argsort(at)
            self._edges.append((at[order].astype(np.int32), (to * self.width)[order].astype(np.int32), len(edges) + 1))
            rows_used += len(edges) + 1
        self._tables = None
        if rows_used * self.width <= cells:
            self._tables = []
            for at, to, n in self._edges:
                table = np.zeros(n * self.width, np.int32)
                table[at] = to
                self._tables.append(table)

    def _step(self, language: int, places: np.ndarray) -> np.ndarray:
        """The states that follow places (state plus byte); 0 where there is none."""
        if self._tables is not None:
            return self._tables[language][places]
        at, to, _ = self._edges[language]
        k = np.minimum(np.searchsorted(at, places), len(at) - 1)
        return np.where(at[k] == places, to[k], 0)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns); texts are normalised."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        n = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        begin = np.repeat(np.cumsum(lengths) - lengths, n) + within * SEGMENT
        size = np.minimum(SEGMENT, np.repeat(lengths, n) - within * SEGMENT)
        codes = self.code[np.frombuffer(b"".join(texts), np.uint8)]
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        found = np.zeros((len(texts), len(self.languages)), np.int64)
        start = self.start
        for column in range(len(self.languages)):
            state = np.full(len(begin), start, np.int32)
            count = np.ones(len(begin), np.int64)
            for step in range(int(size[0]) if len(size) else 0):
                live = int(np.searchsorted(-size, -step, "left"))
                c = codes[begin[:live] + step]
                moved = self._step(column, state[:live] + c)
                stuck = np.flatnonzero(moved == 0)
                # A phrase ends before this byte, and the next one starts with it; an unknown byte is a phrase of its own.
                again = self._step(column, start + c[stuck])
                # Stuck at the start of a phrase means that the byte itself is unknown: it has been counted.
                fresh = state[stuck] == start
                count[stuck] += ~fresh
                unknown = again == 0
                count[stuck] += unknown
                moved[stuck] = np.where(unknown, start, again)
                state[:live] = moved
            # After a byte of its own at the very end no further phrase has begun.
            count -= state == start
            found[:, column] = np.bincount(owner, count, len(texts)).astype(np.int64)
        return found

    def best(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and mean bytes of a phrase in it. Equal costs: the first language in code-point order."""
        count = self.phrases(texts)
        cost = count * self.bits
        first = cost.argmin(axis=1)
        rows = np.arange(len(texts))
        lowest = cost[rows, first]
        cost[rows, first] = np.inf
        second = cost.min(axis=1, initial=np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(np.isinf(second), 1.0, np.where(lowest + second > 0, second / (lowest + second), 0.5))
        lengths = np.fromiter(map(len, texts), np.float64, len(texts))
        return [self.languages[k] for k in first], score, lengths / np.maximum(1, count[rows, first])


def learn(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> Sample:
    """A sample of each lang value of docs (doc_id, text, lang): bounded, so the driver may hold it.

    Rows with null lang, null text or a held-out id take no part. Copies of a text in a language count once: their keys
    are merged before they are shuffled, and SAMPLE_TEXTS keys of each language kept before they are sorted.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("key"), remainder("doc_id", folds).alias("fold"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("fold") != held_out))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = rows.select("lang", "key").distinct().withColumn("place", place).filter(F.col("place") <= SAMPLE_TEXTS)
    last = F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)
    part = F.col("text").substr((F.pmod(F.xxhash64(F.lit("place"), "text"), last) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    # At most SAMPLE_TEXTS keys of each language go to the rows.
    kept = rows.join(F.broadcast(chosen), ["lang", "key"]).groupBy("lang", "place").agg(F.min(part).alias("text"))
    texts: dict[str, list[bytes]] = {}
    for row in kept.orderBy("lang", "place").toLocalIterator():
        texts.setdefault(row["lang"], []).append(normal(row["text"]))
    # Each text's end is kept apart from the next one's start by a blank.
    sample = ((lang, b" ".join(parts)) for lang, parts in sorted(texts.items()))
    return tuple((lang, text) for lang, text in sample if text)


def _letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _predicted(texts: list[str | None], parser: Parser, lane: int = LANE_BYTES) -> tuple[list[str], list[float], list[float]]:
    langs, scores, phrase = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    if not parser.languages:
        return langs, scores, phrase
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0

    def flush() -> None:
        for k, lang, score, length in zip(rows, *parser.best(parts), strict=True):
            langs[k], scores[k], phrase[k] = lang, float(score), float(length)

    for k, text in enumerate(texts):
        if _letters(text):
            rows.append(k)
            parts.append(normal(text))
            size += len(parts[-1])
            if size >= lane:
                flush()
                rows, parts, size = [], [], 0
    if rows:
        flush()
    return langs, scores, phrase


def _predict(sample: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Built for each task, so that a worker does not keep it for the stages after.
        parser = Parser(sample.value)
        for batch in batches:
            langs, scores, _ = _predicted(batch.column("text").to_pylist(), parser)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang).

    score is the share of the second best language's cost in the sum of the two best: 0.5 for a tie, 1 where only one
    language was learned. `und` with score 0: text null or without a letter, or no language learned. Null ids are
    not held out and, without an id to hash, not learned from. An empty table gives no rows; other columns are not looked at.
    """
    sample = docs.sparkSession.sparkContext.broadcast(learn(docs))
    held = F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text")
    return rows.mapInArrow(_predict(sample), "doc_id long, held_out boolean, lang_pred string, score double")


def _accept(sample: Broadcast, shortest: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(sample.value)
        for batch in batches:
            langs, _, phrase = _predicted(batch.column("text").to_pylist(), parser, LANE_BYTES // 4)
            keep = [lang != UNDETERMINED and length >= shortest for lang, length in zip(langs, phrase, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def in_a_language(docs: DataFrame, shortest: float = SHORTEST_PHRASE) -> DataFrame:
    """The rows of docs in a learned language; columns as in docs. Out go texts that are null or have no letter, and
    texts whose phrases average less than `shortest` bytes in their best language, and all texts when there was no
    language to learn; an empty table gives no rows."""
    sample = docs.sparkSession.sparkContext.broadcast(learn(docs))
    return docs.mapInArrow(releasing(_accept(sample, shortest)), docs.schema)
