"""Media columns: payloads stored by digest, once in each task, as greyscale images in tar shards.

Rows hold digest, shard, offset and length. Metadata columns come from the first bytes of a member, read by range;
the samples are read only where they are asked for.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import scratch, stored

# Samples of a line of the image; payloads are padded with blanks to a positive multiple.
WIDTH = 192
PAD = 0x20
# A shard is closed when it reaches this size.
SHARD_BYTES = 64 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Signature, length and name of the header chunk, and the fields up to the colour type.
HEADER_BYTES = 8 + 8 + 10
_GRID = 8


def payload(text: str | None) -> bytes:
    """UTF-8 of a text (null: empty), padded to whole lines."""
    data = (text or "").encode()
    return data + bytes([PAD]) * (max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(data: bytes) -> bytes:
    """Whole lines as a PNG file of 8-bit grey samples."""
    lines = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    plain = np.concatenate((np.zeros((len(lines), 1), np.uint8), lines), axis=1)
    header = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(plain.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(first: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first HEADER_BYTES of an image."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    return struct.unpack(">IIBB", first[16:26])


def from_image(data: bytes) -> bytes:
    """The samples of an image that to_image wrote; every chunk's checksum is tested."""
    width, height, *_ = read_header(data[:HEADER_BYTES])
    at, packed = 8, b""
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            packed += body
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature(samples: bytes, width: int) -> str:
    """Mean and spread of the samples, and 64 bits that say where a grid of 8 by 8 fields is brighter than the mean."""
    grey = np.frombuffer(samples, np.uint8).reshape(-1, width).astype(np.float64)
    row_ends = np.linspace(0, len(grey), _GRID + 1).astype(int)
    # Of an image with fewer lines than fields some fields share a line.
    rows = np.stack([grey[min(a, len(grey) - 1) : max(b, a + 1)].mean(axis=0) for a, b in zip(row_ends, row_ends[1:], strict=False)])
    fields = rows.reshape(_GRID, _GRID, -1).mean(axis=2)
    bits = np.packbits((fields > fields.mean()).ravel()).tobytes().hex()
    return f"grey8 {width}x{len(grey)} mean={grey.mean():.4f} std={grey.std():.4f} hash={bits}"


def _write_shards(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pa.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        seen: set[bytes] = set()
        rows: list[tuple[str, str, int, int]] = []
        number, out, name = 0, None, ""
        for batch in batches:
            for text in batch.column("text"):
                data = payload(text.as_py())
                key = hashlib.sha256(data).digest()
                if key in seen:
                    continue
                seen.add(key)
                digest, image = key.hex(), to_image(data)
                if out is None:
                    # Attempts write names of their own, so that one that fails leaves nothing that a row points to.
                    name = f"shard-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.tar"
                    number += 1
                    out = files.open_output_stream(f"{root}/{name}")
                info = tarfile.TarInfo(f"{digest}.png")
                info.size = len(image)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                rows.append((digest, name, out.tell() + len(head), len(image)))
                out.write(head + image + bytes(-len(image) % tarfile.BLOCKSIZE))
                if out.tell() >= SHARD_BYTES:
                    _close(out)
                    out = None
                    yield _placed(rows)
                    rows = []
        if out is not None:
            _close(out)
        if rows:
            yield _placed(rows)

    return run


def _close(out: pa.NativeFile) -> None:
    """End a tar file with its two empty blocks."""
    out.write(bytes(2 * tarfile.BLOCKSIZE))
    out.close()


def _placed(rows: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
    digest, shard, offset, length = (list(c) for c in zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(digest), pa.array(shard), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], ["digest", "shard", "offset", "length"])


def as_uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write the payloads of docs (text) to tar shards below folder; (digest, shard, offset, length) of each distinct one.

    Tasks write what they read, each payload once, and no payload is shuffled. Where several tasks hold copies, the
    catalogue names the place in the first shard. It is stored; shards that it does not name come from attempts that failed.
    """
    folder = as_uri(folder)
    files, root = pa.fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    placed = stored(docs.select("text").mapInArrow(_write_shards(folder), _PLACE), "placed")
    first = placed.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return stored(first.select("digest", "at.*"), "catalogue")


def _ranges(folder: str, batch: pa.RecordBatch, most: int | None) -> Iterator[bytes]:
    """The bytes of each member, or its first `most`; each shard is opened once for rows that follow one another."""
    files, root = pa.fs.FileSystem.from_uri(folder)
    name, source = None, None
    for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
        if shard != name:
            if source is not None:
                source.close()
            name, source = shard, files.open_input_file(f"{root}/{shard}")
        source.seek(offset)
        yield source.read(length if most is None else min(most, length))
    if source is not None:
        source.close()


def _headers(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [read_header(first) for first in _ranges(folder, batch, HEADER_BYTES)]
            columns = [pa.array([f[k] for f in fields], pa.int32()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "width", "height", "bit_depth", "colour_type"])

    return run


def _by_shard(rows: DataFrame) -> DataFrame:
    """Rows dealt out and sorted by their place, so that a task reads few shards from front to end."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "shard").sortWithinPartitions("shard", "offset")


_PLACE = "digest string, shard string, offset long, length long"
_METADATA = f"{_PLACE}, width int, height int, bit_depth int, colour_type int"


def with_metadata(catalogue: DataFrame, folder: str) -> DataFrame:
    """The catalogue with width, height, bit_depth and colour_type, from a few bytes of each member."""
    return _by_shard(catalogue.select("digest", "shard", "offset", "length")).mapInArrow(_headers(as_uri(folder)), _METADATA)


def _contents(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                rows = []
                for image, width in zip(_ranges(folder, batch, None), batch.column("width").to_pylist(), strict=True):
                    data = from_image(image)
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(data, width)))
                columns = [list(c) for c in zip(*rows, strict=True)]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("digest"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                    ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return run


def contents(described: DataFrame, folder: str) -> DataFrame:
    """What the stored bytes of each member of a catalogue with metadata hold, read back from the shards."""
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _by_shard(described).mapInArrow(_contents(as_uri(folder)), schema)


def padded(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digest) of each row of docs: the digest names the payload of its text."""
    data = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(data)
    short = F.greatest(F.lit(1), F.ceil(size / WIDTH)).cast("int") * WIDTH - size
    # Blanks are one byte each.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("n_bytes"), F.sha2(F.concat(data, F.repeat(F.lit(chr(PAD)), short)).cast("binary"), 256).alias("digest"))


def media_rows(docs: DataFrame) -> DataFrame:
    """Size, digests and feature of each document's payload, with its place in the shards and its metadata.

    Each row of docs (doc_id, text) gives one row; null and empty texts are one line of blanks. Equal texts share one
    member and have equal values. An empty table gives no rows; other columns are not looked at.
    """
    folder = scratch(docs.sparkSession, "media")
    catalogue = store(docs, folder)
    described = stored(with_metadata(catalogue, folder), "metadata")
    held = stored(described.join(contents(described, folder), "digest"), "contents")
    return padded(docs).join(held, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "width", "height"
    )
