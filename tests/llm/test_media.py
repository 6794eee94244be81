import hashlib
import tarfile
import zlib

import pytest

from pagetide.llm import media
from pagetide.llm.common import scratch


@pytest.mark.parametrize("text", [None, "", "x", "x" * 192, "x" * 193, "é" * 5000])
def test_image_round_trip(text):
    data = media.payload(text)
    image = media.to_image(data)
    assert len(data) % 192 == 0 and data.rstrip(b" ") == (text or "").encode()
    assert media.from_image(image) == data and media.read_header(image[: media.HEADER_BYTES]) == (192, len(data) // 192, 8, 0)


def test_damage_is_found():
    image = bytearray(media.to_image(media.payload("some text")))
    image[60] ^= 1
    with pytest.raises(ValueError):
        media.from_image(bytes(image))


def test_rows_hold_what_was_stored(given):
    docs, texts = given
    for r in media.media_rows(docs).collect():
        data = media.payload(texts[r["doc_id"]])
        image = media.to_image(data)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(texts[r["doc_id"]].encode()), len(data))
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-16:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        assert r["feature"] == media.feature(data, 192)


def test_tar_files_are_readable_and_hold_no_payload_twice(spark, given, tmp_path):
    docs, texts = given
    rows = docs.union(docs).repartition(3)
    catalogue = media.store(rows, str(tmp_path / "shards")).collect()
    found = {f.name: {m.name: m for m in tarfile.open(f)} for f in (tmp_path / "shards").glob("*.tar")}
    assert all(len(members) == len(tarfile.open(tmp_path / "shards" / name).getnames()) for name, members in found.items())
    assert len(catalogue) == len({r["digest"] for r in catalogue}) == len(set(texts.values()))
    for r in catalogue:
        member = found[r["shard"]][f"{r['digest']}.png"]
        assert (member.offset_data, member.size) == (r["offset"], r["length"])


def test_header_reads_fill_metadata(spark, given):
    folder = scratch(spark, "test-media")
    rows = media.with_metadata(media.store(given[0], folder), folder).collect()
    assert {(r["width"], r["bit_depth"], r["colour_type"]) for r in rows} == {(192, 8, 0)}
