from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from factlake.llm import media, queries


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1005, 1006, 1007, 5000, 123456])
def test_round_trip(n):
    raw = random.Random(n).randbytes(n).replace(b"\0\0", b"\xff\xfb")
    size, payload = media._padded(raw.decode("latin-1"))
    stream = media.parse(media.store(payload))
    assert media.payload(stream) == payload and len(payload) % 64 == 0 and size <= len(payload)
    assert stream.bad == stream.skipped == 0 and stream.good == len(stream.offsets) + 1
    assert stream.table["frames"] == len(stream.offsets) and len(stream.table["toc"]) == 100
    assert stream.samples == 1152 * len(stream.offsets) and stream.hertz == 44100


def test_resynchronises_and_checks():
    payload = random.Random(1).randbytes(6400)
    file = media.store(payload)
    whole = media.parse(file)
    at = whole.offsets[2]
    junk = b"\xff\xfbgarbage\x00\xff"
    broken = media.parse(file[:at] + junk + file[at:])
    assert broken.skipped == len(junk) and len(broken.offsets) == len(whole.offsets) and media.payload(broken) == payload
    bad = bytearray(file)
    bad[at + 10] ^= 1
    assert media.parse(bytes(bad)).bad == 1
    assert media.parse(file + b"TAG" + bytes(125)).skipped == 0
    assert media.parse(b"").offsets == [] and media.parse(b"no audio \xff\xff at all").offsets == []


def frame_of(four, size, body):
    return (four + media.checksum(four[2:] + body).to_bytes(2, "big") + body).ljust(size, b"\0")


def test_tags_of_all_versions():
    audio = media.store(b"x" * 64)[len(media._tag({"payload_bytes": "64"})) :]
    body = lambda name, raw, marks=b"\0\0": name + len(raw).to_bytes(4, "big") + marks + raw
    title, custom = b"\x01" + "Hé".encode("utf-16"), b"\x01" + "k".encode("utf-16") + b"\0\0" + "vé\U0001f600".encode("utf-16")
    v3 = body(b"TIT2", title) + body(b"TXXX", custom) + body(b"TALB", b"\x02" + "Ünter".encode("utf-16-be")) + body(b"TPE1", b"\x00caf\xe9\0")
    tag = lambda major, marks, raw: b"ID3" + bytes((major, 0, marks)) + media._safe(len(raw)) + raw
    expected = {"TIT2": "Hé", "k": "vé\U0001f600", "TALB": "Ünter", "TPE1": "café"}
    assert media.parse(tag(3, 0, v3) + audio).tags == expected
    extended = (6).to_bytes(4, "big") + bytes(6)
    assert media.parse(tag(3, 0x40, extended + v3) + audio).tags == expected
    spread = v3.replace(b"\xff", b"\xff\0")
    assert media.parse(tag(3, 0x80, spread) + audio).tags == expected
    v4 = b"TIT2" + media._safe(len(title) + 4) + b"\0\1" + media._safe(len(title)) + title
    assert media.parse(tag(4, 0x40, media._safe(6) + b"\1\0" + v4) + audio).tags == {"TIT2": "Hé"}
    v2 = b"TT2" + (6).to_bytes(3, "big") + b"\0title"
    old = b"TAG" + b"Song".ljust(30, b"\0") + b"Singer".ljust(30) + b"".ljust(30, b"\0") + b"1999" + b"words".ljust(28, b"\0") + b"\0\x07" + b"\x11"
    both = media.parse(tag(2, 0, v2) + audio + old)
    assert both.tags == {"TT2": "title", "id3v1.title": "Song", "id3v1.artist": "Singer", "id3v1.year": "1999", "id3v1.comment": "words", "id3v1.track": "7", "id3v1.genre": "17"} and both.skipped == 0


def test_tables_give_seek_points_and_what_the_encoder_added():
    four = bytes((0xFF, 0xFB, 0x90, 0xC4))
    vbri = (four + bytes(32) + b"VBRI" + b"\0\1" + bytes(4) + (1251).to_bytes(4, "big") + (3).to_bytes(4, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + (2).to_bytes(2, "big") + b"\0\1" + b"\0\xd0\0\xd1\0\xd0").ljust(417, b"\0")
    stream = media.parse(vbri + (four.ljust(417, b"\0")) * 3)
    assert stream.table == {"kind": "VBRI", "bytes": 1251, "frames": 3, "frames_per_entry": 1, "seek": [416, 418, 416]} and stream.samples == 3456 and stream.added == 0
    info = (four + bytes(17) + b"Info" + (1).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")).ljust(417, b"\0")
    stream = media.parse(info + (four.ljust(417, b"\0")) * 3)
    assert stream.table["delay"] == 576 and stream.table["padding"] == 1000 and stream.samples - stream.added == 3456 - 1576


def test_checksums_of_layers_one_and_two():
    rng = random.Random(3)
    # Layer I, stereo: 256 bits of allocation; joint stereo with bound 8: 4 * (2 * 8 + 24) bits.
    for last, bits in ((0x04, 256), (0x54, 160)):
        four = bytes((0xFF, 0xFE, 0x90, last))
        head = media.header(four)
        assert media.protected_bits(bytes(400), head) == bits
        body = rng.randbytes(media.protected_bits(bytes(400), head) // 8)
        frame = frame_of(four, head.size, body)
        stream = media.parse(frame * 3)
        assert (stream.good, stream.bad) == (3, 0)
        bad = bytearray(frame * 3)
        bad[10] ^= 4
        assert media.parse(bytes(bad)).bad == 1
        bad = bytearray(frame * 3)
        bad[len(frame) - 1] ^= 4  # outside of what is protected
        assert media.parse(bytes(bad)).bad == 0
    # Layer II, mono at 64 kbit/s: 27 subbands, of which the first three have samples.
    four = bytes((0xFF, 0xFC, 0x44, 0xC4))
    head = media.header(four)
    body = (0x111 << 4 | 0).to_bytes(2, "big") + bytes(30)
    bits = 11 * 4 + 12 * 3 + 4 * 2 + 2 * 3
    assert head.layer == 2 and media.protected_bits(four + b"\0\0" + body, head) == bits
    crc = media.checksum_bits(four[2:] + body, 16 + bits)
    frame = (four + crc.to_bytes(2, "big") + body).ljust(head.size, b"\0")
    assert media.parse(frame * 3).good == 3
    for at, bad_ones in ((6, 1), (head.size - 1, 0)):
        bad = bytearray(frame * 3)
        bad[at] ^= 1
        assert media.parse(bytes(bad)).bad == bad_ones
    assert media.checksum_bits(b"12345", 40) == media.checksum(b"12345")


def test_headers():
    assert media.header(bytes((0xFF, 0xFB, 0x90, 0xC4))).size == 417
    assert media.header(bytes((0xFF, 0xFB, 0x92, 0xC4))).size == 418  # padded
    assert media.header(bytes((0xFF, 0xF3, 0x80, 0xC4))).samples == 576  # MPEG 2
    assert media.header(bytes((0xFF, 0xFF, 0x90, 0xC4))).samples == 384  # layer I
    assert all(media.header(x) is None for x in (b"\xff\xfb\xf0\xc4", b"\xff\xfb\x0c\xc4", b"\xff\xe9\x90\xc4", b"abcd", b"\xff"))


def test_query(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op5_media(spark, small).collect():
        raw = texts[r.doc_id].encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])


def test_odd_documents(odd, none):
    rows = media.digest(odd).collect()
    assert len(rows) == odd.count() and {r.payload_bytes for r in rows if r.n_bytes == 0} == {64}
    by = {}
    for r in rows:
        by.setdefault(r.payload_sha256, set()).add(tuple(r)[2:])
    assert all(len(v) == 1 for v in by.values())
    assert media.digest(none).count() == 0
    told = media.described(media.stored(odd.select("doc_id", "text"))).collect()
    assert all(r.audio.duration_samples == 1152 * len(r.audio.seek_offsets) and r.audio.checksums_bad == 0 for r in told)
    taken = media.stored(odd.selectExpr("doc_id", "text", "1 as media", "2 as audio", "3 as tags"))
    assert taken.columns[-1] == "media_" and media.described(taken, "media_").select("media", "audio", "tags").distinct().collect() == [(1, 2, 3)]


def test_stored_form_and_feature_follow_from_the_bytes(spark, small):
    """media_bytes, media_sha256 and feature against a file put together again from the payload, frame by frame."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op5_media(spark, small).limit(40).collect():
        payload = media._padded(texts[r.doc_id])[1]
        file = media.store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        at, places = file.index(b"Xing") - 23, []
        at += media.header(file[at : at + 4]).size
        while at < len(file):
            places.append(at)
            at += media.header(file[at : at + 4]).size
        seeks = zlib.crc32(b"".join(p.to_bytes(8, "little") for p in places))
        n = len(places)
        assert r.feature == f"frames={n};samples={1152 * n};rate=44100;checksums={n + 1}/{n + 1};skipped=0;table={n};seek_crc32={seeks}"
