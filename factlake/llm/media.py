"""Media columns: MPEG audio streams, written and read back.

``parse`` reads any MPEG audio file: it skips and reads tags (ID3v2.2 to 2.4 with text frames in any encoding, extended headers and
unsynchronisation; ID3v1), finds frame headers and resynchronises past foreign bytes, reads variable-bitrate tables (Xing, Info with
encoder delays, VBRI with its seek table), verifies the checksums of all three layers, and gives the exact duration in samples, without what
the encoder added, and each frame's byte offset. Free-format streams aren't read. ``store`` puts a payload losslessly into such a file: MPEG-1
layer III frames of silence (empty side information, so a decoder plays nothing) with checksums, whose unused main-data area carries the payload.

Defined results: null text is empty and becomes 64 zero bytes; equal texts give equal values; null media gives null fields; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Fixed values of the format (ISO/IEC 11172-3 and 13818-3): kbit/s by bitrate index, Hz by sampling index, samples a frame.
RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

# Fixed values of layer II: bits of a subband's allocation as (bits, subbands), by table; tables by kbit/s a channel and Hz.
ALLOCATIONS = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "lsf": ((4, 4), (3, 7), (2, 19))}
# Text encodings of ID3v2 by their first byte.
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
V1_FIELDS = (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127))

UNIT = 64


class Header(NamedTuple):
    size: int
    samples: int
    hertz: int
    layer: int
    kbits: int
    side: int
    checked: bool
    alike: tuple
    channels: int
    bound: int


class Stream(NamedTuple):
    """What parse() found. offsets: of audio frames; samples: of them all; added: those that the encoder added at both ends; skipped: bytes that belong to no frame or tag."""

    tags: dict
    offsets: list
    samples: int
    hertz: int
    good: int
    bad: int
    skipped: int
    table: dict | None
    data: list
    added: int = 0


@lru_cache(65536)
def header(four: bytes) -> Header | None:
    """A frame header's meaning, or None for bytes that are none (free-format streams are not read)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] < 0xE0:
        return None
    version, layer, protected = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), not four[1] & 1
    rate, hertz, pad, mono = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1, four[3] >> 6 == 3
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3 or four[3] & 3 == 2:
        return None
    kind = (1 if version == 3 else 2, layer)
    kbits, hz, samples = RATES[kind][rate], HERTZ[version][hertz], SAMPLES[kind]
    size = (12_000 * kbits // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hz + pad
    side = 0 if layer != 3 else ((17 if mono else 32) if version == 3 else (9 if mono else 17))
    joint = four[3] >> 6 == 1
    return Header(size, samples, hz, layer, kbits, side, protected, (version, layer, hz), 1 if mono else 2, ((four[3] >> 4 & 3) + 1) * 4 if joint else 32)


@lru_cache(4096)
def checksum(data: bytes) -> int:
    """CRC-16 of the format: polynomial 0x8005, started with ones."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def checksum_bits(data: bytes, bits: int) -> int:
    """The same over the first ``bits`` bits."""
    crc = 0xFFFF
    for i in range(bits):
        crc = (crc << 1 ^ 0x8005 if (crc >> 15 ^ data[i >> 3] >> (7 - i & 7)) & 1 else crc << 1) & 0xFFFF
    return crc


def protected_bits(frame: bytes, head: Header) -> int:
    """Bits after the checksum that it covers: layer III's side information, layer I's allocation, layer II's allocation and scale factor selection."""
    if head.layer == 3:
        return 8 * head.side
    if head.layer == 1:
        return 4 * (head.channels * min(head.bound, 32) + 32 - min(head.bound, 32))
    each = head.kbits // head.channels
    table = "lsf" if head.alike[0] != 3 else ("d" if head.hertz == 32000 else "c") if each < 56 else "b" if each > 80 and head.hertz != 48000 else "a"
    value, at, selected = int.from_bytes(frame[6:], "big"), 0, 0
    size, band = 8 * len(frame[6:]), 0
    for bits, many in ALLOCATIONS[table]:
        for _ in range(many):
            for _ in range(head.channels if band < head.bound else 1):
                allocated = value >> (size - at - bits) & ((1 << bits) - 1) if at + bits <= size else 0
                selected += (allocated > 0) * (1 if band < head.bound else head.channels)
                at += bits
            band += 1
    return min(at + 2 * selected, size)


def checksum_right(frame: bytes, head: Header) -> bool:
    stored = int.from_bytes(frame[4:6], "big")
    bits = protected_bits(frame, head)
    if bits % 8 == 0:
        return checksum(frame[2:4] + frame[6 : 6 + bits // 8]) == stored
    return checksum_bits(frame[2:4] + frame[6 : 7 + bits // 8], 16 + bits) == stored


def _safe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _unsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _tag(values: dict[str, str]) -> bytes:
    """An ID3v2.4 tag with user text frames."""
    body = b""
    for k, v in values.items():
        text = b"\x03" + k.encode() + b"\0" + v.encode()
        body += b"TXXX" + _safe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _safe(len(body)) + body


def _text_parts(raw: bytes) -> list[str]:
    """Zero-ended texts of a text frame, its encoding first."""
    code, body = raw[0] if raw[0] < 4 else 0, raw[1:]
    text = body.decode(ENCODINGS[code], "replace")
    return [p.lstrip("\ufeff") for p in text.rstrip("\0").split("\0")]


def _frames(body: bytes, major: int, found: dict) -> None:
    """The text frames of a tag's body."""
    names, head = (3, 6) if major == 2 else (4, 10)
    pos = 0
    while pos + head <= len(body) and body[pos : pos + names].strip(b"\0"):
        name, raw = body[pos : pos + names].decode("latin-1"), body[pos + names : pos + 2 * names]
        size = _unsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        data = body[pos + head : pos + head + size]
        if major == 4:
            marks = body[pos + 9]
            data = data[4:] if marks & 1 else data
            data = data.replace(b"\xff\0", b"\xff") if marks & 2 else data
        if name[0] == "T" and len(data) > 1:
            parts = _text_parts(data)
            if name in ("TXXX", "TXX"):
                found[parts[0]] = parts[1] if len(parts) > 1 else ""
            else:
                found[name] = "/".join(parts)
        pos += head + size


def _tags(media: bytes) -> tuple[dict, int]:
    """Text frames of leading ID3v2 tags, and where they end."""
    at, found = 0, {}
    while media[at : at + 3] == b"ID3" and len(media) >= at + 10:
        end, major, marks = at + 10 + _unsafe(media[at + 6 : at + 10]), media[at + 3], media[at + 5]
        body = media[at + 10 : end]
        if marks & 0x80 and major < 4:
            body = body.replace(b"\xff\0", b"\xff")
        if marks & 0x40 and major > 2 and len(body) >= 4:
            body = body[_unsafe(body[:4]) if major == 4 else int.from_bytes(body[:4], "big") + 4 :]
        _frames(body, major, found)
        at = end + (10 if marks & 0x10 else 0)
    return found, at


def _old_tag(tag: bytes) -> dict:
    """The fields of an ID3v1 tag, by its own names."""
    found = {name: tag[a:b].split(b"\0")[0].decode("latin-1").rstrip() for name, a, b in V1_FIELDS}
    if tag[125] == 0 and tag[126]:
        found["track"] = str(tag[126])
    return {f"id3v1.{k}": v for k, v in {**found, "genre": str(tag[127])}.items() if v}


def _table(frame: bytes, head: Header) -> dict | None:
    """A Xing, Info or VBRI table in a stream's first frame."""
    at = 4 + 2 * head.checked + head.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, pos, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": frame[at : at + 4].decode()}
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                out[name] = frame[pos : pos + size] if name == "toc" else int.from_bytes(frame[pos : pos + size], "big")
                pos += size
        if frame[pos : pos + 4] in (b"LAME", b"Lavc", b"Lavf") and len(frame) >= pos + 24:
            both = int.from_bytes(frame[pos + 21 : pos + 24], "big")
            out |= {"delay": both >> 12, "padding": both & 0xFFF}
        return out
    if frame[36:40] == b"VBRI":
        number = lambda a, b: int.from_bytes(frame[a:b], "big")
        many, scale, size = number(54, 56), number(56, 58), number(58, 60)
        return {"kind": "VBRI", "bytes": number(46, 50), "frames": number(50, 54), "frames_per_entry": number(60, 62), "seek": [scale * number(62 + i * size, 62 + (i + 1) * size) for i in range(many) if 62 + (i + 1) * size <= len(frame)]}
    return None


def parse(media: bytes) -> Stream:
    """Reads a file; a header counts if another of its kind, a tag or the end follows its frame."""
    tags, at = _tags(media)
    old = media[-128:-125] == b"TAG" and len(media) - 128 >= at
    end = len(media) - 128 if old else len(media)
    tags |= _old_tag(media[-128:]) if old else {}
    offsets, data, samples, good, bad, skipped, table, hertz, locked = [], [], 0, 0, 0, 0, None, 0, None
    while at + 4 <= end:
        head = header(media[at : at + 4])
        after = at + head.size if head else 0
        nxt = header(media[after : after + 4]) if head and after + 4 <= end else None
        if not head or head.size < 4 or after > end or not (after == end or nxt and nxt.alike == head.alike or locked == head.alike):
            nearest = media.find(b"\xff", at + 1, end)
            skipped, at, locked = skipped + (nearest if nearest >= 0 else end) - at, nearest if nearest >= 0 else end, None
            continue
        frame = media[at:after]
        body = 4 + 2 * head.checked + head.side
        if head.checked:
            right = checksum_right(frame, head)
            good, bad = good + right, bad + (not right)
        if not offsets and table is None and (table := _table(frame, head)):
            pass
        else:
            offsets.append(at)
            data.append(frame[body:])
            samples, hertz = samples + head.samples, head.hertz
        locked, at = head.alike, after
    added = min(samples, table.get("delay", 0) + table.get("padding", 0)) if table else 0
    return Stream(tags, offsets, samples, hertz, good, bad, skipped + end - at, table, data, added)


@lru_cache(64)
def _frame_start(kbits: int) -> bytes:
    """Header, checksum and empty side information of a mono frame of layer III at 44.1 kHz."""
    four = bytes((0xFF, 0xFA, RATES[1, 3].index(kbits) << 4, 0xC4))
    return four + checksum(four[2:] + bytes(17)).to_bytes(2, "big") + bytes(17)


#: Bytes of payload that a frame of each bitrate takes.
ROOM = {k: 144_000 * k // 44100 - 23 for k in RATES[1, 3][1:]}
LARGEST = max(ROOM)


def store(payload: bytes) -> bytes:
    """The payload as an MPEG audio file with a tag and a Xing table; bitrates vary, so that the last frame isn't mostly empty."""
    frames = []
    for at in range(0, len(payload), ROOM[LARGEST]):
        part = payload[at : at + ROOM[LARGEST]]
        kbits = next(k for k, room in ROOM.items() if room >= len(part))
        frames.append(_frame_start(kbits) + part.ljust(ROOM[kbits], b"\0"))
    total = sum(map(len, frames))
    places, sizes = [0], list(map(len, frames))
    for n in sizes:
        places.append(places[-1] + n)
    toc = bytes(min(255, 256 * places[i * len(frames) // 100] // total) for i in range(100))
    first = _frame_start(64) + b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + (total + ROOM[64] + 23).to_bytes(4, "big") + toc
    return _tag({"payload_bytes": str(len(payload))}) + first.ljust(ROOM[64] + 23, b"\0") + b"".join(frames)


def payload(stream: Stream) -> bytes:
    return b"".join(stream.data)[: int(stream.tags["payload_bytes"])]


def _free(df: DataFrame, name: str) -> str:
    """The name, with lines under it as long as a column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def described(df: DataFrame, column: str = "media") -> DataFrame:
    """``df`` and, of ``column`` (binary), a struct ``audio``: duration_samples (without what the encoder added), sample_rate, seek_offsets, checksums good and bad, skipped_bytes, tags.

    The struct's name gets a line under it (``audio_``) where ``df`` has a column of that name; no column is replaced.
    """
    fields = "duration_samples long, sample_rate int, seek_offsets array<long>, checksums_good long, checksums_bad long, skipped_bytes long, tags map<string,string>"

    @F.pandas_udf(fields)
    def read(media):
        import pandas as pd

        rows = [None if m is None else parse(bytes(m)) for m in media]
        return pd.DataFrame([(None,) * 7 if s is None else (s.samples - s.added, s.hertz, s.offsets, s.good, s.bad, s.skipped, s.tags) for s in rows], columns=[f.split()[0] for f in fields.split(", ")])

    return df.withColumn(_free(df, "audio"), read(F.col(column).cast("binary")))


def _padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` and ``media`` (``media_`` where that name is taken): the padded text as an MPEG audio file."""

    @F.pandas_udf("binary")
    def write(texts):
        return texts.map(lambda t: store(_padded(t)[1]))

    return docs.withColumn(_free(docs, "media"), write(F.coalesce(docs["text"].cast("string"), F.lit(""))))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its text stored, read back from the stored bytes, and described."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = [f.split()[0] for f in DIGEST.split(", ")]
        for batch in slices(batches, 1):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, media = (lambda n, p: (n, store(p)))(*_padded(text.as_py()))
                s = parse(media)
                back = payload(s)
                seeks = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in s.offsets))
                feature = f"frames={len(s.offsets)};samples={s.samples};rate={s.hertz};checksums={s.good}/{s.good + s.bad};skipped={s.skipped};table={s.table['frames'] if s.table else 0};seek_crc32={seeks}"
                out.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, DIGEST)
