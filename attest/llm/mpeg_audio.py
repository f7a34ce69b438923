"""MPEG audio columns: frames are found by their headers and resynchronised, tags and variable-bitrate tables parsed,
checksums verified, and exact durations and frame offsets stored.

A payload can be stored losslessly in a valid, silent Layer III stream: its bytes are the frames' ancillary data.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import spare

# Fixed values of the format: bit rates (kbit/s, by index from 1) of MPEG-1 layers I-III and MPEG-2 layers I and II/III,
# sample rates by version and index.
KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

SIDE = 17  # bytes of side information of a mono MPEG-1 Layer III frame
PAYLOAD_TAG = b"payload-bytes"


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    guarded: bool
    kbps: int
    hertz: int
    mono: bool
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes that the checksum covers after the header (Layer III: the side information)."""
        return ((17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)) if self.layer == 3 else 0


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """The meaning of a frame's first four bytes; None if they are no header. Free-format frames are not supported."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate, hertz, padding = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3:
        return None
    kbps, hz = KBPS[1 if version == 3 else 2, layer][rate - 1], HERTZ[version][hertz]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    length = (12_000 * kbps // hz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + padding
    return Header(version, layer, not four[1] & 1, kbps, hz, four[3] >> 6 == 3, length, samples)


@cache
def _remainders() -> list[int]:
    """What the CRC of a byte is after its eight bits."""
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        out.append(crc)
    return out


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """CRC-16 of the format: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc, after = 0xFFFF, _remainders()
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ after[crc >> 8 ^ byte]
    return crc


@dataclass
class Audio:
    """What a stream holds. offsets are those of the audio frames; duration is exactly (samples - trimmed) / hertz.

    trimmed: the samples at both ends that the encoder says it added. seek_points: bytes from the table's frame to even
    parts of the audio, as the table lists them.
    """

    hertz: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    kbps: set[int] = field(default_factory=set)
    guarded: int = 0
    sound: int = 0
    skipped: int = 0
    resyncs: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    seek_points: list[int] = field(default_factory=list)
    trimmed: int = 0
    layer: int = 0
    version: int = 0

    @property
    def duration_us(self) -> int:
        return max(0, self.samples - self.trimmed) * 1_000_000 // self.hertz if self.hertz else 0

    def seek(self, sample: int) -> int:
        """Offset of the frame that holds a sample."""
        if not self.offsets:
            return 0
        return self.offsets[min(len(self.offsets) - 1, sample * len(self.offsets) // max(1, self.samples))]

    def feature(self) -> str:
        digest = hashlib.sha256(np.array(self.offsets, "<i8").tobytes()).hexdigest()[:16]
        listed = f"{self.table.get('frames', -1)}f{self.table.get('bytes', -1)}b" if self.table else "none"
        return f"v{self.version}l{self.layer};hz={self.hertz};frames={len(self.offsets)};samples={self.samples};us={self.duration_us};kbps={min(self.kbps, default=0)}-{max(self.kbps, default=0)};crc={self.sound}/{self.guarded};skipped={self.skipped};resyncs={self.resyncs};table={listed};tags={len(self.tags)};seek={digest}"


def _synchsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _id3v2(data: bytes, found: Audio) -> int:
    """Parse an ID3v2.3/2.4 tag at the start; where the audio begins."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    end, at = 10 + _synchsafe(data[6:10]), 10
    while at + 10 <= min(end, len(data)) and data[at : at + 1].isalnum():
        size = _synchsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8])
        body = data[at + 10 : at + 10 + size]
        if data[at : at + 1] == b"T" and body:
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            name, _, value = body[1:].decode(coding, "replace").rpartition("\0")
            found.tags[data[at : at + 4].decode("latin-1") + (f":{name}" if name else "")] = value
        at += 10 + size
    return end


def _table(frame: bytes, h: Header, found: Audio) -> bool:
    """Parse a Xing/Info or VBRI table; whether the frame is one."""
    at = 4 + 2 * h.guarded + h.side
    if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, at = int.from_bytes(frame[at + 4 : at + 8]), at + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                found.table[name] = int.from_bytes(frame[at : at + 4])
                at += 4
        if flags & 4:
            found.seek_points = [x * found.table.get("bytes", 0) // 256 for x in frame[at : at + 100]]
            at += 100
        at += 4 * bool(flags & 8)
        if frame[at : at + 4] in (b"LAME", b"Lavf", b"Lavc") and len(frame) >= at + 24:  # the encoder's own part
            both = int.from_bytes(frame[at + 21 : at + 24])
            found.trimmed = (both >> 12) + (both & 0xFFF)
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width = (int.from_bytes(frame[a:b]) for a, b in ((46, 50), (50, 54), (54, 56), (56, 58), (58, 60)))
        found.table |= {"bytes": size, "frames": frames}
        parts = [scale * int.from_bytes(frame[i : i + width]) for i in range(62, 62 + entries * width, max(1, width)) if i + width <= len(frame)]
        found.seek_points = [sum(parts[:i]) for i in range(len(parts))]
        return True
    return False


def parse(data: bytes) -> Audio:
    """Read a whole stream. After damage it looks for the next header whose successor is a header of the same kind, or the end.

    Only the first frame can be a table, and the letters TAG begin an ID3v1 tag only where no frame reaches over them:
    what later frames hold is theirs.
    """
    found = Audio()
    at, end = _id3v2(data, found), len(data)
    tag = end - 128 if data[-128:-125] == b"TAG" else end
    first, trusted, lost = True, False, False
    while at + 4 <= (tag if at <= tag else end):
        h = header(data[at : at + 4])
        if h:
            after, over = at + h.length, at < tag < at + h.length
            stop = end if over or at > tag else tag
            if after <= stop and (over or not trusted):  # a header by chance is rarely followed by another
                n = header(data[after : after + 4]) if after + 4 <= stop else None
                if (after != end if over else after + 4 <= stop) and (not n or (n.version, n.layer, n.hertz) != (h.version, h.layer, h.hertz)):
                    h = None
            elif after > stop:
                h = None
        if not h:
            stop = tag if at < tag else end
            after = data.find(b"\xff", at + 1, stop)
            after = stop if after < 0 else after
            found.skipped += after - at
            found.resyncs += not lost
            at, trusted, lost = after, False, True
            continue
        lost = False
        if not (first and h.layer == 3 and _table(data[at : at + h.length], h, found)):
            found.offsets.append(at)
            found.lengths.append(h.length)
            found.samples += h.samples
            found.hertz, found.layer, found.version = h.hertz, h.layer, {3: 1, 2: 2, 0: 25}[h.version]
            found.kbps.add(h.kbps)
        first = False
        if h.guarded and h.layer == 3:
            found.guarded += 1
            found.sound += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == int.from_bytes(data[at + 4 : at + 6])
        at += h.length
        trusted = header(data[at : at + 4]) is not None
    if at <= tag < end:
        end = tag
        for name, (a, b) in {"title": (3, 33), "artist": (33, 63)}.items():
            if text := data[end + a : end + b].rstrip(b"\0 ").decode("latin-1"):
                found.tags[f"ID3v1:{name}"] = text
    found.skipped += max(0, end - at)
    return found


def _head(kbps: int) -> bytes:
    """Header, checksum and empty side information of a mono 48 kHz Layer III frame."""
    two = bytes([KBPS[1, 3].index(kbps) + 1 << 4 | 1 << 2, 0xC0])
    return b"\xff\xfa" + two + struct.pack(">H", crc16(two + bytes(SIDE))) + bytes(SIDE)


def store(payload: bytes) -> bytes:
    """A silent variable-bitrate stream with the payload as ancillary data: a tag, a Xing table, and frames of 320 kbit/s
    with a last one as small as may be (at 48 kHz a frame has 3 bytes for each kbit/s)."""
    room = 3 * 320 - len(_head(320))
    full, rest = divmod(len(payload), room)
    frames = np.zeros((full, 960), np.uint8)
    frames[:, : 960 - room] = np.frombuffer(_head(320), np.uint8)
    frames[:, 960 - room :] = np.frombuffer(payload, np.uint8, full * room).reshape(full, room)
    audio = frames.tobytes()
    if rest:
        kbps = next(k for k in KBPS[1, 3] if 3 * k - len(_head(k)) >= rest)
        audio += (_head(kbps) + payload[full * room :]).ljust(3 * kbps, b"\0")
    count = full + bool(rest)
    toc = bytes(min(255, 256 * (min(count - 1, count * i // 100) * 960) // max(1, len(audio))) if count else 0 for i in range(100))
    body = b"\x03" + PAYLOAD_TAG + b"\0" + str(len(payload)).encode()
    size = len(body)
    frame = b"TXXX" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + b"\0\0" + body
    tag = b"ID3\x04\0\0" + bytes([0, 0, len(frame) >> 7, len(frame) & 127]) + frame
    xing = b"\xff\xfb" + _head(64)[2:4] + bytes(SIDE) + b"Xing" + struct.pack(">III", 7, count, len(audio) + 192) + toc
    return tag + xing.ljust(192, b"\0") + audio


def restore(data: bytes, found: Audio) -> bytes:
    """The payload of a stream made by store()."""
    skip = len(_head(320))
    size = int(found.tags[f"TXXX:{PAYLOAD_TAG.decode()}"])
    return b"".join(data[o + skip : o + n] for o, n in zip(found.offsets, found.lengths, strict=True))[:size]


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0")


MEDIA = "media binary, layer int, hertz int, frames long, samples long, duration_us long, crc_frames long, crc_sound long, skipped long, trimmed long, tags map<string,string>, frame_offsets array<long>, seek_points array<long>, feature string"


def parse_column(df: DataFrame, column: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep plus MEDIA: what parse() finds in a binary column.

    Null or empty bytes, or bytes without a frame, have no frames and zero duration. Work is per row: repeated rows agree;
    other columns are ignored, and names of MEDIA can't be kept.
    """
    bytes_ = spare(df, "media_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [x.as_py() or b"" for x in b.column(bytes_)]
            found = [parse(x) for x in data]
            cols = [
                pa.array(data, pa.binary()), pa.array([f.layer for f in found], pa.int32()), pa.array([f.hertz for f in found], pa.int32()),
                *(pa.array(x, pa.int64()) for x in zip(*((len(f.offsets), f.samples, f.duration_us, f.guarded, f.sound, f.skipped, f.trimmed) for f in found), strict=True)),
                pa.array([list(f.tags.items()) for f in found], pa.map_(pa.string(), pa.string())), pa.array([f.offsets for f in found], pa.list_(pa.int64())), pa.array([f.seek_points for f in found], pa.list_(pa.int64())), pa.array([f.feature() for f in found], pa.string()),
            ] if found else [pa.array([], t) for t in (pa.binary(), pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.map_(pa.string(), pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())]
            yield pa.record_batch([*(b.column(c) for c in keep), *cols], names=[*keep, *(p.split()[0] for p in MEDIA.split(", "))])

    cols = df.select(*keep, F.col(column).alias(bytes_))
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema if f.name != bytes_]
    return cols.mapInArrow(run, ", ".join([*own, MEDIA]))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as UTF-8, padded with zero bytes to a positive multiple of 64, in an MPEG stream (null text: as empty).

    Rows are stored one by one, so repeated ones agree; very long texts are one stream; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.as_py() or b"" for x in b.column("raw")]
            yield pa.record_batch([b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([store(padded(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def media_digest(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what is read back from the stored streams: payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, frames, duration_us. Equal texts give equal values; work is per row, also for repeated rows;
    other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column("media"):
                data = x.as_py()
                found = parse(data)
                payload = restore(data, found)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), found.feature(), len(found.offsets), found.duration_us))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), *cols], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "duration_us"])

    return stored.mapInArrow(run, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, duration_us long")
