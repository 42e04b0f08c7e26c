"""Operator 9: MPEG audio columns: frames, tags, variable-bitrate tables, checksums, durations, seek offsets.

``parse`` reads any MPEG 1, 2 or 2.5 audio stream of layers I to III: it skips an ID3v2 tag in front and an
ID3v1 tag behind, finds frames by header and, after damage, resynchronises at the next header that a second
one of its kind (or the stream's end) confirms, or at one of another kind that two more confirm: streams that were joined
are read on, and a false start is left behind. A first frame with a Xing, Info or VBRI table holds no audio.
The checksum of a protected frame is verified over what its layer protects: the side information, or the allocation of bits with, in
Layer II, the selection of scale factors. The duration is exact: samples at each rate. Frames of the free format, whose size no
header tells, are skipped.

``store`` is the lossless way in: the payload's bytes are the ancillary data of silent Layer III frames, whose
side information says that no byte is coded audio. Full frames have the highest bitrate and the last the
lowest that holds the rest, so the stream is of variable bitrate; a Xing table gives frames, bytes and 100 seek
points, and an ID3v2 tag the payload's length.

Null texts are empty; an empty text's payload is 64 zero bytes. Equal texts give equal streams. Repeated rows
give repeated rows, an empty table none. A text of any length is a longer stream of frames of one size. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pieces, table

BLOCK = 64  # payloads are padded to a positive multiple of this
# Fixed values of the MPEG audio format: kbit/s by (version 1?, layer), Hz by version, samples a frame.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC_POLYNOMIAL = 0x8005


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG 1, 2: MPEG 2, 0: MPEG 2.5
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padding: int
    mono: bool
    mode_extension: int
    joint: bool

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 3 else 576

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12 * self.bitrate // self.rate + self.padding) * 4
        return self.samples // 8 * self.bitrate // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of side information of Layer III."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    @property
    def kind(self) -> tuple:
        return self.version, self.layer, self.rate


@lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """The header in four bytes; None if it is none, or of the free format, whose frame size isn't in it."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, bitrate = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 2 & 3, raw[2] >> 4
    if version == 1 or layer == 4 or rate == 3 or bitrate in (0, 15) or raw[3] & 3 == 2:
        return None
    return Header(version, layer, not raw[1] & 1, BITRATES[version == 3, layer][bitrate] * 1000, RATES[version][rate], raw[2] >> 1 & 1, raw[3] >> 6 == 3, raw[3] >> 4 & 3, raw[3] >> 6 == 1)


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        crc = b << 8
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLYNOMIAL if crc & 0x8000 else crc << 1) & 0xFFFF
        out.append(crc)
    return out


def _crc_bits(crc: int, data: bytes, bits: int) -> int:
    steps = _crc_table()
    for b in data[: bits // 8]:
        crc = (crc << 8 & 0xFFFF) ^ steps[crc >> 8 ^ b]
    for i in range(bits % 8):
        bit = data[bits // 8] >> (7 - i) & 1
        crc = (crc << 1 ^ CRC_POLYNOMIAL if (crc >> 15) ^ bit else crc << 1) & 0xFFFF
    return crc


@lru_cache(maxsize=4096)
def checksum(head: bytes, body: bytes, bits: int) -> int:
    """CRC-16 of the header's last two bytes and the first bits after the checksum."""
    return _crc_bits(_crc_bits(0xFFFF, head, 16), body, bits)


# Fixed values of the format: bits of allocation for the subbands of Layer II, as (subbands, bits) by table.
ALLOCATION = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "low": ((4, 4), (7, 3), (19, 2))}


def allocation_table(h: Header) -> list[int]:
    """Bits of allocation of each subband of a Layer II frame."""
    each = h.bitrate // 1000 // (1 if h.mono else 2)
    if h.version != 3:
        name = "low"
    elif each >= 56 and (h.rate == 48000 or each <= 80):
        name = "a"
    elif each >= 96:
        name = "b"
    else:
        name = "d" if h.rate == 32000 else "c"
    return [bits for n, bits in ALLOCATION[name] for _ in range(n)]


def protected_bits(h: Header, body: bytes) -> int:
    """How many bits after the checksum it covers."""
    if h.layer == 3:
        return 8 * h.side
    bound = 4 * (h.mode_extension + 1) if h.joint else 32
    if h.layer == 1:
        return 4 * (32 if h.mono else 2 * bound + 32 - bound)
    word, total = int.from_bytes(body, "big"), 8 * len(body)
    at = chosen = 0
    for band, bits in enumerate(allocation_table(h)):
        alone = not h.mono and band < bound  # each channel has its own allocation
        for _ in range(2 if alone else 1):
            used = at + bits <= total and word >> (total - at - bits) & ((1 << bits) - 1)
            at += bits
            chosen += (1 if alone or h.mono else 2) * bool(used)
    return at + 2 * chosen


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    frames: list[tuple[int, int, Header]] = field(default_factory=list)  # offset, size, header: audio only
    rate: int = 0  # of the last frame
    samples: int = 0
    durations: dict[int, int] = field(default_factory=dict)  # samples by rate
    checked: int = 0
    bad: int = 0
    skipped: int = 0  # bytes in no frame and no tag
    resyncs: int = 0
    truncated: bool = False

    @property
    def seconds(self) -> Fraction:
        return sum((Fraction(n, rate) for rate, n in self.durations.items()), Fraction(0))


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Bytes of the tag in front; its text frames go to ``tags``."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    end = min(10 + _syncsafe(data[6:10]), len(data))
    at, size_of = 10, _syncsafe if data[3] >= 4 else lambda raw: int.from_bytes(raw, "big")
    while data[3] >= 3 and at + 10 < end and data[at] and (size := size_of(data[at + 4 : at + 8])) <= end - at - 10:
        if data[at : at + 1] == b"T" and size:
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[at + 10], "latin-1")
            text = data[at + 11 : at + 10 + size].decode(coding, "replace").rstrip("\0")
            name, _, value = text.partition("\0") if data[at : at + 4] == b"TXXX" else (data[at : at + 4].decode("latin-1"), "", text)
            tags[name] = value
        at += 10 + size
    return end + (10 if data[5] & 0x10 else 0)


def _vbr_table(frame: bytes, h: Header) -> dict:
    at = 4 + 2 * h.protected + h.side
    if h.layer == 3 and (name := frame[at : at + 4]) in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, out, at = int.from_bytes(frame[at + 4 : at + 8], "big"), {"table": name.decode()}, at + 8
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key] = int.from_bytes(frame[at : at + 4], "big")
                at += 4
        if flags & 4:
            out["seek"] = list(frame[at : at + 100])
        return out
    if h.layer == 3 and frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, _, _, n_bytes, n_frames, entries, scale, width, each = struct.unpack(">HHHIIHHHH", frame[40:62])
        raw = frame[62 : 62 + entries * width]
        seek = [int.from_bytes(raw[i : i + width], "big") * scale for i in range(0, len(raw), width)] if width else []
        return {"table": "VBRI", "frames": n_frames, "bytes": n_bytes, "seek": seek, "frames_each": each}
    return {}


def _confirmed(data: bytes, at: int, end: int, kind: tuple | None, followers: int = 1) -> Header | None:
    """The frame header at ``at``, if so many headers of its kind, or the stream's end, follow it."""
    h = header(data[at : at + 4])
    if h is None or kind and h.kind != kind:
        return None
    following, place = h, at
    for _ in range(followers):
        place += following.size
        if place == end:
            break
        following = header(data[place : place + 4]) if place + 4 <= end else None
        if following is None or following.kind != h.kind:
            return None
    return h


def parse(data: bytes) -> Stream:
    s = Stream()
    at, end, kind, synced = _id3v2(data, s.tags), len(data), None, False
    if data[-128:-125] == b"TAG" and end - 128 >= at:
        end -= 128
        for name, low, high in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
            s.tags[f"id3v1 {name}"] = data[end + low : end + high].split(b"\0")[0].decode("latin-1").rstrip()
    first = True
    while at < end:
        h = header(data[at : at + 4]) if synced else _confirmed(data, at, end, kind) or kind and _confirmed(data, at, end, None, 2)
        if synced and (h is None or h.kind != kind):
            s.resyncs, synced = s.resyncs + 1, False
            continue
        if h is None:
            found = data.find(b"\xff", at + 1, end)
            s.skipped += (found if found >= 0 else end) - at
            at = found if found >= 0 else end
            continue
        if at + h.size > end:
            s.truncated = True
            s.skipped += end - at
            break
        synced, kind = True, h.kind
        if h.protected:
            body = data[at + 6 : at + 6 + 64]
            if len(body) * 8 >= (bits := protected_bits(h, body)):
                s.checked += 1
                s.bad += checksum(data[at + 2 : at + 4], body[: (bits + 7) // 8], bits) != int.from_bytes(data[at + 4 : at + 6], "big")
        found = _vbr_table(data[at : at + h.size], h) if first else {}
        first = False
        if found:
            s.table = found
        else:
            s.frames.append((at, h.size, h))
            s.samples += h.samples
            s.durations[h.rate] = s.durations.get(h.rate, 0) + h.samples
            s.rate = h.rate
        at += h.size
    return s


# -- writing ----------------------------------------------------------------------------------------
_RATE, _SIDE = 48000, 17  # mono, MPEG 1 Layer III: 24 ms a frame, and no padding at any bitrate


@lru_cache(maxsize=16)
def _silent_head(index: int) -> tuple[bytes, int]:
    """Header, checksum and side information of a mono frame without coded audio; the frame's size."""
    head = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    side = bytes(_SIDE)
    return head + checksum(head[2:], side, 8 * _SIDE).to_bytes(2, "big") + side, header(head).size


def _text_frame(name: bytes, text: str) -> bytes:
    body = b"\3" + text.encode()
    size = len(body)
    return name + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + b"\0\0" + body


def store(payload: bytes) -> bytes:
    """The payload as an MPEG stream, byte for byte in its frames' ancillary data."""
    largest = len(BITRATES[True, 3]) - 1
    head, size = _silent_head(largest)
    room = size - len(head)
    full, rest = divmod(len(payload), room)
    parts = []
    for i in range(full):
        parts += (head, payload[i * room : (i + 1) * room])
    offsets = [i * size for i in range(full)]
    total = full * size
    if rest:
        index = next(i for i in range(1, largest + 1) if _silent_head(i)[1] - len(head) >= rest)
        last, last_size = _silent_head(index)
        parts += (last, payload[full * room :], bytes(last_size - len(last) - rest))
        offsets.append(total)
        total += last_size
    table_head, table_size = _silent_head(4)
    frames, total = len(offsets), total + table_size
    seek = bytes(min(255, 256 * (table_size + offsets[p * frames // 100]) // total) for p in range(100))
    info = table_head + b"Xing" + struct.pack(">III", 7, frames, total) + seek
    tag = _text_frame(b"TXXX", f"payload_bytes\0{len(payload)}") + _text_frame(b"TSSE", "lossless payload in ancillary data")
    n = len(tag)
    return b"".join([b"ID3\4\0\0", bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]), tag, info, bytes(table_size - len(info)), *parts])


def stored_payload(data: bytes, s: Stream) -> bytes:
    """The payload read back from a parsed stream that ``store`` made."""
    skip = 6 + _SIDE
    return b"".join([data[at + skip : at + size] for at, size, _ in s.frames])[: int(s.tags["payload_bytes"])]


def payload_of(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def feature(s: Stream) -> str:
    """Frames, exact duration, bitrates, checksums, and the digest of all seek offsets with the first and last."""
    offsets = [at for at, _, _ in s.frames]
    bitrates = sorted({h.bitrate // 1000 for _, _, h in s.frames})
    digest = zlib.crc32(",".join(map(str, offsets)).encode())
    return f"frames={len(offsets)};samples={s.samples};rate={s.rate};kbps={'/'.join(map(str, bitrates))};table={s.table.get('table', '')};table_frames={s.table.get('frames', '')};crc_ok={s.checked - s.bad}/{s.checked};first={offsets[0] if offsets else ''};last={offsets[-1] if offsets else ''};seek_crc32={digest}"


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """The contract's columns; with ``full`` also media (binary), duration_samples, rate and seek_offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for value in batch.column(text_col).cast(pa.binary()):
                raw = value.as_py() or b""
                media = store(payload_of(raw))
                s = parse(media)
                back = stored_payload(media, s)
                row = [len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(s)]
                rows.append(row + ([media, s.samples, s.rate, [at for at, _, _ in s.frames]] if full else []))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, *names])

    long, text = pa.int64(), pa.string()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [long, long, text, long, long, text, text]
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if full:
        names += ["media", "duration_samples", "rate", "seek_offsets"]
        kinds += [pa.binary(), long, long, pa.list_(long)]
        schema += ", media binary, duration_samples long, rate long, seek_offsets array<long>"
    return df.select(id_col, text_col).mapInArrow(run, schema)


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), full=False)
