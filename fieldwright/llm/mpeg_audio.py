"""MPEG audio columns: lossless payload frames, and a reader that resynchronises, verifies and indexes frames.

The writer makes an MPEG-1 Layer III stream of silent frames (empty side
information, hence no main data) whose ancillary bytes carry the payload, 576 a
frame, with a checksum in each frame, an ID3v2 tag that holds the unpadded
length, and an Info frame with frame count, byte count and seek table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.llm import exchange as X
from fieldwright.llm import text as T

UNIT = 576
PAD = 255
#: Fixed values of the format: kbit/s by (version 1 or 2, layer) and index, Hz by version bits and index.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_HEADER = bytes([0xFF, 0xFA, 0xC4, 0xC0])  # MPEG-1 Layer III, checksum, 224 kbit/s, 48 kHz, one channel: 672 bytes
_SIDE = 17
_FRAME = 672
_BODY = 4 + 2 + _SIDE
_TAG = _FRAME - 128
#: Where the payload lies in a frame: not where a reader would look for the letters TAG of an ID3v1 tag, if the frame is the last.
_PLACES = np.r_[_BODY:_TAG, _TAG + 3 : _BODY + UNIT + 3]


def _crc_table() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out[i] = c
    return out


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The format's checksum of each row of bytes."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ _CRC[(c >> np.uint16(8)) ^ rows[:, k]]
    return c


_CHECK = int(crc16(np.frombuffer(_HEADER[2:] + bytes(_SIDE), np.uint8)[None, :])[0]).to_bytes(2, "big")


def _syncsafe(n: int) -> bytes:
    return bytes([(n >> 21) & 127, (n >> 14) & 127, (n >> 7) & 127, n & 127])


def pad_payload(data: bytes, unit: int = UNIT) -> bytes:
    """The data with bytes 255 up to a positive multiple of the unit."""
    return data + bytes([PAD]) * (max(unit, -(-len(data) // unit) * unit) - len(data))


def write_stream(data: bytes) -> bytes:
    """An MPEG audio stream that carries the padded data, and its unpadded length in a tag."""
    payload = pad_payload(data)
    n = len(payload) // UNIT
    frames = np.zeros((n, _FRAME), np.uint8)
    frames[:, :6] = np.frombuffer(_HEADER + _CHECK, np.uint8)
    frames[:, _PLACES] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    toc = bytes(min(255, 256 * (i * n // 100 + 1) // (n + 1)) for i in range(100))
    info = b"Info" + struct.pack(">III", 7, n, (n + 1) * _FRAME) + toc
    head = _HEADER + _CHECK + bytes(_SIDE) + info
    text = b"\x03bytes\x00" + str(len(data)).encode()
    tag = b"TXXX" + _syncsafe(len(text)) + b"\x00\x00" + text
    return b"ID3\x04\x00\x00" + _syncsafe(len(tag)) + tag + head + bytes(_FRAME - len(head)) + frames.tobytes()


@dataclass
class Stream:
    """What is known of a stream: tags, the frames' offsets and lengths (the table's own frame apart), and what failed."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    lengths: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    samples: int = 0  # of one channel, over all frames
    hertz: int = 0
    kind: str = "none"
    channels: int = 0
    kbits: tuple[int, int] = (0, 0)
    checked: int = 0
    damaged: int = 0
    skipped: int = 0  # bytes that belong to no frame and no tag
    table: str = "none"  # Xing, Info or VBRI
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""

    @property
    def seconds(self) -> float:
        return self.samples / self.hertz if self.hertz else 0.0


def _frame(b: bytes, at: int):
    """(length, samples, hertz, version bits, layer, kbit/s, channels, has checksum) of the header here, or None."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = (b[at + 1] >> 3) & 3, 4 - ((b[at + 1] >> 1) & 3)
    rate, hertz = b[at + 2] >> 4, (b[at + 2] >> 2) & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3:
        return None
    first = version == 3
    kbits, hz = KBITS[1 if first else 2, layer][rate], HERTZ[version][hertz]
    pad = (b[at + 2] >> 1) & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12000 * kbits // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hz + pad
    return length, samples, hz, version, layer, kbits, 1 if b[at + 3] >> 6 == 3 else 2, not b[at + 1] & 1


def _tags(b: bytes, out: Stream) -> tuple[int, int]:
    """Where the frames can begin and end, between an ID3v2 tag in front and an ID3v1 tag behind."""
    lo, hi = 0, len(b)
    if b[:3] == b"ID3" and len(b) >= 10:
        size = (b[6] & 127) << 21 | (b[7] & 127) << 14 | (b[8] & 127) << 7 | (b[9] & 127)
        lo, at = min(len(b), 10 + size + (10 if b[5] & 16 else 0)), 10
        wide = b[3] == 4
        while at + 10 <= min(lo, 10 + size) and b[at]:
            n = int.from_bytes(b[at + 4 : at + 8], "big") if not wide else (b[at + 4] & 127) << 21 | (b[at + 5] & 127) << 14 | (b[at + 6] & 127) << 7 | (b[at + 7] & 127)
            name, body = b[at : at + 4].decode("latin-1"), b[at + 10 : at + 10 + n]
            if name.startswith("T") and body:
                text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3], "replace")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                out.tags[key] = value.rstrip("\0")
            at += 10 + n
    if hi - lo >= 128 and b[hi - 128 : hi - 125] == b"TAG":
        hi -= 128
        out.tags.setdefault("TIT2", b[hi + 3 : hi + 33].rstrip(b"\0 ").decode("latin-1"))
    return lo, hi


def _table(b: bytes, at: int, head, out: Stream) -> bool:
    """Read a variable-bitrate table, if this frame holds one."""
    length, _, _, version, layer, _, channels, checked = head
    side = (17 if channels == 1 else 32) if version == 3 else (9 if channels == 1 else 17)
    for p in (at + 4 + side, at + 4 + side + 2 * checked):
        name = b[p : p + 4]
        if layer == 3 and name in (b"Xing", b"Info"):
            flags = int.from_bytes(b[p + 4 : p + 8], "big")
            q = p + 8
            if flags & 1:
                out.table_frames, q = int.from_bytes(b[q : q + 4], "big"), q + 4
            if flags & 2:
                out.table_bytes, q = int.from_bytes(b[q : q + 4], "big"), q + 4
            if flags & 4:
                out.toc = b[q : q + 100]
            out.table = name.decode()
            return True
    if b[at + 36 : at + 40] == b"VBRI":
        out.table, out.table_bytes, out.table_frames = "VBRI", int.from_bytes(b[at + 46 : at + 50], "big"), int.from_bytes(b[at + 50 : at + 54], "big")
        return True
    return False


def read_stream(b: bytes) -> Stream:
    """Find the frames of a stream.

    A header counts if the next frame's header (same version, layer and rate) or the end follows it; otherwise the search
    goes on a byte further. Free-format streams (bitrate index 0) have no frames here. Checksums are verified for Layer
    III, where they cover a fixed part of the frame.
    """
    out = Stream()
    lo, hi = _tags(b, out)
    buf = np.frombuffer(b, np.uint8)
    offsets, lengths, at, first = [], [], lo, True
    kbits: list[int] = []
    while at + 4 <= hi:
        head = _frame(b, at)
        if head is None or at + head[0] > hi or ((nxt := at + head[0]) + 4 <= hi and ((f := _frame(b, nxt)) is None or f[2:5] != head[2:5])):
            step = b.find(b"\xff", at + 1, hi)
            step = hi if step < 0 else step
            out.skipped += step - at
            at = step
            continue
        length, samples, hz, version, layer, rate, channels, checked = head
        if first:
            first = False
            out.hertz, out.channels = hz, channels
            out.kind = f"MPEG-{ {3: '1', 2: '2', 0: '2.5'}[version] } Layer { 'I' * layer }"
            if _table(b, at, head, out):
                at += length
                continue
        # equal headers at equal distances are taken at once
        n = 1
        most = (hi - at) // length
        if most > 1:
            rows = buf[at : at + most * length].reshape(most, length)
            same = (rows[:, :4] == rows[0, :4]).all(axis=1)
            n = most if same.all() else int(np.argmin(same))
            if n < most or at + n * length + 4 <= hi:  # the last must be followed by a header, or its own check decides
                n = max(1, n - 1)
        else:
            rows = buf[at : at + length].reshape(1, length)
        if checked and layer == 3:
            side = (17 if channels == 1 else 32) if version == 3 else (9 if channels == 1 else 17)
            if length >= 6 + side:
                part = rows[:n]
                found = crc16(np.concatenate([part[:, 2:4], part[:, 6 : 6 + side]], axis=1))
                want = (part[:, 4].astype(np.uint16) << np.uint16(8)) | part[:, 5]
                out.checked += n
                out.damaged += int((found != want).sum())
        offsets.append(at + length * np.arange(n))
        lengths.append(np.full(n, length))
        kbits += [rate]
        out.samples += n * samples
        at += n * length
    out.skipped += max(0, hi - at)
    if offsets:
        out.offsets, out.lengths = np.concatenate(offsets), np.concatenate(lengths)
        out.kbits = min(kbits), max(kbits)
    return out


def payload_of(b: bytes, s: Stream) -> bytes:
    """The payload that write_stream put into the frames, with its padding."""
    if not len(s.offsets):
        return b""
    buf = np.frombuffer(b, np.uint8)
    if s.offsets[0] + _FRAME * len(s.offsets) <= len(b) and (np.diff(s.offsets) == _FRAME).all():
        lo = int(s.offsets[0])
        return buf[lo : lo + _FRAME * len(s.offsets)].reshape(-1, _FRAME)[:, _PLACES].tobytes()
    return b"".join(b[o + _BODY : o + _TAG] + b[o + _TAG + 3 : o + _BODY + UNIT + 3] for o in s.offsets.tolist())


def whole_payload(b: bytes, s: Stream) -> bytes:
    """The payload of a stream of write_stream; raises where frames or bytes are missing."""
    p = payload_of(b, s)
    if s.table_frames != len(s.offsets) or len(p) < int(s.tags["bytes"]):
        raise ValueError(f"{len(s.offsets)} of {s.table_frames} frames, {len(p)} payload bytes for {s.tags['bytes']}")
    return p


def describe(s: Stream) -> str:
    if s.kind == "none":
        return "none"
    agrees = "none" if s.table == "none" else f"{s.table}:{'ok' if s.table_frames in (None, len(s.offsets)) else 'differs'}"
    rate = f"{s.kbits[0]}" if s.kbits[0] == s.kbits[1] else f"{s.kbits[0]}-{s.kbits[1]}"
    return f"{s.kind}, {s.hertz} Hz, {s.channels} ch, {rate} kbit/s, {len(s.offsets)} frames, {s.samples}/{s.hertz} s, checksums {s.checked - s.damaged}/{s.checked}, table {agrees}, skipped {s.skipped}"


def _write(batches):
    for batch in batches:
        buf, starts, ends = T.text_bytes(batch.column(1))
        for lo, hi in T.slices(starts, ends):
            media = [write_stream(buf[a:b].tobytes()) for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
            found = [read_stream(x) for x in media]  # what is stored beside a stream is what its bytes say
            columns = [pa.array(media, pa.binary()), pa.array([x.samples for x in found], pa.int64()), pa.array([x.hertz for x in found], pa.int32()), pa.array([x.offsets for x in found], pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *columns], names=["doc_id", "media", "samples", "hertz", "offsets"])


_MEDIA_DDL = "doc_id long, media binary, samples long, hertz int, offsets array<long>"
#: Samples in a frame of the streams that are written.
SAMPLES = 1152


def encode_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media, samples, hertz, offsets): each text's UTF-8 bytes as an MPEG audio stream, with its exact duration
    (samples / hertz seconds) and the byte offset of each frame, to seek by (`seek`).

    Null texts are empty and still one frame; rows with equal or null ids, and repeated rows, are streams of their own;
    a very long text is one long stream; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return X.arrow(rows, _write, _MEDIA_DDL)


def seek(offsets: Column, hertz: Column, seconds: Column) -> Column:
    """Byte offset of the frame that sounds at a time; null beyond the stream's end or before its start."""
    frame = F.floor(seconds * hertz / SAMPLES).cast("int")
    return F.when(frame >= 0, F.get(offsets, frame))


_READ_DDL = (
    "doc_id long, kind string, hertz int, channels int, samples long, n_frames long, offsets array<long>, checked long, damaged long, skipped long,"
    " table string, table_frames long, tags map<string,string>, n_bytes long, payload binary, feature string"
)


def _read(with_offsets: bool, with_payload: bool):
    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for ident, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = media.as_buffer().to_pybytes() if media.is_valid else b""
                s = read_stream(b)
                p = payload_of(b, s) if with_payload else None
                rows.append((ident, s.kind, s.hertz, s.channels, s.samples, len(s.offsets), s.offsets if with_offsets else None, s.checked, s.damaged, s.skipped, s.table, s.table_frames, list(s.tags.items()), int(s.tags["bytes"]) if s.tags.get("bytes", "").isdigit() else None, p, describe(s)))
                size += len(b)
                if size > 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return run


def _batch(rows) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.binary(), pa.string()]
    names = [x.strip().split(" ")[0] for x in _READ_DDL.replace("map<string,string>", "map").split(",")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def parse_audio(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", offsets: bool = True, payload: bool = True) -> DataFrame:
    """Read streams: what they are, exact duration (samples / hertz), frame offsets, checksums, tags, tables and payload.

    Null and empty streams and those without a frame have kind 'none', no samples and no offsets; rows with equal or null
    ids, and repeated rows, are read each; a very long stream is read whole; other columns are ignored; an empty table
    gives no rows.
    """
    rows = media.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{media_col}`").alias("media"))
    return X.arrow(rows, _read(offsets, payload), _READ_DDL)


_OP2_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches):
    for batch in batches:
        rows = []
        for ident, media, samples, offsets in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(4), strict=True):
            b = media.as_buffer().to_pybytes()
            s = read_stream(b)
            p = whole_payload(b, s)
            if samples != s.samples or not np.array_equal(offsets.values.to_numpy(), s.offsets):
                raise ValueError(f"document {ident}: its frames are not where its stored offsets say")
            rows.append((ident, int(s.tags["bytes"]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(b), hashlib.sha256(b).hexdigest(), describe(s)))
        if rows:
            c = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(x, pa.string() if k in (3, 6, 7) else pa.int64()) for k, x in enumerate(c)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored stream, read back; nulls, repeats, long texts and empty tables as in `encode_audio`."""
    stored = X.keep(encode_audio(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return X.arrow(stored, _digest, _OP2_DDL)
