"""Media columns: Matroska files in a binary column, parsed into packet tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the Matroska format.
EBML, EBML_DOCTYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE, TRACKS, TRACK_ENTRY, DEFAULT_DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE, 0x23E383
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that hold elements, but for those that parse() takes apart itself.
_MASTERS = frozenset((EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, CUE_POINT))

FRAME = 576  # samples in a packet: 72 ms at RATE
RATE = 8000


@dataclass(frozen=True)
class Packet:
    track: int
    timestamp_ns: int | None  # None: a later frame of a lace, in a file that says no duration
    keyframe: bool
    offset: int
    size: int


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """A variable-length integer and the position after it; None for an unknown size (all value bits set)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"integer at byte {at} is cut off")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return None if value == (1 << 7 * width) - 1 else value, at + width


def elements(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of each element's contents between two positions."""
    end = len(data) if end is None else end
    while at < end:
        ident, at = vint(data, at, keep_marker=True)
        size, at = vint(data, at)
        stop = end if size is None else at + size
        if stop > end:
            raise ValueError(f"element {ident:#x} reaches beyond its parent")
        if size is None and ident == CLUSTER:  # ends where the next element of the segment's level begins
            stop = _unknown_end(data, at, end)
        yield ident, at, stop
        at = stop


def _unknown_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        ident, inner = vint(data, at, keep_marker=True)
        if ident in (CLUSTER, CUES, INFO, TRACKS):
            return at
        size, inner = vint(data, inner)
        at = inner + (size or 0)
    return end


def block_packets(data: bytes, at: int, end: int, base: int, keyframe: bool | None = None, *, scale: int = 1_000_000, durations: dict[int, int] | None = None, duration: int | None = None) -> list[Packet]:
    """The packets of one block: no lacing, Xiph, fixed-size or EBML lacing.

    Frame i of a lace begins i frame durations after the block: durations has them by track, in nanoseconds, else they
    are equal parts of duration, the block's own in units of scale. keyframe: None for a simple block, which has a flag.
    """
    track, at = vint(data, at)
    (relative,) = struct.unpack_from(">h", data, at)
    flags = data[at + 2]
    at += 3
    key = bool(flags & 0x80) if keyframe is None else keyframe
    lacing = flags >> 1 & 3
    if not lacing:
        return [Packet(track, (base + relative) * scale, key, at, end - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            total = 0
            while data[at] == 255:
                total, at = total + 255, at + 1
            sizes.append(total + data[at])
            at += 1
    elif lacing == 3:
        for i in range(n - 1):
            before = at
            value, at = vint(data, at)
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1))
    else:
        if (end - at) % n:
            raise ValueError("a fixed-size lace isn't a multiple of its frames")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    out = []
    each = (durations or {}).get(track) or (duration * scale / n if duration is not None else None)
    for i, size in enumerate(sizes):
        late = 0 if not i else None if each is None else round(i * each)
        out.append(Packet(track, None if late is None else (base + relative) * scale + late, key, at, size))
        at += size
    return out


def parse(data: bytes) -> tuple[list[Packet], list[tuple[int, int, int]], dict[str, int]]:
    """Packets, cues (time, track, byte of the cluster) and facts (scale, tracks, clusters) of a file."""
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    facts = {"scale": 1_000_000, "tracks": 0, "clusters": 0}
    durations: dict[int, int] = {}  # of a frame, by track

    def number(start: int, stop: int) -> int:
        return int.from_bytes(data[start:stop], "big")

    def group(start: int, stop: int, base: int) -> None:
        """A block with its duration, which may follow it; one that refers to other blocks is no keyframe."""
        inner = list(elements(data, start, stop))
        duration = next((number(a, b) for i, a, b in inner if i == BLOCK_DURATION), None)
        alone = all(i != REFERENCE_BLOCK for i, _, _ in inner)
        for i, a, b in inner:
            if i == BLOCK:
                packets.extend(block_packets(data, a, b, base, alone, scale=facts["scale"], durations=durations, duration=duration))

    def walk(at: int, end: int, base: int, origin: int) -> None:
        cue_time = cue_track = 0
        for ident, start, stop in elements(data, at, end):
            if ident == TIMESTAMP_SCALE:
                facts["scale"] = number(start, stop)
            elif ident == TIMESTAMP:
                base = number(start, stop)
            elif ident == SIMPLE_BLOCK:
                packets.extend(block_packets(data, start, stop, base, scale=facts["scale"], durations=durations))
            elif ident == BLOCK_GROUP:
                group(start, stop, base)
            elif ident == TRACK_ENTRY:
                facts["tracks"] += 1
                found = {i: number(a, b) for i, a, b in elements(data, start, stop) if i in (TRACK_NUMBER, DEFAULT_DURATION)}
                if DEFAULT_DURATION in found:
                    durations[found.get(TRACK_NUMBER, 0)] = found[DEFAULT_DURATION]
            elif ident == CUE_TIME:
                cue_time = number(start, stop)
            elif ident == CUE_POSITIONS:
                found = {i: number(a, b) for i, a, b in elements(data, start, stop)}
                cues.append((cue_time, found.get(CUE_TRACK, cue_track), origin + found.get(CUE_CLUSTER, 0)))
            elif ident in _MASTERS:
                facts["clusters"] += ident == CLUSTER
                walk(start, stop, base, start if ident == SEGMENT else origin)

    walk(0, len(data), 0, 0)
    for _, _, at in cues:
        if vint(data, at, keep_marker=True)[0] != CLUSTER:
            raise ValueError(f"a cue points to byte {at}, where no cluster begins")
    return packets, cues, facts


def _element(ident: int, body: bytes) -> bytes:
    n = len(body)
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + (n | 1 << 7 * width).to_bytes(width, "big") + body


def _uint(ident: int, value: int) -> bytes:
    return _element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


_HEAD = _element(EBML, _element(EBML_DOCTYPE, b"matroska"))
_LEAD = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000)) + _element(
    TRACKS,
    _element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1)
        + _uint(TRACK_UID, 1)
        + _uint(TRACK_TYPE, 2)
        + _uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE)
        + _element(CODEC_ID, b"A_PCM/INT/LIT")
        + _element(AUDIO, _element(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)),
    ),
)


def mux(samples: bytes, laced: int = 8, blocks: int = 32) -> bytes:
    """8-bit mono PCM, a multiple of FRAME bytes, as a Matroska file: EBML-laced blocks in clusters, then cues."""
    if not samples or len(samples) % FRAME:
        raise ValueError(f"samples must be a positive multiple of {FRAME} bytes")
    body, cues = [_LEAD], []
    at, step = len(_LEAD), FRAME * laced
    for start in range(0, len(samples), step * blocks):
        time = start * 1000 // RATE
        parts = [_uint(TIMESTAMP, time)]
        for a in range(start, min(start + step * blocks, len(samples)), step):
            data = samples[a : a + step]
            n = len(data) // FRAME
            head = b"\x81" + struct.pack(">h", a * 1000 // RATE - time)
            # EBML lacing: the first size in two bytes, then differences of zero in one byte each.
            lace = b"\x80" if n == 1 else b"\x86" + bytes([n - 1]) + (0x4000 | FRAME).to_bytes(2, "big") + b"\xbf" * (n - 2)
            parts.append(_element(SIMPLE_BLOCK, head + lace + data))
        cluster = _element(CLUSTER, b"".join(parts))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, time) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    return _HEAD + _element(SEGMENT, b"".join(body))


def payload(text: str | None) -> bytes:
    """UTF-8 of the text (null: empty), padded with bytes 255 to a positive multiple of FRAME."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def features(samples: bytes, packets: int) -> str:
    """Packets, mean, root mean square and mid-level crossings of unsigned 8-bit samples."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int32)
    high = x >= 128
    return f"{packets}:{x.mean():.4f}:{np.sqrt((x * x).mean()):.4f}:{int(np.count_nonzero(high[1:] != high[:-1]))}"


def store_texts(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a Matroska file. Null and empty texts make one padded packet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column("text").to_pylist()
                sizes = [len((t or "").encode("utf-8", "replace")) for t in texts]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array([mux(payload(t)) for t in texts], pa.binary())})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


PACKETS = "track int, timestamp_ns long, keyframe boolean, byte_offset long, byte_size long"


def packet_table(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """One row for each packet of each file: key, packet number, track, time and byte range in the file.

    Times are null only for later frames of laces whose file gives no duration. A null file has no packets; a broken
    one raises.
    """
    schema = f"{key} {media.schema[key].dataType.simpleString()}, packet long, {PACKETS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                if data.is_valid:
                    found, _, _ = parse(data.as_py())
                    yield pa.RecordBatch.from_pydict(
                        {
                            key: pa.array([name.as_py()] * len(found), batch.column(0).type),
                            "packet": pa.array(range(len(found)), pa.int64()),
                            "track": pa.array([p.track for p in found], pa.int32()),
                            "timestamp_ns": pa.array([p.timestamp_ns for p in found], pa.int64()),
                            "keyframe": pa.array([p.keyframe for p in found], pa.bool_()),
                            "byte_offset": pa.array([p.offset for p in found], pa.int64()),
                            "byte_size": pa.array([p.size for p in found], pa.int64()),
                        }
                    )

    return media.select(key, column).mapInArrow(run, schema)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, packets long, duration_ms long"


def digest(media: DataFrame) -> DataFrame:
    """Reads the stored bytes of store_texts() back through their packets and describes them, one row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, n, data in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
                found, _, _ = parse(data)
                read = b"".join(data[p.offset : p.offset + p.size] for p in found)
                rows.append((name, n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(read, len(found)), len(found), len(read) * 1000 // RATE))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in DIGEST.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)


def op10_matroska(spark, sf_dir: str) -> DataFrame:
    """The files are stored as a table in the shared folder, then read back and described, one row for each document.

    Null and empty texts are a packet of padding; repeated rows and ids are stored each, extra columns are ignored.
    """
    from .common import stored, table

    return digest(stored(store_texts(table(spark, sf_dir, "documents")), "media"))
