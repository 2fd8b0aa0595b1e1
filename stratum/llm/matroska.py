"""Matroska as media columns: a lossless muxer of 8-bit samples and a packet-table parser.

The parser reads variable-length EBML element ids and sizes (unknown sizes included), walks
segments, clusters, simple blocks and block groups, undoes every lacing (none, Xiph, fixed,
EBML) and reads cues, giving one row per packet with track, timestamp and byte range.

Defined results: a null or empty text stores one frame of spaces; bytes that are not EBML give
an empty packet table with an error text instead of raising; texts of any length are stored
whole; equal texts give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, utf8

#: Element ids, fixed values of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, LACING_FLAG = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
DEFAULT_DURATION, AUDIO, RATE, CHANNELS, DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, VOID = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xEC
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

FRAME_BYTES = 192
SAMPLE_RATE = 8000
FRAME_MS = FRAME_BYTES * 1000 // SAMPLE_RATE
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 64


def write_id(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def write_size(n: int) -> bytes:
    """Shortest variable-length size; a value of all ones is reserved for unknown."""
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def element(i: int, body: bytes) -> bytes:
    return write_id(i) + write_size(len(body)) + body


def uint(i: int, n: int) -> bytes:
    return element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def number(i: int, x: float) -> bytes:
    return element(i, struct.pack(">d", x))


HEADER = element(EBML, uint(VERSION, 1) + uint(READ_VERSION, 1) + uint(MAX_ID, 4) + uint(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ, 2))
TRACK_TABLE = element(
    TRACKS,
    element(
        TRACK,
        uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(LACING_FLAG, 1) + element(CODEC, b"A_PCM/INT/LIT")
        + uint(DEFAULT_DURATION, FRAME_MS * 1_000_000)
        + element(AUDIO, number(RATE, float(SAMPLE_RATE)) + uint(CHANNELS, 1) + uint(DEPTH, 8)),
    ),
)


def padded(data: bytes) -> bytes:
    """Spaces appended up to a positive multiple of the frame size."""
    return data + b" " * (-len(data) % FRAME_BYTES if data else FRAME_BYTES)


def mux(payload: bytes) -> bytes:
    """One 8-bit mono track; equal frames share fixed-size lacing; a cue for every cluster."""
    info = element(INFO, uint(SCALE, 1_000_000) + number(DURATION, len(payload) / FRAME_BYTES * FRAME_MS) + element(MUXER, b"stratum") + element(WRITER, b"stratum"))
    block_bytes = FRAME_BYTES * FRAMES_PER_BLOCK
    cluster_bytes = block_bytes * BLOCKS_PER_CLUSTER
    body = [info, TRACK_TABLE]
    at, cues = len(info) + len(TRACK_TABLE), []
    for start in range(0, len(payload), cluster_bytes):
        time = start // FRAME_BYTES * FRAME_MS
        blocks = [uint(TIMESTAMP, time)]
        stop = min(start + cluster_bytes, len(payload))
        for b in range(start, stop, block_bytes):
            data = payload[b : min(b + block_bytes, stop)]
            frames = len(data) // FRAME_BYTES
            head = b"\x81" + struct.pack(">h", (b - start) // FRAME_BYTES * FRAME_MS)
            head += b"\x84" + bytes([frames - 1]) if frames > 1 else b"\x80"
            blocks.append(element(SIMPLE_BLOCK, head + data))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        cluster = element(CLUSTER, b"".join(blocks))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return HEADER + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    """What one file holds. packets: (track, timestamp ns, first byte, bytes, key frame)."""

    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    error: str | None = None


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """Value and the place after it; -1 for an unknown size."""
    first = data[at]
    if not first:
        raise ValueError(f"bad variable-length integer at byte {at}")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError(f"truncated at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def children(data: bytes, at: int, stop: int):
    """(id, first byte of the body, end of the body, place of the element) of each element in a range."""
    while at < stop:
        place = at
        i, at = read_vint(data, at, True)
        n, at = read_vint(data, at)
        end = stop if n < 0 else at + n
        if end > stop:
            raise ValueError(f"element {i:#x} at byte {place} runs past its parent")
        if n < 0 and i == CLUSTER:
            end = next_top_level(data, at, stop)
        yield i, at, end, place
        at = end


def next_top_level(data: bytes, at: int, stop: int) -> int:
    """End of a cluster of unknown size: where the next top-level element begins."""
    while at < stop:
        i, body = read_vint(data, at, True)
        if i in (CLUSTER, CUES, INFO, TRACKS):
            return at
        n, body = read_vint(data, body)
        at = body + n
    return stop


def laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames. kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if kind == 0:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    if kind == 2:
        each, rest = divmod(end - at, count)
        if rest:
            raise ValueError("fixed lacing of unequal frames")
        return [(at + k * each, each) for k in range(count)]
    sizes: list[int] = []
    for k in range(count - 1):
        if kind == 1:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        elif k == 0:
            n, at = read_vint(data, at)
        else:
            width = 9 - data[at].bit_length()
            step, at = read_vint(data, at)
            if step < 0:
                step = (1 << 7 * width) - 1
            n = sizes[-1] + step - ((1 << (7 * width - 1)) - 1)
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing sizes exceed the block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def parse(data: bytes | None) -> Media:
    """Packet table, tracks and cues of a file. What was read before a fault is kept with the fault's text."""
    media = Media()
    try:
        if not data or int.from_bytes(data[:4], "big") != EBML:
            raise ValueError("no EBML header")
        for i, at, end, _ in children(data, 0, len(data)):
            if i == SEGMENT:
                read_segment(media, data, at, end)
    except (ValueError, IndexError, struct.error) as e:
        media.error = str(e)
    return media


def read_segment(media: Media, data: bytes, start: int, stop: int) -> None:
    for i, at, end, place in children(data, start, stop):
        if i == INFO:
            for j, a, e, _ in children(data, at, end):
                if j == SCALE:
                    media.scale = int.from_bytes(data[a:e], "big")
        elif i == TRACKS:
            for j, a, e, _ in children(data, at, end):
                if j == TRACK:
                    own = {k: data[x:y] for k, x, y, _ in children(data, a, e)}
                    media.tracks[int.from_bytes(own.get(TRACK_NUMBER, b""), "big")] = {
                        "codec": own.get(CODEC, b"").decode("latin-1"),
                        "frame_ns": int.from_bytes(own.get(DEFAULT_DURATION, b""), "big"),
                        "kind": int.from_bytes(own.get(TRACK_TYPE, b""), "big"),
                    }
        elif i == CLUSTER:
            media.clusters.append(place - start)
            read_cluster(media, data, at, end)
        elif i == CUES:
            for j, a, e, _ in children(data, at, end):
                if j == CUE_POINT:
                    time = 0
                    for k, x, y, _ in children(data, a, e):
                        if k == CUE_TIME:
                            time = int.from_bytes(data[x:y], "big")
                        elif k == CUE_POSITIONS:
                            own = {m: int.from_bytes(data[u:v], "big") for m, u, v, _ in children(data, x, y)}
                            media.cues.append((time, own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER, 0)))


def read_cluster(media: Media, data: bytes, start: int, stop: int) -> None:
    base = 0
    for i, at, end, _ in children(data, start, stop):
        if i == TIMESTAMP:
            base = int.from_bytes(data[at:end], "big")
        elif i == SIMPLE_BLOCK:
            read_block(media, data, at, end, base, None)
        elif i == BLOCK_GROUP:
            own = [(j, a, e) for j, a, e, _ in children(data, at, end)]
            for j, a, e in own:
                if j == BLOCK:
                    read_block(media, data, a, e, base, not any(k == 0xFB for k, _, _ in own))


def read_block(media: Media, data: bytes, at: int, end: int, base: int, key: bool | None) -> None:
    track, at = read_vint(data, at)
    time = (base + struct.unpack_from(">h", data, at)[0]) * media.scale
    flags = data[at + 2]
    step = media.tracks.get(track, {}).get("frame_ns", 0)
    for k, (a, n) in enumerate(laced(data, at + 3, end, flags >> 1 & 3)):
        media.packets.append((track, time + k * step, a, n, bool(flags & 0x80) if key is None else key))


def read_back(data: bytes, media: Media, track: int = 1) -> bytes:
    """The samples of a track, cut out of the file by the packet table's byte ranges."""
    return b"".join([data[a : a + n] for t, _, a, n, _ in media.packets if t == track])


def features(media: Media, payload: bytes) -> str:
    """Counts of the packet table and moments of the samples that were read back."""
    x = np.frombuffer(payload, np.uint8)
    spread = np.bincount(x, minlength=256)
    p = spread[spread > 0] / max(1, x.size)
    entropy = float(-(p * np.log2(p)).sum()) if x.size else 0.0
    last = max((t for _, t, _, _, _ in media.packets), default=0)
    return (
        f"tracks={len(media.tracks)};clusters={len(media.clusters)};packets={len(media.packets)};cues={len(media.cues)};"
        f"last_ms={last // 1_000_000};mean={x.mean() if x.size else 0:.4f};std={x.std() if x.size else 0:.4f};entropy={entropy:.4f}"
    )


def store_documents(docs: DataFrame) -> DataFrame:
    """doc_id and the Matroska file (binary) of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = [mux(padded(utf8(t))) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "media": pa.array(files, pa.binary())})

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, media binary")


def packet_table(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per packet of every file: key, track, pts_ns, byte_offset, byte_length, keyframe."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(k, *p) for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in parse(data).packets]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["k", "track", "pts_ns", "byte_offset", "byte_length", "keyframe"])

    kind = files.schema[key].dataType.simpleString()
    out = map_batches(files.select(key, media), run, f"k {kind}, track int, pts_ns bigint, byte_offset bigint, byte_length bigint, keyframe boolean")
    return out.withColumnRenamed("k", key)


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text, read it back through the packet table and describe both.

    One map without a shuffle; memory is bounded by one Arrow batch and one file."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            raw = utf8(text)
            stored = mux(padded(raw))
            media = parse(stored)
            if media.error:
                raise ValueError(media.error)
            back = read_back(stored, media)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(media, back)))
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", *names])

    return map_batches(
        docs.select("doc_id", "text"), run,
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    )
