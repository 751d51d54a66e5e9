"""Texts as Matroska audio: written, and parsed back into packet tables.

A file has one PCM track of 8-bit samples at 8 kHz.  A frame is FRAME bytes of payload (24 ms);
FRAMES frames share a SimpleBlock with fixed-size lacing, blocks lie in clusters, and a cue points
at the first block of each cluster.  The parser reads elements of any nesting that it needs:
variable-length ids and sizes, unknown sizes, SimpleBlock and BlockGroup, all four kinds of lacing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from invoicefields.llm.common import map_blocks, utf8

FRAME, RATE, FRAMES, BLOCKS_PER_CLUSTER = 192, 8000, 16, 64
FRAME_MS = FRAME * 1000 // RATE
# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
SAMPLING, CHANNELS, BIT_DEPTH, SCALE = 0xB5, 0x9F, 0x6264, 0x2AD7B1
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
VERSION, READ_VERSION, ID_LENGTH, SIZE_LENGTH, DOC_TYPE, DOC_VERSION, DOC_READ = (
    0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285)
FRAME_TIME = 0x23E383
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
#: Elements whose numbers are their own; those of others belong to the element around them.
SCOPES = {SEGMENT, CLUSTER, CUE_POINT, TRACK_ENTRY}
NUMBERS = {TIMESTAMP, CUE_TIME, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE, TRACK_NUMBER, TRACK_TYPE, FRAME_TIME}
MILLISECOND = 1_000_000
#: The format itself nests four deep.
DEEPEST = 16


def vint(value: int) -> bytes:
    """A size as a variable-length number; all ones mean unknown and are avoided."""
    length = 1
    while value >= (1 << 7 * length) - 1:
        length += 1
    return (value | 1 << 7 * length).to_bytes(length, "big")


def element(number: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def unsigned(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


_HEADER = element(EBML, unsigned(VERSION, 1), unsigned(READ_VERSION, 1), unsigned(ID_LENGTH, 4),
                  unsigned(SIZE_LENGTH, 8), element(DOC_TYPE, b"matroska"), unsigned(DOC_VERSION, 4),
                  unsigned(DOC_READ, 2))
_START = element(INFO, unsigned(SCALE, MILLISECOND)) + element(TRACKS, element(
    TRACK_ENTRY, unsigned(TRACK_NUMBER, 1), unsigned(TRACK_UID, 1), unsigned(TRACK_TYPE, 2),
    unsigned(FRAME_TIME, FRAME_MS * MILLISECOND), element(CODEC, b"A_PCM/INT/LIT"), element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)),
                                              unsigned(CHANNELS, 1), unsigned(BIT_DEPTH, 8))))


def write(payload: bytes) -> bytes:
    """A file whose samples are ``payload``, a positive multiple of FRAME bytes."""
    step, per_cluster = FRAME * FRAMES, FRAME * FRAMES * BLOCKS_PER_CLUSTER
    parts, cues, at = [_START], [], len(_START)
    for start in range(0, len(payload), per_cluster):
        time = start // FRAME * FRAME_MS
        stamp, blocks = unsigned(TIMESTAMP, time), []
        for i in range(start, min(start + per_cluster, len(payload)), step):
            data = payload[i:i + step]
            offset = (i - start) // FRAME * FRAME_MS
            laces = len(data) // FRAME
            head = struct.pack(">BhB", 0x81, offset, 0x84 if laces > 1 else 0x80)
            blocks.append(element(SIMPLE_BLOCK, head, bytes([laces - 1]) if laces > 1 else b"", data))
        cluster = element(CLUSTER, stamp, *blocks)
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, time), element(
            CUE_POSITIONS, unsigned(CUE_TRACK, 1), unsigned(CUE_CLUSTER, at), unsigned(CUE_RELATIVE, len(stamp)))))
        parts.append(cluster)
        at += len(cluster)
    return _HEADER + element(SEGMENT, *parts, element(CUES, *cues))


class Packet(NamedTuple):
    track: int
    timestamp: int
    offset: int
    size: int
    keyframe: bool


class Track(NamedTuple):
    """``kind`` 1 is video, 2 audio; ``frame_time`` nanoseconds of a frame, 0 if not said."""

    kind: int
    codec: str
    frame_time: int


class Cue(NamedTuple):
    time: int
    track: int
    cluster: int
    relative: int


def _number(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """A variable-length number and where it ends; -1 for an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise ValueError(f"cut off at byte {at}")
    value = int.from_bytes(data[at:at + length], "big")
    if not keep_marker:
        value ^= 1 << 7 * length
        if value == (1 << 7 * length) - 1:
            value = -1
    return value, at + length


def elements(data: bytes, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """``id, start of body, end of body``; the children of a cluster of unknown size end where the
    next element of the segment begins."""
    while start < stop:
        number, at = _number(data, start, True)
        size, at = _number(data, at, False)
        if size < 0:
            end = stop
            if number == CLUSTER:
                end = at
                while end < stop and _number(data, end, True)[0] not in (CLUSTER, CUES, TRACKS, INFO):
                    _, body = _number(data, end, True)
                    inner, body = _number(data, body, False)
                    if inner < 0:
                        raise ValueError(f"an element of unknown size in a cluster, at byte {end}")
                    end = body + inner
        else:
            end = at + size
        if end > stop:
            raise ValueError(f"element at byte {start} is cut off")
        yield number, at, end
        start = end


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """``offset, size`` of the frames of a block."""
    if not lacing:
        return [(at, end - at)]
    if at >= end:
        raise ValueError(f"lacing is cut off at byte {at}")
    count, at, sizes = data[at] + 1, at + 1, []
    if lacing == 2:
        if (end - at) % count:
            raise ValueError(f"laces of unequal size at byte {at}")
        sizes = [(end - at) // count] * (count - 1)
    for i in range(count - 1 if lacing != 2 else 0):
        if lacing == 1:
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise ValueError(f"lacing is cut off at byte {at}")
            size, at = size + data[at], at + 1
        elif i == 0:
            size, at = _number(data, at, False)
        else:
            begin = at
            value, at = _number(data, at, False)
            length = at - begin
            full = value if value >= 0 else (1 << 7 * length) - 1
            size = sizes[-1] + full - ((1 << 7 * length - 1) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError(f"laces are longer than their block at byte {at}")
    out = []
    for size in [*sizes, last]:
        out.append((at, size))
        at += size
    return out


def parse_file(data: bytes) -> tuple[list[Packet], list[Cue], dict[int, Track]]:
    """Packets in the order stored, cues, and tracks by number.  Times are milliseconds, rounded down, by
    the file's own scale; a lace follows the one before it by its track's duration of a frame (without
    one, all laces have their block's time).  Raises ValueError on what is no such file, and where
    elements are nested deeper than DEEPEST."""
    found: list[tuple[int, int, int, int, int, bool]] = []
    points: list[Cue] = []
    tracks: dict[int, Track] = {}
    scale = MILLISECOND
    top = elements(data, 0, len(data))
    if next(top, (0,))[0] != EBML:
        raise ValueError("no EBML header")
    # what is open: its elements, its kind, and the numbers read so far in the cluster, cue or track
    stack: list[tuple[Iterator[tuple[int, int, int]], int, dict]] = [(top, 0, {})]
    while stack:
        inside, kind, own = stack[-1]
        number, at, end = next(inside, (0, 0, 0))
        if not number:
            stack.pop()
            if kind == CUE_POINT:
                points.append(Cue(*(own.get(k, -1) for k in (CUE_TIME, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE))))
            elif kind == TRACK_ENTRY:
                tracks[own.get(TRACK_NUMBER, 0)] = Track(own.get(TRACK_TYPE, 0), own.get(CODEC, b"").decode("ascii", "replace"),
                                                         own.get(FRAME_TIME, 0))
        elif number in MASTERS and (kind or number == SEGMENT):
            if len(stack) > DEEPEST:
                raise ValueError(f"nested deeper than {DEEPEST} elements at byte {at}")
            stack.append((elements(data, at, end), number, {} if number in SCOPES else own))
        elif number in (SIMPLE_BLOCK, BLOCK) and kind:
            track, body = _number(data, at, False)
            if body + 3 > end:
                raise ValueError(f"block at byte {at} is cut off")
            offset, flags = struct.unpack_from(">hB", data, body)
            key = bool(flags & 0x80) if number == SIMPLE_BLOCK else True
            for i, (place, size) in enumerate(_frames(data, body + 3, end, flags >> 1 & 3)):
                found.append((track, own.get(TIMESTAMP, 0) + offset, i, place, size, key))
        elif number == SCALE:
            scale = int.from_bytes(data[at:end], "big")
        elif number in NUMBERS:
            own[number] = int.from_bytes(data[at:end], "big")
        elif number == CODEC:
            own[CODEC] = data[at:end].rstrip(b"\0")
    packets = []
    for track, ticks, lace, place, size, key in found:
        later = lace * tracks[track].frame_time if track in tracks else 0
        packets.append(Packet(track, (ticks * scale + later) // MILLISECOND, place, size, key))
    return packets, [c._replace(time=c.time * scale // MILLISECOND if c.time >= 0 else -1) for c in points], tracks


def parse(data: bytes) -> tuple[list[Packet], list[Cue]]:
    """Packets in the order stored, and cues."""
    return parse_file(data)[:2]


def payload_of(text: bytes | None) -> bytes:
    """The bytes of a text and blanks up to a positive multiple of FRAME."""
    raw = text or b""
    return raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b" ")


def to_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` for every row: the text as a file.  Null counts as empty; rows that
    repeat give the same file again; other columns are ignored."""
    def work(block: pa.RecordBatch) -> dict:
        texts = utf8(block)
        return {"doc_id": block.column("doc_id"), "n_bytes": [len(t or b"") for t in texts],
                "media": [write(payload_of(t)) for t in texts]}

    return map_blocks(docs.select("doc_id", "text"), work, "doc_id LONG, n_bytes LONG, media BINARY")


def packet_table(media: DataFrame) -> DataFrame:
    """``doc_id, packet, track, timestamp, offset, size, keyframe, cue, track_type, codec, error``, a row for
    each packet.  ``cue``: a cue names its timestamp and track.  What is no such file, is nested beyond
    DEEPEST, or null, gives one row with ``error``."""
    names = ("doc_id", "packet", "track", "timestamp", "offset", "size", "keyframe", "cue", "track_type", "codec", "error")

    def work(block: pa.RecordBatch) -> dict:
        rows = []
        for doc_id, data in zip(block.column("doc_id").to_pylist(), block.column("media").to_pylist()):
            try:
                packets, cues, tracks = parse_file(data or b"")
                named = {(c.time, c.track) for c in cues}
                for i, p in enumerate(packets):
                    track = tracks.get(p.track, Track(0, "", 0))
                    rows.append((doc_id, i, *p, (p.timestamp, p.track) in named, track.kind or None, track.codec or None, None))
            except ValueError as e:
                rows.append((doc_id, *(None,) * 9, str(e)))
        return {k: [r[i] for r in rows] for i, k in enumerate(names)}

    ddl = ("doc_id LONG, packet INT, track LONG, timestamp LONG, offset LONG, size LONG, keyframe BOOLEAN, "
           "cue BOOLEAN, track_type LONG, codec STRING, error STRING")
    return map_blocks(media.select("doc_id", "media").withColumnRenamed("media", "text"),
                      lambda b: work(b.rename_columns(["doc_id", "media"])), ddl)


def feature(payload: bytes, packets: list[Packet], cues: list[Cue]) -> str:
    """Packets, cues, duration, and mean, deviation and sign changes of the samples around 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    mean = x.sum() / len(x)
    spread = max(0.0, float((x * x).sum()) / len(x) - mean * mean) ** 0.5
    crossings = int(np.count_nonzero((x[1:] < 128) != (x[:-1] < 128)))
    return (f"packets={len(packets)};cues={len(cues)};ms={len(packets) * FRAME_MS};mean={mean:.4f};"
            f"deviation={spread:.4f};crossings={crossings}")


def media_report(docs: DataFrame) -> DataFrame:
    """Per row: sizes and digests of the payload, read back from the stored file, and of the file."""
    def work(block: pa.RecordBatch) -> dict:
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        out: dict[str, list] = {k: [] for k in names}
        for data in block.column("text").to_pylist():
            packets, cues = parse(data)
            back = b"".join([data[p.offset:p.offset + p.size] for p in packets])
            for k, v in zip(names, (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data),
                                    hashlib.sha256(data).hexdigest(), feature(back, packets, cues))):
                out[k].append(v)
        return {"doc_id": block.column("doc_id"), "n_bytes": block.column("n_bytes"), **out}

    return map_blocks(to_media(docs).withColumnRenamed("media", "text"), work,
                      "doc_id LONG, n_bytes LONG, payload_bytes LONG, payload_sha256 STRING, tail_crc32 LONG, "
                      "media_bytes LONG, media_sha256 STRING, feature STRING")
