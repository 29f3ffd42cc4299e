"""Media columns in Matroska.

`mux` stores bytes losslessly as 8-bit PCM samples of one audio track: frames of `FRAME` samples, laced into
SimpleBlocks (fixed-size, Xiph and EBML lacing in turn), clusters of `CLUSTER_BLOCKS` blocks, and a cue for
each cluster.  `parse` reads any Matroska bytes: variable-length EBML elements of known and unknown size,
clusters, block groups and simple blocks, all kinds of lacing, and cues; it gives a packet table with
track, timestamp, duration, byte range, lacing and cluster.  The form depends on the payload alone.

Defined results
    null text          as the empty text: 64 zero bytes
    null media         no packets, no payload
    broken media       `parse` raises Broken; `packets` gives the row one packet with `error` set
    null doc_id        kept
    repeated rows      equal rows out
    empty table        empty result
    extra columns      ignored
Memory in a worker grows with the longest text.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

UNIT = 64  # payloads are multiples of it
RATE = 8000  # samples a second: 8 a millisecond, so 64 samples end on a whole one
FRAME = 1024
LACE = 8  # frames a block
CLUSTER_BLOCKS = 4

# Element ids, fixed by the format.
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
#: Elements that end a cluster, or a segment, of unknown size.
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}
LACINGS = ("none", "xiph", "fixed", "ebml")


class Broken(ValueError):
    """The bytes are not well-formed Matroska."""


# -- writing ---------------------------------------------------------------------------------------


def vint(n: int, width: int = 0) -> bytes:
    """A length in EBML's form, in the least width that holds it (all ones are kept for `unknown`)."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def signed_vint(n: int) -> bytes:
    """A difference of lace sizes: the value shifted into the positive range of its width."""
    width = next(w for w in range(1, 9) if abs(n) < (1 << 7 * w - 1))
    return vint(n + (1 << 7 * width - 1) - 1, width)


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(eid: int, n: int) -> bytes:
    return element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], kind: int) -> bytes:
    """Lace count, sizes and frames; kind: an index of LACINGS."""
    if kind == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    if kind == 1:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif kind == 3:
        head += vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            head += signed_vint(len(b) - len(a))
    return head + b"".join(frames)


def block(track: int, relative: int, frames: list[bytes], kind: int) -> bytes:
    return element(SIMPLE_BLOCK, vint(track) + struct.pack(">hB", relative, 0x80 | kind << 1) + laced(frames, kind))


def header() -> bytes:
    body = uint(VERSION, 1) + uint(READ_VERSION, 1) + uint(MAX_ID, 4) + uint(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ, 2)
    return element(EBML, body)


def mux(payload: bytes) -> bytes:
    """The payload, a positive multiple of 64 bytes, as one PCM track."""
    info = uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"tessera") + element(WRITING_APP, b"tessera")
    audio = element(SAMPLING, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8)
    track = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(AUDIO, audio)
    parts = [element(INFO, info), element(TRACKS, element(TRACK_ENTRY, track))]
    at, cues, n = sum(map(len, parts)), b"", 0
    per_block, per_cluster = FRAME * LACE, FRAME * LACE * CLUSTER_BLOCKS
    for first in range(0, len(payload), per_cluster):
        time, blocks = first * 1000 // RATE, []
        for b in range(first, min(first + per_cluster, len(payload)), per_block):
            frames = [payload[f : f + FRAME] for f in range(b, min(b + per_block, len(payload)), FRAME)]
            even = len(frames[-1]) == FRAME
            kind = 0 if len(frames) == 1 else (2, 1, 3)[n % 3] if even else (1, 3)[n % 2]
            blocks.append(block(1, b * 1000 // RATE - time, frames, kind))
            n += 1
        cues += element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at)))
        parts.append(element(CLUSTER, uint(CLUSTER_TIME, time) + b"".join(blocks)))
        at += len(parts[-1])
    parts.append(element(CUES, cues))
    return header() + element(SEGMENT, b"".join(parts))


# -- reading ---------------------------------------------------------------------------------------


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    default_ns: int = 0
    rate: float = 8000.0
    channels: int = 1
    bits: int = 0


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, Track] = field(default_factory=dict)
    #: (track, timestamp in ns, duration in ns, offset, size, keyframe, lacing, cluster)
    packets: list[tuple[int, int, int, int, int, bool, str, int]] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)  # offset in the segment, timestamp
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # timestamp, track, cluster's offset


def read_vint(data: bytes, at: int, stop: int) -> tuple[int, int, bool]:
    """Value, next place, and whether it stands for an unknown size."""
    if at >= stop or not data[at]:
        raise Broken(f"no length at {at}")
    width = 9 - data[at].bit_length()
    if at + width > stop:
        raise Broken(f"cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big") ^ 1 << 7 * width
    return value, at + width, value == (1 << 7 * width) - 1


def elements(data: bytes, at: int, stop: int):
    """(id, start, stop of its body) of each element; one of unknown size reaches to the next on its level."""
    while at < stop:
        if not data[at]:
            raise Broken(f"no element id at {at}")
        width = 9 - data[at].bit_length()
        eid = int.from_bytes(data[at : at + width], "big")
        size, body, unknown = read_vint(data, at + width, stop)
        end = stop if unknown else body + size
        if unknown and eid == CLUSTER:
            end = end_of_cluster(data, body, stop)
        if width > 4 or end > stop:
            raise Broken(f"element {eid:x} at {at} leaves its parent")
        yield eid, body, end
        at = end


def end_of_cluster(data: bytes, at: int, stop: int) -> int:
    while at < stop:
        width = 9 - data[at].bit_length() if data[at] else 5
        if width > 4:
            raise Broken(f"no element id at {at}")
        if int.from_bytes(data[at : at + width], "big") in TOP:
            return at
        size, body, unknown = read_vint(data, at + width, stop)
        if unknown:
            raise Broken(f"unknown size inside a cluster at {at}")
        at = body + size
    return stop


def number(data: bytes, s: int, e: int) -> int:
    return int.from_bytes(data[s:e], "big")


def real(data: bytes, s: int, e: int) -> float:
    if e - s not in (0, 4, 8):
        raise Broken(f"a float of {e - s} bytes")
    return struct.unpack(">d" if e - s == 8 else ">f", data[s:e])[0] if e > s else 0.0


def lace_sizes(data: bytes, at: int, stop: int, kind: int) -> tuple[list[int], int]:
    """Frame sizes of a block's content and the place of the first frame."""
    if kind == 0:
        return [stop - at], at
    if at >= stop:
        raise Broken("a lace without a count")
    count, at = data[at] + 1, at + 1
    if kind == 2:
        if (stop - at) % count:
            raise Broken("fixed lacing does not divide")
        return [(stop - at) // count] * count, at
    sizes: list[int] = []
    for k in range(count - 1):
        if kind == 1:
            size = 0
            while True:
                if at >= stop:
                    raise Broken("lace sizes are cut off")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
        else:
            start = at
            size, at, _ = read_vint(data, at, stop)
            if k:
                size = sizes[-1] + size - ((1 << 7 * (at - start) - 1) - 1)
        sizes.append(size)
    sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0:
        raise Broken("lace sizes pass the block's end")
    return sizes, at


def read_block(media: Media, data: bytes, s: int, e: int, time: int, key: bool | None, duration: int | None) -> None:
    number_, at, _ = read_vint(data, s, e)
    if at + 3 > e:
        raise Broken("a block without a header")
    relative, flags = struct.unpack_from(">hB", data, at)
    kind = flags >> 1 & 3
    sizes, at = lace_sizes(data, at + 3, e, kind)
    track = media.tracks.get(number_) or Track(number_)
    start = (time + relative) * media.scale
    each = track.default_ns or (duration or 0) * media.scale // len(sizes)
    for size in sizes:
        took = size * 1_000_000_000 // int(track.rate * track.channels * (track.bits // 8)) if track.codec.startswith("A_PCM") and track.bits >= 8 else each
        media.packets.append((number_, start, took, at, size, bool(flags & 0x80) if key is None else key, LACINGS[kind], len(media.clusters) - 1))
        start, at = start + took, at + size


def read_tracks(media: Media, data: bytes, s: int, e: int) -> None:
    for eid, a, b in elements(data, s, e):
        if eid != TRACK_ENTRY:
            continue
        t = Track()
        for sub, x, y in elements(data, a, b):
            if sub == TRACK_NUMBER:
                t.number = number(data, x, y)
            elif sub == TRACK_TYPE:
                t.kind = number(data, x, y)
            elif sub == CODEC_ID:
                t.codec = data[x:y].rstrip(b"\0").decode("ascii", "replace")
            elif sub == DEFAULT_DURATION:
                t.default_ns = number(data, x, y)
            elif sub == AUDIO:
                for own, p, q in elements(data, x, y):
                    if own == SAMPLING:
                        t.rate = real(data, p, q)
                    elif own == CHANNELS:
                        t.channels = number(data, p, q)
                    elif own == BIT_DEPTH:
                        t.bits = number(data, p, q)
        media.tracks[t.number] = t


def read_cluster(media: Media, data: bytes, s: int, e: int, offset: int) -> None:
    media.clusters.append((offset, 0))
    time = 0
    for eid, a, b in elements(data, s, e):
        if eid == CLUSTER_TIME:
            time = number(data, a, b)
            media.clusters[-1] = (offset, time)
        elif eid == SIMPLE_BLOCK:
            read_block(media, data, a, b, time, None, None)
        elif eid == BLOCK_GROUP:
            parts = {sub: (x, y) for sub, x, y in elements(data, a, b)}
            if BLOCK in parts:
                lasts = number(data, *parts[BLOCK_DURATION]) if BLOCK_DURATION in parts else None
                read_block(media, data, *parts[BLOCK], time, 0xFB not in parts, lasts)


def parse(data: bytes) -> Media:
    """Tracks, packets, clusters and cues of the first segment."""
    media, seen = Media(), False
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise Broken("no EBML header")
    for eid, s, e in top:
        if eid != SEGMENT or seen:
            continue
        seen = True
        previous = s
        for sub, a, b in elements(data, s, e):
            offset, previous = previous - s, b
            if sub == INFO:
                for own, x, y in elements(data, a, b):
                    if own == TIMESTAMP_SCALE:
                        media.scale = number(data, x, y)
                    elif own == DURATION:
                        media.duration = real(data, x, y)
            elif sub == TRACKS:
                read_tracks(media, data, a, b)
            elif sub == CLUSTER:
                read_cluster(media, data, a, b, offset)
            elif sub == CUES:
                for own, x, y in elements(data, a, b):
                    if own == CUE_POINT:
                        inner = list(elements(data, x, y))
                        time = next((number(data, p, q) for i, p, q in inner if i == CUE_TIME), 0)
                        for i, p, q in inner:
                            if i == CUE_POSITIONS:
                                at = {j: number(data, u, v) for j, u, v in elements(data, p, q)}
                                media.cues.append((time, at.get(CUE_TRACK, 0), at.get(CUE_CLUSTER, -1)))
    if not seen:
        raise Broken("no segment")
    return media


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join([data[p[3] : p[3] + p[4]] for p in media.packets if p[0] == track])


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def summary(media: Media) -> str:
    """A line of features: counts, duration, lacings, whether all cues hit their clusters, a checksum of the packet table."""
    at = dict(media.clusters)
    hit = all(at.get(position) == time for time, _, position in media.cues)
    kinds = "/".join(str(sum(p[6] == k for p in media.packets)) for k in LACINGS)
    table = zlib.crc32(repr(media.packets).encode())
    ends = max((p[1] + p[2] for p in media.packets), default=0)
    return f"tracks={len(media.tracks)};clusters={len(media.clusters)};packets={len(media.packets)};lacing={kinds};ns={ends};cues={len(media.cues)}:{int(hit)};table={table:08x}"


# -- over tables -----------------------------------------------------------------------------------


def stored(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the padded text, muxed) of every row."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary()).to_pylist()
            for a in range(0, len(texts), 256):
                some = [t or b"" for t in texts[a : a + 256]]
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(some)), pa.array([len(t) for t in some], pa.int64()), pa.array([mux(padded(t)) for t in some], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return common.id_and_text(df).mapInArrow(common.lean(run), "doc_id long, n_bytes long, media binary")


def described(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what is read back from the media column."""
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            rows = []
            for data in (x.as_py() for x in batch.column("media")):
                media = parse(data)
                payload = payload_of(data, media)
                rows.append((len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), sha256(data).hexdigest(), summary(media)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["doc_id", "n_bytes", *names])

    return df.select("doc_id", "n_bytes", "media").mapInArrow(common.lean(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def packets(df: DataFrame, key: str, column: str) -> DataFrame:
    """The packet table of a column of Matroska bytes: a row a packet, and one with `error` for broken bytes."""
    out = ("track", "time_ns", "duration_ns", "start", "size", "keyframe", "lacing", "cluster")
    schema = f"{key} {df.schema[key].dataType.simpleString()}, track int, time_ns long, duration_ns long, start long, size long, keyframe boolean, lacing string, cluster int, error string"
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32())

    def run(batches):
        for batch in batches:
            keys, rows, errors = [], [], []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found, error = parse(data).packets if data is not None else [], None
                except Broken as e:
                    found, error = [(None,) * len(out)], str(e)
                rows += found
                keys += [k] * len(found)
                errors += [error] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *(pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)), pa.array(errors, pa.string())], names=[key, *out, "error"])

    return df.select(key, column).mapInArrow(common.lean(run), schema)
