"""Matroska media columns: EBML elements, clusters, lacing and cues to and from packet tables."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_columns, small_batches, to_arrow

#: Element ids of the published format.
EBML, VOID, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0xEC, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
LACINGS = ("none", "xiph", "fixed", "ebml")
#: A top-level element ends a cluster or segment of unknown size.
TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, EBML}


class MediaError(ValueError):
    """The bytes are not the format."""


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """(value, position after it, length); a value of all ones stands for unknown and comes as -1."""
    if at >= len(data) or not data[at]:
        raise MediaError(f"no variable-length number at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise MediaError(f"a number is cut off at byte {at}")
    value = int.from_bytes(data[at : at + n], "big")
    if not keep_marker:
        value &= (1 << 7 * n) - 1
        if value == (1 << 7 * n) - 1:
            value = -1
    return value, at + n, n


def elements(data: bytes, at: int, end: int, unknown_ends: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, start of the content, its end) of the elements from ``at``; stops before an id in ``unknown_ends``."""
    while at < end:
        start = at
        kind, at, _ = vint(data, at, keep_marker=True)
        if kind in unknown_ends:
            return
        size, at, _ = vint(data, at)
        stop = _unknown_end(data, at, end, kind) if size < 0 else at + size
        if stop > end:
            raise MediaError(f"element {kind:X} at byte {start} exceeds what holds it")
        yield kind, start, at, stop
        at = stop


def _unknown_end(data: bytes, at: int, end: int, kind: int) -> int:
    """Where an element of unknown size ends: at an element that cannot be its child.

    Of its children only a cluster in a segment may be of unknown size too; it ends where the next cluster or other child of a
    segment begins, so that both levels are walked in one pass.
    """
    ends = {EBML, SEGMENT} if kind == SEGMENT else TOP
    while at < end:
        start = at
        child, at, _ = vint(data, at, keep_marker=True)
        if child in ends:
            return start
        size, at, _ = vint(data, at)
        if size >= 0:
            at += size
            if at > end:
                raise MediaError(f"element {child:X} at byte {start} exceeds what holds it")
        elif kind != SEGMENT or child != CLUSTER:
            raise MediaError(f"element {child:X} at byte {start} may not be of unknown size")
    return at


def lace_sizes(data: bytes, at: int, end: int, lacing: str) -> tuple[list[int], int]:
    """The sizes of a block's frames and where the first begins."""
    if lacing == "none":
        return [end - at], at
    if at >= end:
        raise MediaError("a lace is cut off")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == "fixed":
        if (end - at) % n:
            raise MediaError("a fixed lace does not divide its block")
        return [(end - at) // n] * n, at
    for i in range(n - 1):
        if lacing == "xiph":
            size = 0
            while True:
                if at >= end:
                    raise MediaError("a lace is cut off")
                size, at, more = size + data[at], at + 1, data[at] == 255
                if not more:
                    break
        else:
            value, at, length = vint(data, at)
            size = value if i == 0 else sizes[-1] + value - ((1 << 7 * length - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MediaError("a lace is larger than its block")
    return sizes, at


@dataclass
class Packet:
    track: int
    codec: str | None
    cluster: int
    block: int
    frame: int
    lacing: str
    keyframe: bool
    timestamp_ns: int
    start: int
    end: int


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    #: (time, track, cluster's position) as ns and byte offset.
    cues: list[tuple[int, int, int]] = field(default_factory=list)


#: The largest number and time that a packet table holds.
LARGEST = (1 << 63) - 1


def number(data: bytes, at: int, end: int) -> int:
    if end - at > 8:
        raise MediaError(f"the number at byte {at} has over eight bytes")
    return int.from_bytes(data[at:end], "big")


def held(value: int) -> int:
    if abs(value) > LARGEST:
        raise MediaError(f"a number or time of {value} is out of range")
    return value


def parse(data: bytes) -> Media:
    """The tracks, packets and cues of one file; MediaError if it is none."""
    out, segment_seen = Media(), False
    raw_cues: list[tuple[int, int, int]] = []
    for kind, _, a, b in elements(data, 0, len(data)):
        if kind == EBML:
            for k, _, x, y in elements(data, a, b):
                if k == DOC_TYPE:
                    out.doc_type = data[x:y].rstrip(b"\0").decode("ascii", "replace")
        elif kind == SEGMENT:
            segment_seen, base = True, a
            for k, start, x, y in elements(data, a, b):
                if k == INFO:
                    out.scale = next((number(data, p, q) for i, _, p, q in elements(data, x, y) if i == TIMESTAMP_SCALE), out.scale)
                elif k == TRACKS:
                    for i, _, p, q in elements(data, x, y):
                        if i == TRACK_ENTRY:
                            own = {j: (r, s) for j, _, r, s in elements(data, p, q)}
                            if TRACK_NUMBER not in own:
                                raise MediaError("a track has no number")
                            out.tracks[number(data, *own[TRACK_NUMBER])] = {
                                "codec": data[slice(*own[CODEC_ID])].rstrip(b"\0").decode("ascii", "replace") if CODEC_ID in own else None,
                                "frame_ns": number(data, *own[DEFAULT_DURATION]) if DEFAULT_DURATION in own else 0,
                            }
                elif k == CLUSTER:
                    out.clusters.append(start)
                    _cluster(data, x, y, out)
                elif k == CUES:
                    for i, _, p, q in elements(data, x, y):
                        if i == CUE_POINT:
                            own = [(j, r, s) for j, _, r, s in elements(data, p, q)]
                            when = next((number(data, r, s) for j, r, s in own if j == CUE_TIME), 0)
                            for j, r, s in own:
                                if j == CUE_POSITIONS:
                                    at = {u: number(data, v, w) for u, _, v, w in elements(data, r, s)}
                                    raw_cues.append((when, at.get(CUE_TRACK, 0), base + at.get(CUE_CLUSTER, 0)))
    if not segment_seen:
        raise MediaError("there is no segment")
    out.cues = [(held(t * out.scale), track, at) for t, track, at in raw_cues]
    return out


def _cluster(data: bytes, a: int, b: int, out: Media) -> None:
    when, block = 0, 0
    for kind, _, x, y in elements(data, a, b, TOP):
        if kind == TIMESTAMP:
            when = number(data, x, y)
        elif kind == SIMPLE_BLOCK:
            _block(data, x, y, out, when, block, None)
            block += 1
        elif kind == BLOCK_GROUP:
            own = {k: (p, q) for k, _, p, q in elements(data, x, y)}
            if BLOCK in own:
                _block(data, *own[BLOCK], out, when, block, REFERENCE_BLOCK not in own)
                block += 1


def _block(data: bytes, a: int, b: int, out: Media, cluster_time: int, block: int, keyframe: bool | None) -> None:
    track, at, _ = vint(data, a)
    if at + 3 > b:
        raise MediaError("a block's head is cut off")
    offset, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    lacing = LACINGS[flags >> 1 & 3]
    sizes, at = lace_sizes(data, at + 3, b, lacing)
    about = out.tracks.get(track, {"codec": None, "frame_ns": 0})
    for i, size in enumerate(sizes):
        out.packets.append(Packet(held(track), about["codec"], len(out.clusters) - 1, block, i, lacing, bool(flags & 0x80) if keyframe is None else keyframe, held((cluster_time + offset) * out.scale + i * about["frame_ns"]), at, at + size))
        at += size


# Writing


def coded(value: int, length: int = 0) -> bytes:
    """A number as a variable-length one, of the least length unless one is given."""
    length = length or max(1, -(-(value + 1).bit_length() // 7))
    return (value | 1 << 7 * length).to_bytes(length, "big")


def element(kind: int, content: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + coded(len(content)) + content


def whole(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: str) -> bytes:
    """The lace's head and the frames."""
    if lacing == "none":
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == "ebml" and len(sizes) > 1:
        head += coded(sizes[0])
        for before, now in zip(sizes, sizes[1:-1], strict=False):
            n = next(n for n in range(1, 9) if abs(now - before) < (1 << 7 * n - 1) - 1)
            head += coded(now - before + (1 << 7 * n - 1) - 1, n)
    return head + b"".join(frames)


#: 8-bit samples a second, samples a frame (24 ms) and frames a lace and a cluster.
RATE, FRAME, LACED, CLUSTERED = 8000, 192, 8, 1024


def write_samples(payload: bytes) -> bytes:
    """A file with one track of 8-bit samples, the payload's bytes, in frames of FRAME laced in turn by each scheme.

    The frames of a variable lace shrink and grow by turns around FRAME, so that sizes differ there.
    """
    frame_ms = FRAME * 1000 // RATE
    head = element(EBML, element(DOC_TYPE, b"matroska") + whole(DOC_VERSION, 4) + whole(DOC_READ_VERSION, 2))
    info = element(INFO, whole(TIMESTAMP_SCALE, 1_000_000))
    audio = element(AUDIO, element(SAMPLING, np.array(RATE, dtype=">f4").tobytes()) + whole(CHANNELS, 1) + whole(BIT_DEPTH, 8))
    track = element(TRACKS, element(TRACK_ENTRY, whole(TRACK_NUMBER, 1) + whole(TRACK_UID, 1) + whole(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + whole(DEFAULT_DURATION, frame_ms * 1_000_000) + audio))
    clusters, cues, position, turn = [], [], len(info) + len(track), 0
    step = CLUSTERED * FRAME
    for start in range(0, len(payload), step):
        part, when = payload[start : start + step], start // FRAME * frame_ms
        content = [whole(TIMESTAMP, when)]
        at = 0
        while at < len(part):
            lacing = LACINGS[turn % 4]
            run = part[at : at + FRAME * (1 if lacing == "none" else LACED)]
            cuts = [*range(0, len(run), FRAME), len(run)]
            if lacing in ("xiph", "ebml"):
                cuts = [c + 40 * (i % 2) * (0 < i < len(cuts) - 1) for i, c in enumerate(cuts)]
            block = coded(1) + (at // FRAME * frame_ms).to_bytes(2, "big") + bytes([0x80 | LACINGS.index(lacing) << 1])
            content.append(element(SIMPLE_BLOCK, block + laced([run[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], lacing)))
            at, turn = at + len(run), turn + 1
        clusters.append(element(CLUSTER, b"".join(content)))
        cues.append(element(CUE_POINT, whole(CUE_TIME, when) + element(CUE_POSITIONS, whole(CUE_TRACK, 1) + whole(CUE_CLUSTER, position))))
        position += len(clusters[-1])
    return head + element(SEGMENT, info + track + b"".join(clusters) + element(CUES, b"".join(cues)))


def samples_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[p.start : p.end] for p in media.packets if p.track == track)


def features(media: Media, samples: bytes) -> str:
    """Figures of the packets and samples; whole numbers only, so that equal files give equal strings."""
    values = np.frombuffer(samples, dtype=np.uint8)
    lacings = {name: 0 for name in LACINGS}
    for p in media.packets:
        lacings[p.lacing] += 1
    starts = set(media.clusters)
    seekable = sum(at in starts for _, _, at in media.cues)
    parts = {
        "packets": len(media.packets), "clusters": len(media.clusters), "cues": seekable, **lacings,
        "last_ns": max((p.timestamp_ns for p in media.packets), default=0), "min": int(values.min(initial=255)), "max": int(values.max(initial=0)),
        "sum": int(values.sum(dtype=np.int64)), "changes": int(np.count_nonzero(values[1:] != values[:-1])), "energy": int(np.square(values.astype(np.int64) - 128).sum()),
    }
    return ";".join(f"{k}={v}" for k, v in parts.items())


def store_texts(df: DataFrame, text: str = "text", keep: list[str] | None = None, with_media: bool = True) -> DataFrame:
    """Each row with its text stored as a sound file (``media``, if with_media) and what is read back from that.

    The text's UTF-8 bytes, none for null, are padded with spaces to a positive multiple of FRAME. New columns:
    n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Rows are independent:
    repeated rows agree, an empty table gives an empty one, and other columns pass unless they have a new name.
    """

    def run(texts: list) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media")}
        for value in texts:
            raw = (value or "").encode()
            data = write_samples(raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME))
            media = parse(data)
            back = samples_of(data, media)
            for name, x in (("n_bytes", len(raw)), ("payload_bytes", len(back)), ("payload_sha256", hashlib.sha256(back).hexdigest()), ("tail_crc32", zlib.crc32(back[-16:])), ("media_bytes", len(data)), ("media_sha256", hashlib.sha256(data).hexdigest()), ("feature", features(media, back)), ("media", data)):
                out[name].append(x)
        return out

    kinds = {"payload_sha256": T.StringType(), "media_sha256": T.StringType(), "feature": T.StringType(), "media": T.BinaryType()}
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(("media",) if with_media else ()))
    return map_columns(df, [text], run, T.StructType([T.StructField(n, kinds.get(n, T.LongType())) for n in names]), keep)


PACKET_FIELDS = [
    T.StructField("track", T.LongType()), T.StructField("codec", T.StringType()), T.StructField("cluster", T.LongType()), T.StructField("block", T.LongType()), T.StructField("frame", T.LongType()),
    T.StructField("lacing", T.StringType()), T.StructField("keyframe", T.BooleanType()), T.StructField("timestamp_ns", T.LongType()), T.StructField("byte_start", T.LongType()), T.StructField("byte_end", T.LongType()),
    T.StructField("cued", T.BooleanType()), T.StructField("error", T.StringType()),
]
#: Packets in one Arrow batch of the packet table.
PACKET_ROWS = 8192


def packet_table(df: DataFrame, media: str = "media", row_id: str = "doc_id") -> DataFrame:
    """One row for each packet of a binary column: id, track, timestamps, lacing, byte range.

    ``cued`` tells whether a cue points to the packet's cluster. A null value has no packets; one that is not the
    format gives a single row with ``error`` and nulls. Only the id of the other columns is returned.
    """
    small_batches(df.sparkSession)
    import pyarrow as pa

    schema = T.StructType([T.StructField("row_id", df.schema[row_id].dataType), *PACKET_FIELDS])
    kinds = pa.schema([(f.name, to_arrow(f.dataType)) for f in schema])

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    found = parse(data)
                except MediaError as e:
                    yield pa.RecordBatch.from_pylist([{"row_id": key, "error": str(e)}], schema=kinds)
                    continue
                places = {at: i for i, at in enumerate(found.clusters)}
                cued = {places.get(at) for _, _, at in found.cues}
                for i in range(0, len(found.packets), PACKET_ROWS):
                    rows = [
                        {"row_id": key, "track": p.track, "codec": p.codec, "cluster": p.cluster, "block": p.block, "frame": p.frame, "lacing": p.lacing, "keyframe": p.keyframe,
                         "timestamp_ns": p.timestamp_ns, "byte_start": p.start, "byte_end": p.end, "cued": p.cluster in cued, "error": None}
                        for p in found.packets[i : i + PACKET_ROWS]
                    ]
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return df.select(row_id, media).mapInArrow(run, schema)
