"""Matroska media columns: write payloads as 8-bit PCM tracks, parse any EBML file into packets.

The parser walks variable-length elements (known and unknown sizes), tracks, clusters, simple blocks
and block groups, all four lacings, and cues, and gives one packet for each frame with its track,
timestamp and byte range. The writer is the inverse for one audio track.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenquery.llm.frames import map_batches

# element identifiers of the public EBML and Matroska specifications (fixed values)
EBML, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
TOP_LEVEL = frozenset((EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367))

FRAME = 192  # samples of a frame
RATE = 8000  # samples a second
LACED = 16  # frames of a block
BLOCKS = 32  # blocks of a cluster


class MediaError(ValueError):
    """The bytes are no complete Matroska file."""


# ---- writing


def size_bytes(n: int, width: int = 0) -> bytes:
    """A data size as a variable-length integer, of the least width unless one is given."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(ident: int, x: float) -> bytes:
    return element(ident, struct.pack(">d", x))


def lace(frames: list[bytes], lacing: int) -> bytes:
    """The body of a block after its four header bytes."""
    if lacing == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += size_bytes(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            d = b - a
            width = next(w for w in range(1, 9) if abs(d) < (1 << (7 * w - 1)) - 1)
            head += size_bytes(d + (1 << (7 * width - 1)) - 1, width)
    elif len(set(sizes)) > 1:
        raise MediaError("frames of fixed lacing have one size")
    return head + b"".join(frames)


def block(ident: int, track: int, offset: int, frames: list[bytes], lacing: int) -> bytes:
    flags = lacing << 1 | (0x80 if ident == SIMPLE_BLOCK else 0)
    return element(ident, size_bytes(track) + struct.pack(">hB", offset, flags) + lace(frames, lacing))


_HEAD = element(EBML, element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE)
        + element(AUDIO, _float(SAMPLING_FREQUENCY, float(RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)),
    ),
)


def store(payload: bytes) -> bytes:
    """A payload of whole frames as a Matroska file: one 8-bit mono PCM track, fixed lacing, cues."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    step = FRAME * 1000 // RATE  # milliseconds of a frame
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _float(DURATION, float(step * len(frames))) + element(MUXING_APP, b"lumenquery") + element(WRITING_APP, b"lumenquery"))
    body, cues = [info, _TRACKS], b""
    at = len(info) + len(_TRACKS)
    per = LACED * BLOCKS
    for first in range(0, len(frames), per):
        start = first * step
        blocks = b""
        for i in range(first, min(first + per, len(frames)), LACED):
            group = frames[i : min(i + LACED, first + per)]
            blocks += block(SIMPLE_BLOCK, 1, (i - first) * step, group, FIXED if len(group) > 1 else NO_LACING)
        cluster = element(CLUSTER, _uint(TIMESTAMP, start) + blocks)
        cues += element(CUE_POINT, _uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at)))
        body.append(cluster)
        at += len(cluster)
    return _HEAD + element(SEGMENT, b"".join(body) + element(CUES, cues))


# ---- parsing


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    start: int
    length: int
    keyframe: bool
    lacing: int


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, file offset of the cluster
    clusters: list[int] = field(default_factory=list)  # file offsets


def read_id(buf: bytes, at: int) -> tuple[int, int]:
    if at >= len(buf) or not buf[at]:
        raise MediaError("no element identifier")
    width = 9 - buf[at].bit_length()
    return int.from_bytes(buf[at : at + width], "big"), at + width


def read_size(buf: bytes, at: int) -> tuple[int | None, int]:
    """A variable-length integer and the position behind it; None is the unknown size."""
    if at >= len(buf) or not buf[at]:
        raise MediaError("no data size")
    width = 9 - buf[at].bit_length()
    raw = int.from_bytes(buf[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if raw == (1 << 7 * width) - 1 else raw), at + width


def elements(buf: bytes, at: int, end: int, inside: int = 0):
    """(identifier, body start, body end) of the elements of a range.

    An element of unknown size lasts until one that can't be inside it: the next cluster or any
    other child of the segment ends a cluster, the end of the range ends a segment.
    """
    while at < end:
        ident, pos = read_id(buf, at)
        size, pos = read_size(buf, pos)
        if size is None:
            stop = end
            if ident != SEGMENT:
                stop, scan = end, pos
                while scan < end:
                    child, p = read_id(buf, scan)
                    if child in TOP_LEVEL:
                        stop = scan
                        break
                    n, p = read_size(buf, p)
                    scan = end if n is None else p + n
        else:
            stop = pos + size
        if stop > end:
            raise MediaError("an element ends behind its parent")
        yield ident, pos, stop
        at = stop


def unlace(buf: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(start, length) of the frames of a block's body."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    count = buf[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % count:
            raise MediaError("fixed lacing does not divide")
        sizes = [(end - at) // count] * count
    elif lacing == XIPH:
        for _ in range(count - 1):
            n = 0
            while buf[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + buf[at], at + 1
            sizes.append(n)
    else:
        n, at = read_size(buf, at)
        sizes = [n]
        for _ in range(count - 2):
            before = at
            raw, at = read_size(buf, at)
            width = at - before
            raw = (1 << 7 * width) - 1 if raw is None else raw
            sizes.append(sizes[-1] + raw - ((1 << (7 * width - 1)) - 1))
        sizes = sizes[: count - 1]
    if lacing != FIXED:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) != end:
        raise MediaError("laced frames do not fill their block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def _number(buf: bytes, a: int, b: int) -> int:
    return int.from_bytes(buf[a:b], "big")


def _real(buf: bytes, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", buf[a:b])[0] if b > a else 0.0


def parse(buf: bytes) -> Media:
    """The tracks, packets, clusters and cues of a file."""
    out = Media()
    top = list(elements(buf, 0, len(buf)))
    if not top or top[0][0] != EBML:
        raise MediaError("no EBML header")
    for ident, seg, end in top:
        if ident != SEGMENT:
            continue
        for kid, a, b in elements(buf, seg, end):
            if kid == INFO:
                for x, p, q in elements(buf, a, b):
                    if x == TIMESTAMP_SCALE:
                        out.scale = _number(buf, p, q)
                    elif x == DURATION:
                        out.duration = _real(buf, p, q)
            elif kid == TRACKS:
                for x, p, q in elements(buf, a, b):
                    if x == TRACK_ENTRY:
                        _track(out, buf, p, q)
            elif kid == CLUSTER:
                _cluster(out, buf, a, b)
            elif kid == CUES:
                for x, p, q in elements(buf, a, b):
                    if x == CUE_POINT:
                        _cue(out, buf, p, q, seg)
    return out


def _track(out: Media, buf: bytes, a: int, b: int) -> None:
    track = {"type": 0, "codec": "", "default_ns": 0, "rate": 0.0, "channels": 1, "bits": 0}
    number = 0
    for x, p, q in elements(buf, a, b):
        if x == TRACK_NUMBER:
            number = _number(buf, p, q)
        elif x == TRACK_TYPE:
            track["type"] = _number(buf, p, q)
        elif x == CODEC_ID:
            track["codec"] = buf[p:q].rstrip(b"\0").decode("ascii", "replace")
        elif x == DEFAULT_DURATION:
            track["default_ns"] = _number(buf, p, q)
        elif x == AUDIO:
            for y, r, s in elements(buf, p, q):
                if y == SAMPLING_FREQUENCY:
                    track["rate"] = _real(buf, r, s)
                elif y == CHANNELS:
                    track["channels"] = _number(buf, r, s)
                elif y == BIT_DEPTH:
                    track["bits"] = _number(buf, r, s)
    out.tracks[number] = track


def _cue(out: Media, buf: bytes, a: int, b: int, segment: int) -> None:
    time = 0
    for x, p, q in elements(buf, a, b):
        if x == CUE_TIME:
            time = _number(buf, p, q)
        elif x == CUE_TRACK_POSITIONS:
            spot = {y: _number(buf, r, s) for y, r, s in elements(buf, p, q)}
            out.cues.append((time, spot.get(CUE_TRACK, 0), segment + spot.get(CUE_CLUSTER_POSITION, 0)))


def _cluster(out: Media, buf: bytes, a: int, b: int) -> None:
    base = 0
    out.clusters.append(a)
    for x, p, q in elements(buf, a, b):
        if x == TIMESTAMP:
            base = _number(buf, p, q)
        elif x == SIMPLE_BLOCK:
            _block(out, buf, p, q, base, bool(buf[p + 3] & 0x80) if buf[p] & 0x80 else False)
        elif x == BLOCK_GROUP:
            kids = {y: (r, s) for y, r, s in elements(buf, p, q)}
            if BLOCK in kids:
                _block(out, buf, *kids[BLOCK], base, REFERENCE_BLOCK not in kids)


def _block(out: Media, buf: bytes, a: int, b: int, base: int, key: bool) -> None:
    track, at = read_size(buf, a)
    offset, flags = struct.unpack_from(">hB", buf, at)
    lacing = flags >> 1 & 3
    step = out.tracks.get(track, {}).get("default_ns", 0)
    first = (base + offset) * out.scale
    for n, (start, length) in enumerate(unlace(buf, at + 3, b, lacing)):
        out.packets.append(Packet(track, first + n * step, start, length, key, lacing))


# ---- columns


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 bytes, and the bytes with spaces up to a positive multiple of a frame."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b" " * (FRAME - len(raw) if not raw else -len(raw) % FRAME)


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media, the text stored as a Matroska file; a null text is stored as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            made = [payload_of(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([store(p) for _, p in made], pa.binary())], names=[id_col, "n_bytes", "media"])

    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, media binary")


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: id, nth, track, timestamp_ns, start, length, keyframe, lacing, codec.

    Null media have no packets; bytes that are no complete file raise MediaError.
    """
    kind = media.schema[id_col].dataType.simpleString()
    names = [id_col, "nth", "track", "timestamp_ns", "start", "length", "keyframe", "lacing", "codec"]

    def run(batches):
        for b in batches:
            for ident, buf in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if buf is None:
                    continue
                m = parse(buf)
                n = len(m.packets)
                cols = [list(range(n)), [p.track for p in m.packets], [p.timestamp_ns for p in m.packets], [p.start for p in m.packets], [p.length for p in m.packets]]
                yield pa.record_batch(
                    [pa.array([ident.as_py()] * n, b.column(0).type), *[pa.array(c, pa.int64()) for c in cols], pa.array([p.keyframe for p in m.packets], pa.bool_()),
                     pa.array([p.lacing for p in m.packets], pa.int32()), pa.array([m.tracks.get(p.track, {}).get("codec", "") for p in m.packets], pa.string())],
                    names=names,
                )

    return map_batches(media.select(id_col, media_col), run, f"`{id_col}` {kind}, nth long, track long, timestamp_ns long, start long, length long, keyframe boolean, lacing int, codec string")


def read_back(buf: bytes) -> tuple[bytes, Media]:
    """The packets' bytes in order, and the parsed file."""
    m = parse(buf)
    return b"".join([buf[p.start : p.start + p.length] for p in m.packets]), m


def feature_of(payload: bytes, media: Media) -> str:
    """Counts of the file and of its samples: packets, clusters, cues, length, energy, crossings."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    last = media.packets[-1] if media.packets else None
    ms = (last.timestamp_ns + media.tracks[last.track]["default_ns"]) // 1_000_000 if last else 0
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"tracks={len(media.tracks)};packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={ms};energy={int((x * x).sum())};sum={int(x.sum())};crossings={crossings}"


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of the payload as read back from the stored files.

    id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for buf in b.column(2).to_pylist():
                payload, m = read_back(buf)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(buf), hashlib.sha256(buf).hexdigest(), feature_of(payload, m)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_batches(media.select(id_col, "n_bytes", "media"), run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
