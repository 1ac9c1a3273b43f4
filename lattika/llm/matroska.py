"""Media columns: Matroska files in a binary column, written from samples and parsed into packet tables.

The parser walks EBML elements of variable length (known and unknown sizes), clusters, simple and
grouped blocks, the four kinds of lacing, and cues. Times are nanoseconds, byte ranges count from the
file's start, so a packet can be read by one ranged read of the stored file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_parts

# Fixed values of the format (RFC 8794, RFC 9559).
EBML, EBML_VERSION, EBML_READ_VERSION, MAX_ID_LENGTH, MAX_SIZE_LENGTH = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION, VOID, CRC_32 = 0x4282, 0x4287, 0x4285, 0xEC, 0xBF
SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
CHAPTERS, TAGS, ATTACHMENTS = 0x1043A770, 0x1254C367, 0x1941A469
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEGMENT_LEVEL = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 8
"""Production parameters: samples a second, bytes a frame, frames a block, blocks a cluster."""

LONG = 1 << 63
PACKET_SCHEMA = "track long, timestamp_ns long, offset long, size long, keyframe boolean, lacing int, cluster long"


class Malformed(ValueError):
    """The bytes aren't a readable Matroska file."""


# ---- writing


def vint(value: int, width: int = 0) -> bytes:
    """A size as EBML writes it; all ones are reserved for an unknown size."""
    width = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def float64(ident: int, value: float) -> bytes:
    return element(ident, struct.pack(">d", value))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The lacing header and the frames behind it."""
    if kind == NO_LACING:
        return frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(x) for x in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += vint(sizes[0])
        for before, now in zip(sizes, sizes[1:-1], strict=False):
            diff = now - before
            width = next(n for n in range(1, 9) if abs(diff) < (1 << 7 * n - 1) - 1)
            head += vint(diff + (1 << 7 * width - 1) - 1, width)
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return head + b"".join(frames)


def write_samples(payload: bytes, rate: int = RATE, frame: int = FRAME, laced: int = LACED, blocks: int = BLOCKS) -> bytes:
    """A Matroska file with the payload as unsigned 8-bit mono PCM, lossless, with cues for every cluster.

    A timestamp tick is one sample, so packets' times are exact; clusters end where a block's offset would
    exceed 16 bits.
    """
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000_000 // rate) + float64(DURATION, len(payload)) + element(MUXING_APP, b"lattika") + element(WRITING_APP, b"lattika"))
    audio = element(AUDIO, float64(SAMPLING_FREQUENCY, rate) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, frame * 1_000_000_000 // rate) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio)
    parts, at, cues = [info, element(TRACKS, track)], 0, []
    at = sum(map(len, parts))
    step = frame * laced
    blocks = min(blocks, 32_767 // step + 1)
    for c in range(0, len(payload), step * blocks):
        body = [uint(TIMESTAMP, c)]
        for b in range(c, min(c + step * blocks, len(payload)), step):
            frames = [payload[f : f + frame] for f in range(b, min(b + step, len(payload)), frame)]
            even = len(frames) == laced and len(frames[-1]) == frame
            kind = NO_LACING if len(frames) == 1 else (FIXED if b // step % 2 == 0 else EBML_LACING) if even else XIPH
            head = vint(1) + (b - c).to_bytes(2, "big", signed=True) + bytes([0x80 | kind_bits(kind)])
            body.append(element(SIMPLE_BLOCK, head + lace(frames, kind)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, c) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(MAX_ID_LENGTH, 4) + uint(MAX_SIZE_LENGTH, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ_VERSION, 2))
    return head + element(SEGMENT, b"".join(parts))


def kind_bits(kind: int) -> int:
    return {NO_LACING: 0, XIPH: 2, FIXED: 4, EBML_LACING: 6}[kind]


# ---- reading


def read_vint(buf, at: int, end: int, marker: bool = False) -> tuple[int, int]:
    """The number at `at` and the place behind it; -1 stands for an unknown size. marker: keep the length bit, as ids do."""
    if at >= end:
        raise Malformed(f"no number at {at}")
    first = buf[at]
    width = 9 - first.bit_length() if first else 9
    if width > 8 or at + width > end:
        raise Malformed(f"bad number at {at}")
    value = int.from_bytes(buf[at : at + width], "big")
    if not marker:
        value &= (1 << 7 * width) - 1
        if value == (1 << 7 * width) - 1:
            value = -1
    return value, at + width


def children(buf, at: int, end: int, outer: set[int] | None = None) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of each element in a range. An element of unknown size ends where an element of an outer level starts."""
    while at < end:
        ident, body = read_vint(buf, at, end, True)
        size, body = read_vint(buf, body, end)
        stop = body + size if size >= 0 else unknown_end(buf, ident, body, end)
        if stop > end:
            raise Malformed(f"element {ident:x} at {at} ends behind its parent")
        yield ident, body, stop
        at = stop


def unknown_end(buf, ident: int, at: int, end: int) -> int:
    if ident == SEGMENT:
        return end
    while at < end:
        inner, body = read_vint(buf, at, end, True)
        if inner in SEGMENT_LEVEL:
            return at
        size, body = read_vint(buf, body, end)
        if size < 0:
            raise Malformed(f"element {inner:x} of unknown size inside another")
        at = body + size
    return end


def number(buf, a: int, b: int) -> int:
    return int.from_bytes(buf[a:b], "big")


def decimal(buf, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", buf[a:b])[0] if b - a in (4, 8) else 0.0


def laced_sizes(buf, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """The sizes of the frames of a block, and where the first starts."""
    if kind == NO_LACING:
        return [end - at], at
    if at >= end:
        raise Malformed("a lace without a count")
    n, at = buf[at] + 1, at + 1
    sizes: list[int] = []
    if kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Malformed("a lace is cut")
                size, at, more = size + buf[at], at + 1, buf[at] == 255
                if not more:
                    break
            sizes.append(size)
    elif kind == EBML_LACING and n > 1:
        size, at = read_vint(buf, at, end)
        sizes.append(size)
        for _ in range(n - 2):
            start = at
            diff, at = read_vint(buf, at, end)
            width = at - start
            diff = (1 << 7 * width) - 1 if diff < 0 else diff
            size += diff - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
    elif kind == FIXED:
        if (end - at) % n:
            raise Malformed("fixed lacing that doesn't divide its block")
        return [(end - at) // n] * n, at
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed("laced sizes exceed their block")
    return sizes, at


class Media:
    """What a file holds: tracks, packets and cues. packets: tuples of PACKET_SCHEMA, in stored order."""

    def __init__(self, buf: bytes):
        self.tracks: dict[int, dict] = {}
        self.packets: list[tuple] = []
        self.cues: list[tuple[int, int, int]] = []
        self.clusters, self.scale, self.duration, self.doc_type = 0, 1_000_000, 0.0, ""
        seen = False
        for ident, a, b in children(buf, 0, len(buf)):
            if ident == EBML:
                self.doc_type = next((bytes(buf[x:y]).rstrip(b"\0").decode("ascii", "replace") for i, x, y in children(buf, a, b) if i == DOC_TYPE), "matroska")
            elif ident == SEGMENT:
                seen = True
                self.segment(buf, a, b)
        if not seen:
            raise Malformed("no segment")

    def segment(self, buf, start: int, end: int) -> None:
        for ident, a, b in children(buf, start, end):
            if ident == INFO:
                for i, x, y in children(buf, a, b):
                    if i == TIMESTAMP_SCALE:
                        self.scale = number(buf, x, y)
                    elif i == DURATION:
                        self.duration = decimal(buf, x, y)
            elif ident == TRACKS:
                for i, x, y in children(buf, a, b):
                    if i == TRACK_ENTRY:
                        self.track(buf, x, y)
            elif ident == CLUSTER:
                self.cluster(buf, a, b)
            elif ident == CUES:
                for i, x, y in children(buf, a, b):
                    if i == CUE_POINT:
                        self.cue(buf, x, y, start)

    def track(self, buf, a: int, b: int) -> None:
        got = {"default_duration": 0, "number": 0, "codec": "", "rate": 0.0, "kind": 0}
        for i, x, y in children(buf, a, b):
            if i == TRACK_NUMBER:
                got["number"] = number(buf, x, y)
            elif i == DEFAULT_DURATION:
                got["default_duration"] = number(buf, x, y)
            elif i == CODEC_ID:
                got["codec"] = bytes(buf[x:y]).rstrip(b"\0").decode("ascii", "replace")
            elif i == TRACK_TYPE:
                got["kind"] = number(buf, x, y)
            elif i == AUDIO:
                got["rate"] = next((decimal(buf, p, q) for j, p, q in children(buf, x, y) if j == SAMPLING_FREQUENCY), 0.0)
        self.tracks[got["number"]] = got

    def cue(self, buf, a: int, b: int, origin: int) -> None:
        time, places = 0, []
        for i, x, y in children(buf, a, b):
            if i == CUE_TIME:
                time = number(buf, x, y)
            elif i == CUE_TRACK_POSITIONS:
                got = {j: number(buf, p, q) for j, p, q in children(buf, x, y)}
                places.append((got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER_POSITION, 0) + origin))
        self.cues += [(time * self.scale, track, place) for track, place in places]

    def cluster(self, buf, a: int, b: int) -> None:
        base = 0
        for i, x, y in children(buf, a, b):
            if i == TIMESTAMP:
                base = number(buf, x, y)
            elif i == SIMPLE_BLOCK:
                self.block(buf, x, y, base, None)
            elif i == BLOCK_GROUP:
                inner = list(children(buf, x, y))
                key = all(j != REFERENCE_BLOCK for j, _, _ in inner)
                length = next((number(buf, p, q) for j, p, q in inner if j == BLOCK_DURATION), 0)
                for j, p, q in inner:
                    if j == BLOCK:
                        self.block(buf, p, q, base, key, length)
        self.clusters += 1

    def block(self, buf, a: int, b: int, base: int, key: bool | None, length: int = 0) -> None:
        track, at = read_vint(buf, a, b)
        if at + 3 > b:
            raise Malformed("a block is cut")
        time = (base + int.from_bytes(buf[at : at + 2], "big", signed=True)) * self.scale
        flags = buf[at + 2]
        kind = {0: NO_LACING, 2: XIPH, 4: FIXED, 6: EBML_LACING}[flags & 6]
        sizes, at = laced_sizes(buf, at + 3, b, kind)
        step = self.tracks.get(track, {}).get("default_duration", 0) or length * self.scale // max(1, len(sizes))
        keyframe = bool(flags & 0x80) if key is None else key
        last = time + step * (len(sizes) - 1)
        if not (-LONG <= time < LONG and -LONG <= last < LONG and track < LONG):
            raise Malformed("a packet's time or track needs more than 64 bits")
        for k, size in enumerate(sizes):
            self.packets.append((track, time + k * step, at, size, keyframe, kind, self.clusters))
            at += size

    def payload(self, buf: bytes, track: int = 1) -> bytes:
        """The samples of a track, by the packets' byte ranges."""
        return b"".join(buf[p[2] : p[2] + p[3]] for p in self.packets if p[0] == track)


def pad(raw: bytes, unit: int = 64) -> bytes:
    """Zero bytes up to a positive multiple of `unit`."""
    return raw + b"\0" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def feature_of(media: Media, samples: bytes) -> str:
    """Packets, clusters, cues, lacing kinds, length in ms, and mean, deviation and zero crossings of the samples."""
    x = np.frombuffer(samples, np.uint8)
    middle = x.astype(np.int16) - 128
    laces = [0, 0, 0, 0]
    for p in media.packets:
        laces[p[5]] += 1
    crossings = int(np.count_nonzero((middle[1:] >= 0) != (middle[:-1] >= 0)))
    return f"packets={len(media.packets)};clusters={media.clusters};cues={len(media.cues)};lacing={'/'.join(map(str, laces))};ms={media.duration * media.scale / 1e6:.0f};mean={x.mean():.4f};std={x.std():.4f};crossings={crossings}"


def packets(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """The packet table of a binary column: a row per packet with key, track, timestamp, byte range, keyframe, lacing, cluster and error.

    A null or malformed file, and one with a time or track beyond signed 64-bit numbers, gives one row with the
    reason in `error` and nulls elsewhere; repeated rows give repeated packets; packets at the same time stay in
    stored order; an empty table gives no row; other columns of df are ignored, so their names may clash with these.
    """

    def parse(batches):
        for batch in in_parts(batches):
            rows: list[tuple] = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(k, *p, None) for p in Media(raw if raw is not None else b"").packets]
                except Malformed as e:
                    rows.append((k, *[None] * 7, str(e)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(out.names)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    kind = df.schema[key].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [("key", to_arrow_type(df.schema[key].dataType)), *[(n, pa.bool_() if n == "keyframe" else pa.int32() if n == "lacing" else pa.int64()) for n in ("track", "timestamp_ns", "offset", "size", "keyframe", "lacing", "cluster")], ("error", pa.string())]
    out = pa.schema(fields)
    return df.select(df[key].alias("key"), df[media].alias("media")).mapInArrow(parse, f"key {kind}, {PACKET_SCHEMA}, error string")


MEDIA_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the Matroska file of each whole text.

    A null text counts as empty; repeated rows stay; a long text is one file of as many clusters as it takes;
    an empty table gives an empty result; other columns are ignored.
    """

    def write(batches):
        for batch in in_parts(batches):
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([write_samples(pad(x)) for x in raw], pa.binary())], schema=MEDIA_SCHEMA)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def digest(stored: DataFrame) -> DataFrame:
    """What the stored files hold when they are read back: sizes, hashes and the feature string; one row for each file."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    out = pa.schema(list(zip(names, kinds, strict=True)))

    def read(batches):
        for batch in in_parts(batches):
            rows = []
            for k, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                media = Media(raw)
                samples = media.payload(raw)
                rows.append((k, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature_of(media, samples), len(media.packets)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema=out)

    return stored.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long")
