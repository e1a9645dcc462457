"""Media columns in Matroska: a writer and a parser of EBML elements, and operators over binary columns.

A payload of 8-bit samples becomes an audio track of unsigned PCM. Frames of 1,024 samples are laced into simple
blocks, blocks are held in clusters, and cues index the clusters. The parser reads variable-length element ids and
sizes (unknown sizes too), clusters, block groups, simple blocks, all four kinds of lacing and the cues, and yields a
packet table with track, timestamp and byte range of every frame. Frames of a lace follow one another by the block's duration, else by the
track's default duration, else, in PCM, by their samples; where none of these is known they share the block's timestamp.

Defined results: a null text or payload is empty and is stored as 64 zero bytes; a blob that is no Matroska file gives
one row with ``error`` set and no packet. Every row is handled on its own, so ties, repeated rows and empty tables
need nothing, and memory is bounded by the largest text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellgrove.llm.common import small_batches, texts_of

RATE = 8000
FRAME = 1024
LACED = 8
BLOCKS = 16

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ, EBML_ID_LEN, EBML_SIZE_LEN = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, LACING_FLAG, CODEC = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B
CUE, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0

MASTERS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE, CUE_POSITIONS}
TOP = {INFO, TRACKS, CLUSTER, CUES}


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    """The shortest variable-length integer; all ones is kept for an unknown size."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(kind: int, body: bytes) -> bytes:
    return _id(kind) + _size(len(body)) + body


def _uint(kind: int, n: int) -> bytes:
    return _element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(kind: int, x: float) -> bytes:
    return _element(kind, struct.pack(">d", x))


def _signed_size(n: int) -> bytes:
    """A difference of lace sizes: a variable-length integer with a bias of half its range."""
    width = 1
    while not -(1 << 7 * width - 1) < n < 1 << 7 * width - 1:
        width += 1
    return (n + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")


def _block(track: int, time: int, frames: list[bytes], lacing: str) -> bytes:
    """The body of a simple block: key frame, and the frames laced as told."""
    if lacing == "auto":
        lacing = "none" if len(frames) == 1 else "fixed" if len({len(x) for x in frames}) == 1 else "ebml"
    kind = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}[lacing]
    head = _size(track) + struct.pack(">hB", time, 0x80 | kind << 1)
    if kind:
        head += bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (len(x) // 255) + bytes([len(x) % 255]) for x in frames[:-1])
    if lacing == "ebml":
        sizes = [len(x) for x in frames[:-1]]
        head += _size(sizes[0]) + b"".join(_signed_size(b - a) for a, b in zip(sizes, sizes[1:]))
    return head + b"".join(frames)


HEAD = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ, 1) + _uint(EBML_ID_LEN, 4) + _uint(EBML_SIZE_LEN, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ, 2))
TRACK_ENTRY = _element(TRACKS, _element(TRACK, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(LACING_FLAG, 1) + _element(CODEC, b"A_PCM/INT/LIT") + _element(AUDIO, _float(SAMPLING, RATE) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))))


def write_matroska(payload: bytes, lacing: str = "auto", frame: int = FRAME, laced: int = LACED) -> bytes:
    """A Matroska file whose one track holds ``payload`` as unsigned 8-bit samples at 8 kHz, in milliseconds."""
    ms = lambda samples: samples * 1000 // RATE
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _float(DURATION, ms(len(payload))) + _element(MUXER, b"cellgrove") + _element(WRITER, b"cellgrove"))
    parts, cues, at = [info, TRACK_ENTRY], [], len(info) + len(TRACK_ENTRY)
    if lacing == "none":
        laced = 1
    for start in range(0, len(payload), frame * laced * BLOCKS):
        begin, blocks = ms(start), []
        for at_block in range(start, min(len(payload), start + frame * laced * BLOCKS), frame * laced):
            frames = [payload[i : i + frame] for i in range(at_block, min(len(payload), at_block + frame * laced), frame)]
            kind = "none" if len(frames) == 1 or lacing == "fixed" and len({len(x) for x in frames}) > 1 and len(frames) == 1 else "auto" if lacing == "fixed" else lacing
            blocks.append(_element(SIMPLE_BLOCK, _block(1, ms(at_block) - begin, frames, kind)))
        stamp = _uint(TIMESTAMP, begin)
        cluster = _element(CLUSTER, stamp + b"".join(blocks))
        cues.append(_element(CUE, _uint(CUE_TIME, begin) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at) + _uint(CUE_RELATIVE, len(stamp)))))
        parts.append(cluster)
        at += len(cluster)
    if cues:
        parts.append(_element(CUES, b"".join(cues)))
    return HEAD + _element(SEGMENT, b"".join(parts))


class MatroskaError(ValueError):
    """The bytes are not a Matroska file, or end early."""


def _read_vint(data: bytes, at: int, end: int, marked: bool) -> tuple[int, int, int]:
    """Value, width and new position of the variable-length integer at ``at``; with its length bit if ``marked``."""
    if at >= end or not data[at]:
        raise MatroskaError(f"no element at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise MatroskaError(f"cut short at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    return n if marked else n ^ 1 << 7 * width, width, at + width


def elements(data: bytes, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, element's start, body's start, body's end) of the elements from ``start`` on. An unknown size reaches to the end of the parent, and for a cluster to the next top-level element."""
    at = start
    while at < end:
        kind, _, p = _read_vint(data, at, end, True)
        n, width, p = _read_vint(data, p, end, False)
        if n == (1 << 7 * width) - 1:
            stop = end
            if kind == CLUSTER:
                q = p
                while q < end:
                    inner, _, r = _read_vint(data, q, end, True)
                    if inner in TOP:
                        break
                    m, _, r = _read_vint(data, r, end, False)
                    q = r + m
                stop = min(q, end)
        else:
            stop = p + n
        if stop > end:
            raise MatroskaError(f"element at byte {at} ends beyond its parent")
        yield kind, at, p, stop
        at = stop


def _laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Start and end of each frame of a block whose frames begin at ``at``."""
    if not kind:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    if kind == 2:
        each = (end - at) // n
        return [(at + i * each, at + (i + 1) * each) for i in range(n)]
    sizes = []
    for i in range(n - 1):
        if kind == 1:
            total = 0
            while data[at] == 255:
                total, at = total + 255, at + 1
            sizes.append(total + data[at])
            at += 1
        else:
            v, width, at = _read_vint(data, at, end, False)
            sizes.append(v if not i else sizes[-1] + v - ((1 << 7 * width - 1) - 1))
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return [*out, (at, end)]


def _later(track: dict | None, frames: int, done: int) -> int:
    """Nanoseconds from a block's start to the frame that ``frames`` frames and ``done`` bytes of it precede."""
    if not track:
        return 0
    if track.get("frame_ns"):
        return frames * track["frame_ns"]
    second = track["rate"] * track["channels"] * track["bits"] / 8  # bytes
    return round(done * 1e9 / second) if second and track["codec"].startswith("A_PCM") else 0


def read_matroska(data: bytes) -> dict:
    """The file's packet table. Keys: ``scale``, ``tracks`` (number: codec, rate, channels, bits, and frame_ns, nanoseconds a frame, where it is given), ``packets`` (cluster, track, nanoseconds, start, length, key frame, lacing) and ``cues`` (nanoseconds, track, byte of the cluster)."""
    out: dict = {"scale": 1_000_000, "tracks": {}, "packets": [], "cues": []}
    uint = lambda p, q: int.from_bytes(data[p:q], "big")
    real = lambda p, q: struct.unpack(">d" if q - p == 8 else ">f", data[p:q])[0]
    top = list(elements(data, 0, len(data)))
    if [x[0] for x in top[:2]] != [EBML, SEGMENT]:
        raise MatroskaError("no EBML head and segment")
    base, n_cluster = top[1][2], 0
    for kind, at, p, q in elements(data, base, top[1][3]):
        if kind == INFO:
            for k, _, a, b in elements(data, p, q):
                if k == TIMESTAMP_SCALE:
                    out["scale"] = uint(a, b)
        elif kind == TRACKS:
            for _, _, a, b in elements(data, p, q):
                track = {"number": 0, "codec": "", "rate": 0.0, "channels": 1, "bits": 0}
                for k, _, c, d in elements(data, a, b):
                    if k == TRACK_NUMBER:
                        track["number"] = uint(c, d)
                    elif k == CODEC:
                        track["codec"] = data[c:d].decode("ascii", "replace")
                    elif k == DEFAULT_DURATION:
                        track["frame_ns"] = uint(c, d)
                    elif k == AUDIO:
                        for j, _, e, f in elements(data, c, d):
                            track |= {"rate": real(e, f)} if j == SAMPLING else {"channels": uint(e, f)} if j == CHANNELS else {"bits": uint(e, f)} if j == BIT_DEPTH else {}
                out["tracks"][track["number"]] = track
        elif kind == CLUSTER:
            time = 0
            for k, _, a, b in elements(data, p, q):
                if k == TIMESTAMP:
                    time = uint(a, b)
                    continue
                blocks, key, lasts = [(a, b)] if k == SIMPLE_BLOCK else [], None, None
                if k == BLOCK_GROUP:
                    inner = list(elements(data, a, b))
                    blocks = [x[2:] for x in inner if x[0] == BLOCK]
                    key = all(x[0] != REFERENCE for x in inner)
                    lasts = next((uint(*x[2:]) for x in inner if x[0] == BLOCK_DURATION), None)
                for a, b in blocks:
                    number, _, c = _read_vint(data, a, b, False)
                    rel, flags = struct.unpack(">hB", data[c : c + 3])
                    laces = _laces(data, c + 3, b, flags >> 1 & 3)
                    first, done = (time + rel) * out["scale"], 0
                    for i, (s, e) in enumerate(laces):
                        if not c + 3 <= s <= e <= b:
                            raise MatroskaError(f"a lace of the block at byte {a} is out of bounds")
                        later = lasts * out["scale"] * i // len(laces) if lasts is not None else _later(out["tracks"].get(number), i, done)
                        out["packets"].append((n_cluster, number, first + later, s, e - s, bool(flags & 0x80) if key is None else key, flags >> 1 & 3))
                        done += e - s
            n_cluster += 1
        elif kind == CUES:
            for _, _, a, b in elements(data, p, q):
                time, places = 0, []
                for k, _, c, d in elements(data, a, b):
                    if k == CUE_TIME:
                        time = uint(c, d)
                    elif k == CUE_POSITIONS:
                        found = {j: uint(e, f) for j, _, e, f in elements(data, c, d)}
                        places.append((found.get(CUE_TRACK, 0), base + found.get(CUE_CLUSTER, 0)))
                out["cues"] += [(time * out["scale"], *place) for place in places]
    return out


def read_payload(data: bytes, track: int = 1, parsed: dict | None = None) -> bytes:
    """The frames of one track, one after another."""
    return b"".join(data[s : s + n] for _, t, _, s, n, _, _ in (parsed or read_matroska(data))["packets"] if t == track)


def pad(raw: bytes) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % 64 or 64 * (not raw))


def feature_of(parsed: dict, payload: bytes) -> str:
    """Packets, clusters, cues, milliseconds, and of the samples: sum, sum of squared steps, and crossings of 128."""
    a = np.frombuffer(payload, np.uint8)
    step = np.diff(a.astype(np.int64))
    high = a >= 128
    return f"packets={len(parsed['packets'])};clusters={1 + max((p[0] for p in parsed['packets']), default=-1)};cues={len(parsed['cues'])};ms={len(a) * 1000 // RATE};sum={int(a.sum(dtype=np.int64))};step2={int((step * step).sum())};crossings={int((high[1:] != high[:-1]).sum())}"


PACKETS = "packet long, cluster int, track int, timestamp_ns long, byte_start long, byte_length long, keyframe boolean, lacing string, is_cue boolean, error string"


def packet_table(df: DataFrame, media: str, key: str) -> DataFrame:
    """One row per frame of every blob of ``media``, with ``key``; a blob that cannot be read gives one row with ``error``."""
    small_batches(df.sparkSession)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {PACKETS}"
    names = ["none", "xiph", "fixed", "ebml"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0), texts_of(batch.column(1))):
                try:
                    parsed = read_matroska(data)
                    starts = {x[:2] for x in parsed["cues"]}
                    rows = [(i, c, t, ns, s, n, kf, names[lace], (ns, t) in starts, None) for i, (c, t, ns, s, n, kf, lace) in enumerate(parsed["packets"])]
                except (MatroskaError, IndexError, struct.error) as e:
                    rows = [(None,) * 9 + (str(e),)]
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), batch.column(0).type), *(pa.array(c, t) for c, t in zip(cols, kinds))], [key, "packet", "cluster", "track", "timestamp_ns", "byte_start", "byte_length", "keyframe", "lacing", "is_cue", "error"])

    return df.select(key, media).mapInArrow(run, schema)


def to_media(df: DataFrame, text: str, key: str, lacing: str = "auto") -> DataFrame:
    """(key, media): every text's UTF-8, padded, as a Matroska file."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([write_matroska(pad(x), lacing) for x in texts_of(batch.column(1))], pa.binary())], [key, "media"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, media binary")


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Stores every whole text as a media blob, reads the blob back, and returns its digests and a feature by ``key``. The blobs live for one row only, so nothing but the digests is kept."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in texts_of(batch.column(1)):
                media = write_matroska(pad(raw))
                parsed = read_matroska(media)
                payload = read_payload(media, parsed=parsed)
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(parsed, payload)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], [key, *(x.split()[0] for x in DIGESTS.split(", "))])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {DIGESTS}")
