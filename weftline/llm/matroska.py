"""Matroska media columns: a reader of EBML elements to packet tables, and a writer of PCM files.

The reader takes any Matroska or WebM file: variable-length ids and sizes (sizes may be unknown), nested masters,
SimpleBlocks and BlockGroups with Xiph, EBML and fixed lacing, and cues. Packets have their track, timestamp, flags and
the byte range in the file, so payloads can be read without decoding. The writer stores samples as 8-bit PCM.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, text_batches, utf8

# Fixed values of the format: element ids, with their length marker.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS}
#: Elements that end a segment's child of unknown size.
_TOP = {INFO, TRACKS, CLUSTER, CUES, SEGMENT, EBML, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


def read_vint(data, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """Variable-length integer at a place, and the place behind it; None if all value bits are 1 (unknown)."""
    first = data[at]
    if not first:
        raise ValueError(f"no length marker at {at}")
    n = 9 - first.bit_length()
    if at + n > len(data):
        raise ValueError(f"cut off at {at}")
    value = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def write_vint(value: int, length: int | None = None) -> bytes:
    """The integer in as few bytes as it takes, or as many as told."""
    n = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(number: int, body: bytes | int | str | float, length: int | None = None) -> bytes:
    """An element with its id and size; numbers and strings in the format's forms."""
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, str):
        body = body.encode()
    elif isinstance(body, float):
        body = np.array(body, ">f8").tobytes()
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + write_vint(len(body), length) + body


def elements(data, at: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """(id, body start, body stop) of each element in a range. A body of unknown size ends at its next sibling or the range's end."""
    while at < stop:
        number, body = read_vint(data, at, keep_marker=True)
        size, body = read_vint(data, body)
        if size is None:
            end = stop
            if number != SEGMENT:
                for child, b, e in elements(data, body, stop):
                    if child in _TOP:
                        end = b - _header(data, b, e, child)
                        break
            yield number, body, end
            at = end
            continue
        if body + size > stop:
            raise ValueError(f"element at {at} reaches past its parent")
        yield number, body, body + size
        at = body + size


def _header(data, body: int, stop: int, number: int) -> int:
    width = (number.bit_length() + 7) // 8
    for n in range(1, 9):
        at = body - n - width
        if at >= 0 and int.from_bytes(data[at : at + width], "big") == number and read_vint(data, at + width)[1] == body:
            return n + width
    raise ValueError("no header")


@dataclass
class Packet:
    """One frame: its track, timestamp in nanoseconds, flags, and bytes [start, start + size) of the file."""

    track: int
    timestamp_ns: int
    keyframe: bool
    lacing: int
    cluster: int
    start: int
    size: int


def block_frames(data, body: int, stop: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative time, flags, [(start, size)]) of a block's body, by its lacing."""
    track, at = read_vint(data, body)
    relative = int.from_bytes(data[at : at + 2], "big", signed=True)
    flags = data[at + 2]
    at += 3
    lacing = flags >> 1 & 3
    if lacing == NO_LACING:
        return track, relative, flags, [(at, stop - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == EBML_LACING and n > 1:
        size, at = read_vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            begin = at
            raw, at = read_vint(data, at)
            bits = 7 * (at - begin)
            raw = (1 << bits) - 1 if raw is None else raw
            sizes.append(sizes[-1] + raw - ((1 << bits - 1) - 1))
    elif lacing == FIXED:
        if (stop - at) % n:
            raise ValueError("fixed lacing doesn't divide the block")
        sizes = [(stop - at) // n] * (n - 1)
    sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames reach past their block")
    frames = []
    for size in sizes:
        frames.append((at, size))
        at += size
    return track, relative, flags, frames


def _uint(data, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


@dataclass
class Media:
    """A parsed file: tracks by number, packets in order, and cues (time, track, cluster's place in the segment)."""

    scale_ns: int
    duration: float | None
    tracks: dict[int, dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    segment: int


def parse(data: bytes) -> Media:
    """Read a whole file. Raises ValueError where it isn't Matroska or is cut off."""
    media = Media(1_000_000, None, {}, [], [], 0)
    head = next(elements(data, 0, len(data)), None) if data else None
    if not head or head[0] != EBML:
        raise ValueError("no EBML header")
    for number, a, b in elements(data, 0, len(data)):
        if number == SEGMENT:
            media.segment = a
            _segment(data, a, b, media)
    return media


def _segment(data, start: int, stop: int, media: Media) -> None:
    cluster = -1
    for number, a, b in elements(data, start, stop):
        if number == INFO:
            for n, x, y in elements(data, a, b):
                if n == TIMESTAMP_SCALE:
                    media.scale_ns = _uint(data, x, y)
                elif n == DURATION:
                    media.duration = float(np.frombuffer(data[x:y], ">f8" if y - x == 8 else ">f4")[0])
        elif number == TRACKS:
            for n, x, y in elements(data, a, b):
                if n == TRACK_ENTRY:
                    _track(data, x, y, media)
        elif number == CLUSTER:
            cluster += 1
            time = 0
            for n, x, y in elements(data, a, b):
                if n == CLUSTER_TIMESTAMP:
                    time = _uint(data, x, y)
                elif n == SIMPLE_BLOCK:
                    _packets(data, x, y, time, cluster, None, None, media)
                elif n == BLOCK_GROUP:
                    inner = {m: (p, q) for m, p, q in elements(data, x, y)}
                    if BLOCK in inner:
                        _packets(data, *inner[BLOCK], time, cluster, 0xFB not in inner, _uint(data, *inner[BLOCK_DURATION]) if BLOCK_DURATION in inner else None, media)
        elif number == CUES:
            for n, x, y in elements(data, a, b):
                if n == CUE_POINT:
                    point = list(elements(data, x, y))
                    time = next((_uint(data, p, q) for m, p, q in point if m == CUE_TIME), 0)
                    for m, p, q in point:
                        if m == CUE_TRACK_POSITIONS:
                            at = {k: _uint(data, i, j) for k, i, j in elements(data, p, q)}
                            media.cues.append((time, at.get(CUE_TRACK, 0), at.get(CUE_CLUSTER_POSITION, 0)))


def _track(data, start: int, stop: int, media: Media) -> None:
    track: dict = {}
    for n, x, y in elements(data, start, stop):
        if n in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
            track[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "frame_ns"}[n]] = _uint(data, x, y)
        elif n == CODEC_ID:
            track["codec"] = bytes(data[x:y]).decode("ascii", "replace")
        elif n == AUDIO:
            for m, p, q in elements(data, x, y):
                if m == SAMPLING_FREQUENCY:
                    track["rate"] = float(np.frombuffer(data[p:q], ">f8" if q - p == 8 else ">f4")[0])
                elif m in (CHANNELS, BIT_DEPTH):
                    track["channels" if m == CHANNELS else "bits"] = _uint(data, p, q)
    media.tracks[track.get("number", 0)] = track


def _packets(data, a: int, b: int, time: int, cluster: int, key: bool | None, duration: int | None, media: Media) -> None:
    track, relative, flags, frames = block_frames(data, a, b)
    step = media.tracks.get(track, {}).get("frame_ns") or (duration or 0) * media.scale_ns // len(frames)
    for i, (start, size) in enumerate(frames):
        media.packets.append(Packet(track, (time + relative) * media.scale_ns + i * step, bool(flags & 128) if key is None else key, flags >> 1 & 3, cluster, start, size))


RATE = 8000
FRAME = 512
LACED = 8
BLOCKS_A_CLUSTER = 4
SCALE = 1_000_000


def block(track: int, relative: int, frames: list[bytes], lacing: int) -> bytes:
    """A SimpleBlock's body, keyframe, with the frames laced as told."""
    head = write_vint(track) + relative.to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1])
    if lacing == NO_LACING:
        return head + frames[0]
    head += bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == EBML_LACING and len(frames) > 1:
        head += write_vint(len(frames[0]))
        for f, g in zip(frames[:-2], frames[1:-1], strict=True):
            diff = len(g) - len(f)
            n = next(n for n in range(1, 9) if abs(diff) < (1 << 7 * n - 1) - 1)
            head += write_vint(diff + (1 << 7 * n - 1) - 1, n)
    return head + b"".join(frames)


def write(samples: bytes, rate: int = RATE, frame: int = FRAME) -> bytes:
    """A Matroska file of one 8-bit PCM track: laced SimpleBlocks in clusters, then cues.

    Whole blocks have fixed lacing, a shorter last one EBML lacing, and a lone frame none.
    """
    frame_ns = frame * 1_000_000_000 // rate
    header = element(EBML, element(DOC_TYPE, "matroska") + element(DOC_TYPE_VERSION, 4) + element(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, element(TIMESTAMP_SCALE, SCALE) + element(MUXING_APP, "weftline") + element(WRITING_APP, "weftline") + element(DURATION, len(samples) * 1e9 / rate / SCALE))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, float(rate)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(FLAG_LACING, 1) + element(DEFAULT_DURATION, frame_ns) + element(CODEC_ID, "A_PCM/INT/LIT") + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    per_block = frame * LACED
    for lo in range(0, len(samples), per_block * BLOCKS_A_CLUSTER):
        time = lo * 1_000_000_000 // rate // SCALE
        body = [element(CLUSTER_TIMESTAMP, time)]
        for b in range(lo, min(lo + per_block * BLOCKS_A_CLUSTER, len(samples)), per_block):
            frames = [samples[i : i + frame] for i in range(b, min(b + per_block, len(samples)), frame)]
            lacing = NO_LACING if len(frames) == 1 else FIXED if len({*map(len, frames)}) == 1 else EBML_LACING
            body.append(element(SIMPLE_BLOCK, block(1, b * 1_000_000_000 // rate // SCALE - time, frames, lacing)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, element(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return header + element(SEGMENT, b"".join(parts))


def payload(data: bytes, media: Media, track: int) -> bytes:
    """The frames of one track, in the order of the file."""
    return b"".join([data[p.start : p.start + p.size] for p in media.packets if p.track == track])


PACKETS = "track int, timestamp_ns long, keyframe boolean, lacing int, cluster int, start long, size long, cue boolean"


def packet_table(files: DataFrame, media_col: str = "media") -> DataFrame:
    """A row for each packet of each file: the other columns, then track, timestamp_ns, keyframe, lacing, cluster, start and size
    (the byte range in the file), and cue (whether a cue points to the packet's cluster and time), and error.

    A null, empty or damaged file gives one row with nulls and error set, so that no file goes unseen. Columns of the
    files that clash with those named are left out. An empty table gives no rows.
    """
    small_batches(files.sparkSession)
    new = {"track", "timestamp_ns", "keyframe", "lacing", "cluster", "start", "size", "cue", "error"}
    rest = [f for f in files.schema if f.name != media_col and f.name.lower() not in new]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)

    def run(batches):
        for batch in text_batches(batches, media_col):
            rows, out, errors = [], [], []
            for i, data in enumerate(utf8(batch.column(media_col))):
                try:
                    media = parse(data)
                    timed = {(t * media.scale_ns, k) for t, k, _ in media.cues}
                    found = [(p.track, p.timestamp_ns, p.keyframe, p.lacing, p.cluster, p.start, p.size, (p.timestamp_ns, p.track) in timed) for p in media.packets]
                    error = None if found else "no packets"
                except (ValueError, IndexError) as e:
                    found, error = [], str(e)
                out += found or [(None,) * 8]
                rows += [i] * max(1, len(found))
                errors += [error] * max(1, len(found))
            columns = list(zip(*out, strict=True)) or [()] * 8
            types = (pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            kept = [batch.column(f.name).take(pa.array(rows, pa.int64())) for f in rest]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)], pa.array(errors, pa.string())], names=[*[f.name for f in rest], "track", "timestamp_ns", "keyframe", "lacing", "cluster", "start", "size", "cue", "error"])

    return files.select(*[f.name for f in rest], media_col).mapInArrow(run, f"{fields}{PACKETS}, error string")


def padded(text: bytes) -> bytes:
    """The bytes with zeros appended up to a positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def _digests(batches):
    for batch in text_batches(batches):
        out = []
        for text in utf8(batch.column("text")):
            stored = write(padded(text))
            media = parse(stored)
            back = payload(stored, media, 1)
            samples = np.frombuffer(back, np.uint8)
            last = media.packets[-1]
            feature = f"packets={len(media.packets)};clusters={last.cluster + 1};cues={len(media.cues)};last_ns={last.timestamp_ns};sum={int(samples.sum(dtype=np.int64))};peak={int(samples.max())};steps={int(np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64))}"
            out.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
        columns = list(zip(*out, strict=True)) or [()] * 7
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names)


def op1_matroska_media(spark, sf_dir: str) -> DataFrame:
    """Query: every whole text stored as PCM in a Matroska file, parsed back to packets and read from their byte ranges.

    Null texts are empty; repeated rows give repeated results; an empty table gives no rows.
    """
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
