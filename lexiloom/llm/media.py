"""Operator 6: media columns. Matroska files as binary columns, read into packet tables.

The reader walks EBML elements (variable-length ids and sizes), collects tracks,
clusters, block groups, simple blocks and cues, undoes Xiph, EBML and fixed-size
lacing, and gives one packet a row with its track, timestamp and byte range, and
whether a cue points at its cluster. The writer makes small lossless files, so that any payload can be stored as unsigned 8-bit
PCM samples and read back. Both handle one file at a time; Spark deals the files out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm.common import in_slices, table, thrifty

# Element ids of the public Matroska specification (fixed values).
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, TRACK_NUMBER, TRACK_TYPE, CODEC_ID, AUDIO = 0x2AD7B1, 0x4489, 0xD7, 0x83, 0x86, 0xE1
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
CONTAINERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
#: What ends a cluster of unknown size: the elements that stand beside clusters (seek head, tags, chapters, attachments last).
BESIDE_CLUSTERS = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}

RATE = 8000  # samples a second of the files written here; one sample is one byte
PACKET = 1024  # bytes a packet
LACED = 4  # packets a block
BLOCKS = 4  # blocks a cluster
PAD = 64

PACKET_SCHEMA = "track int, cluster int, timestamp long, start long, length int, lacing int, keyframe boolean, cued boolean"


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """A variable-length integer and where it ends; None if all its bits are ones (unknown size)."""
    first = data[at]
    if not first:
        raise ValueError(f"no length marker at byte {at}")
    length = 9 - first.bit_length()
    if at + length > len(data):
        raise ValueError(f"integer cut off at byte {at}")
    value = int.from_bytes(data[at : at + length], "big")
    if keep_marker:
        return value, at + length
    bits = (1 << 7 * length) - 1
    value &= bits
    return (None if value == bits else value), at + length


def to_vint(value: int, length: int = 0) -> bytes:
    length = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * length).to_bytes(length, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + to_vint(len(body)) + body


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start of body, end of body) of each element in a range; an unknown size reaches to the range's end."""
    while at < end:
        kind, at = vint(data, at, keep_marker=True)
        size, at = vint(data, at)
        stop = end if size is None else at + size
        if stop > end:
            raise ValueError(f"element {kind:X} leaves its parent at byte {at}")
        yield kind, at, stop
        at = stop


def walk(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, start of body, end of body) of a file's elements, containers before what they hold.

    A cluster of unknown size, as live streams have them, ends where an element
    begins that stands beside clusters; other unknown sizes reach to the parent's end.
    """
    at, parents = 0, [(0, len(data), False)]  # (id, end, whether its size is unknown)
    while True:
        while parents and at >= parents[-1][1]:
            parents.pop()
        if not parents:
            return
        start = at
        kind, at = vint(data, at, keep_marker=True)
        size, at = vint(data, at)
        while parents[-1][0] == CLUSTER and parents[-1][2] and kind in BESIDE_CLUSTERS:
            parents.pop()
        stop = parents[-1][1] if size is None else at + size
        if stop > parents[-1][1]:
            raise ValueError(f"element {kind:X} leaves its parent at byte {at}")
        yield kind, start, at, stop
        if kind in CONTAINERS:
            parents.append((kind, stop, size is None))
        else:
            at = stop


def laces(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(start, length) of each frame of a block's body."""
    if not lacing:
        return [(at, end - at)]
    frames, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:  # Xiph: sums of bytes, 255 goes on
        for _ in range(frames - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == 3 and frames > 1:  # EBML: a size, then signed differences
        size, at = vint(data, at)
        if size is None:
            raise ValueError(f"frame of unknown size at byte {at}")
        sizes.append(size)
        for _ in range(frames - 2):
            before = at
            raw, at = vint(data, at)
            bits = 7 * (at - before)
            raw = (1 << bits) - 1 if raw is None else raw
            sizes.append(sizes[-1] + raw - ((1 << bits - 1) - 1))
    elif lacing == 2:  # fixed size
        if (end - at) % frames:
            raise ValueError(f"frames of unequal size at byte {at}")
        sizes = [(end - at) // frames] * (frames - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"frame sizes exceed their block at byte {at}")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def read_matroska(data: bytes) -> dict:
    """Tracks, clusters (start, time), packets, cues and scale of a file. Raises ValueError, and nothing else, on broken files."""
    found: dict = {"tracks": {}, "packets": [], "cues": [], "scale": 1_000_000, "clusters": [], "segment": 0, "duration": None}

    def uint(a: int, b: int) -> int:
        if b - a > 8:
            raise ValueError(f"number of {b - a} bytes at byte {a}")
        return int.from_bytes(data[a:b], "big")

    def block(a: int, b: int, simple: bool) -> None:
        track, at = vint(data, a)
        (relative,), flags = struct.unpack(">h", data[at : at + 2]), data[at + 2]
        lacing = flags >> 1 & 3
        time = found["clusters"][-1][1] + relative
        if track is None or track >= 1 << 31 or time >= 1 << 63 or at + 3 > b:
            raise ValueError(f"bad block at byte {a}")
        for start, size in laces(data, at + 3, b, lacing):
            found["packets"].append((track, len(found["clusters"]) - 1, time, start, size, lacing, bool(flags & 128) if simple else True))

    try:
        if vint(data, 0, keep_marker=True)[0] != EBML:
            raise ValueError("not an EBML file")
        for kind, start, x, y in walk(data):
            if kind == SEGMENT:
                found["segment"] = x
            elif kind == CLUSTER:
                found["clusters"].append([start, 0])
            elif kind == CLUSTER_TIME:
                found["clusters"][-1][1] = uint(x, y)
            elif kind == TRACK:
                fields = {k: (p, q) for k, p, q in elements(data, x, y)}
                found["tracks"][uint(*fields[TRACK_NUMBER])] = data[slice(*fields[CODEC_ID])].decode() if CODEC_ID in fields else ""
            elif kind == TIMESTAMP_SCALE:
                found["scale"] = uint(x, y)
            elif kind == DURATION:
                found["duration"] = struct.unpack(">d" if y - x == 8 else ">f", data[x:y])[0]
            elif kind in (SIMPLE_BLOCK, BLOCK):
                block(x, y, kind == SIMPLE_BLOCK)
            elif kind == CUE_POINT:
                found["cues"].append({})
            elif kind in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                found["cues"][-1][kind] = uint(x, y)
    except (IndexError, struct.error, KeyError) as e:
        raise ValueError(f"broken file: {e!r}") from e
    return found


def cued_clusters(media: dict) -> set[int]:
    """Which clusters a cue points at: by the byte its position leads to, at the time it names."""
    pointed = {(c[CUE_CLUSTER] + media["segment"], c.get(CUE_TIME)) for c in media["cues"] if CUE_CLUSTER in c}
    return {i for i, cluster in enumerate(media["clusters"]) if tuple(cluster) in pointed}


HEADER = element(
    EBML,
    number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2),
)
TRACK_LIST = element(
    TRACKS,
    element(
        TRACK,
        number(TRACK_NUMBER, 1)
        + number(0x73C5, 1)
        + number(TRACK_TYPE, 2)
        + number(0x9C, 1)
        + element(CODEC_ID, b"A_PCM/INT/LIT")
        + element(AUDIO, element(0xB5, struct.pack(">d", RATE)) + number(0x9F, 1) + number(0x6264, 8)),
    ),
)


def simple_block(frames: list[bytes], relative: int, lacing: int) -> bytes:
    """One SimpleBlock of track 1 with its frames laced."""
    head = to_vint(1) + struct.pack(">hB", relative, 128 | lacing << 1)
    if not lacing:
        return element(SIMPLE_BLOCK, head + frames[0])
    sizes, laced = [len(f) for f in frames], bytes([len(frames) - 1])
    if lacing == 1:
        laced += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == 3 and len(sizes) > 1:
        laced += to_vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            length = next(n for n in range(1, 9) if abs(b - a) < (1 << 7 * n - 1) - 1)
            laced += to_vint(b - a + (1 << 7 * length - 1) - 1, length)
    return element(SIMPLE_BLOCK, head + laced + b"".join(frames))


def write_matroska(payload: bytes, packet: int = PACKET) -> bytes:
    """A Matroska file whose only track's frames, in order, are the payload.

    A millisecond is RATE / 1000 bytes. Blocks of several frames are laced: fixed
    where the frames are of one size, else EBML; cues point at each cluster.
    """
    per_cluster = packet * LACED * BLOCKS
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(0x4D80, b"lexiloom") + element(0x5741, b"lexiloom"))
    body, cues, at = [info, TRACK_LIST], [], len(info) + len(TRACK_LIST)
    for first in range(0, len(payload), per_cluster):
        time, parts = first * 1000 // RATE, []
        part = payload[first : first + per_cluster]
        for a in range(0, len(part), packet * LACED):
            frames = [part[i : i + packet] for i in range(a, min(a + packet * LACED, len(part)), packet)]
            lacing = 0 if len(frames) == 1 else 2 if len(frames[-1]) == packet else 3
            parts.append(simple_block(frames, a * 1000 // RATE, lacing))
        cluster = element(CLUSTER, number(CLUSTER_TIME, time) + b"".join(parts))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return HEADER + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


def feature(data: bytes, media: dict) -> str:
    """What the packet table says of a file: counts, span, clusters that a cue finds, and mean packet level."""
    packets = media["packets"]
    lacings = [sum(1 for p in packets if p[5] == k) for k in range(4)]
    levels = [sum(data[p[3] : p[3] + p[4]]) // max(1, p[4]) for p in packets]
    return (
        f"tracks={len(media['tracks'])};clusters={len(media['clusters'])};packets={len(packets)};lacing={'/'.join(map(str, lacings))};"
        f"cues={len(cued_clusters(media))};span={packets[-1][2] - packets[0][2] if packets else 0};level={sum(levels) // max(1, len(levels))}"
    )


def media_packets(files: DataFrame, key: str, media: str) -> DataFrame:
    """(key, packet columns, error) of a table with a binary Matroska column; one row a packet.

    A null file has no rows; a broken or empty file gives one row with the error
    and null packet columns, so one bad file doesn't stop a job. Keys may repeat or
    be null; an empty table stays empty; other columns don't matter.
    """
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            out: list[tuple] = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    found = read_matroska(data)
                    cued = cued_clusters(found)
                    out += [(k, *p, p[1] in cued, None) for p in found["packets"]]
                except ValueError as e:
                    out.append((k, *[None] * 8, str(e)))
            columns = list(zip(*out)) or [[]] * 10
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
            names = [key, *(c.split()[0] for c in PACKET_SCHEMA.split(", ")), "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return files.select(key, media).mapInArrow(thrifty(run), f"{key} {kind}, {PACKET_SCHEMA}, error string")


def digest(text: bytes) -> tuple:
    """Store a text, read the stored bytes back and describe both."""
    size = max(PAD, -(-len(text) // PAD) * PAD)
    stored = write_matroska(text.ljust(size, b"\0"))
    media = read_matroska(stored)
    payload = b"".join(stored[p[3] : p[3] + p[4]] for p in media["packets"])
    return (
        len(text),
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-PAD:]),
        len(stored),
        hashlib.sha256(stored).hexdigest(),
        feature(stored, media),
    )


def media_digests(docs: DataFrame) -> DataFrame:
    """n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of each of docs (doc_id, text).

    A null text is an empty one, whose payload is PAD zero bytes; rows may repeat, ids
    may be null; an empty table stays empty.
    """
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1):
            rows = [digest(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInArrow(thrifty(run), schema)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of every document."""
    return media_digests(table(spark, sf_dir, "documents"))
