import hashlib
import random
import zlib

import pytest

from lexiloom.llm import media


@pytest.mark.parametrize("size", [0, 1, 64, 1000, 1024, 4096, 5000, 70000])
def test_round_trip(size):
    payload = random.Random(size).randbytes(size)
    data = media.write_matroska(payload)
    found = media.read_matroska(data)
    assert b"".join(data[p[3] : p[3] + p[4]] for p in found["packets"]) == payload
    assert len(found["cues"]) == len(found["clusters"]) and found["tracks"] == {1: "A_PCM/INT/LIT"}
    for cue, (start, time) in zip(found["cues"], found["clusters"]):
        at = found["segment"] + cue[media.CUE_CLUSTER]
        assert media.vint(data, at, keep_marker=True)[0] == media.CLUSTER and cue[media.CUE_TIME] == time
    times = [p[2] for p in found["packets"]]
    assert times == sorted(times)


@pytest.mark.parametrize("lacing,sizes", [(0, [7]), (1, [300, 255, 0, 9]), (2, [50, 50, 50]), (3, [500, 20, 700, 3]), (3, [4])])
def test_lacing(lacing, sizes):
    frames = [bytes([i]) * n for i, n in enumerate(sizes)]
    block = media.simple_block(frames, -5, lacing)
    data = media.HEADER + media.element(media.SEGMENT, media.element(media.CLUSTER, media.number(media.CLUSTER_TIME, 100) + block))
    packets = media.read_matroska(data)["packets"]
    assert [data[p[3] : p[3] + p[4]] for p in packets] == frames
    assert all(p[0] == 1 and p[2] == 95 and p[5] == lacing and p[6] for p in packets)


def test_unknown_sizes_and_broken_files():
    data = media.write_matroska(b"x" * 300)
    head = len(media.HEADER)
    body = data[data.index(media.TRACK_LIST, head) :]
    streamed = media.HEADER + bytes.fromhex("18538067") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + body
    assert sum(p[4] for p in media.read_matroska(streamed)["packets"]) == 300
    for broken in (b"", b"RIFF", data[: len(data) // 2], b"\x00" * 20):
        with pytest.raises(ValueError):
            media.read_matroska(broken)


def test_packet_table(spark):
    rows = [(1, media.write_matroska(b"abc" * 500)), (2, None), (3, b"no media"), (None, media.write_matroska(b"z"))]
    got = media.media_packets(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()
    assert sum(r.length for r in got if r.id == 1) == 1500 and not [r for r in got if r.id == 2]
    assert [r.error is not None for r in got if r.id == 3] == [True]


def test_query_of_every_document(spark, sf):
    by = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = media.op6_media(spark, sf).collect()
    assert len(got) == len(by)
    for r in got:
        raw = by[r.doc_id]
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:])


def live(clusters, payload=b"x" * 20):
    """A live file: a segment and clusters of unknown size, some with a tag after them."""
    unknown = b"\x01\xff\xff\xff\xff\xff\xff\xff"
    body = media.TRACK_LIST
    for i in range(clusters):
        body += media.CLUSTER.to_bytes(4, "big") + unknown + media.number(media.CLUSTER_TIME, i) + media.simple_block([payload], 0, 0)
        body += media.element(0x1254C367, b"") if i % 3 == 0 else b""
    return media.HEADER + media.SEGMENT.to_bytes(4, "big") + unknown + body


def test_live_files():
    found = media.read_matroska(live(2000))
    assert len(found["clusters"]) == len(found["packets"]) == 2000 and [p[2] for p in found["packets"]] == list(range(2000))


def test_cues_lead_to_clusters_by_position():
    data = media.write_matroska(b"y" * 40000)
    found = media.read_matroska(data)
    assert media.cued_clusters(found) == set(range(len(found["clusters"]))) and "cues=3" in media.feature(data, found)
    for cue in found["cues"]:
        cue[media.CUE_CLUSTER] += 1
    assert media.cued_clusters(found) == set() and "cues=0" in media.feature(data, found)


def test_broken_files_raise_value_errors_alone():
    r = random.Random(11)
    whole = [media.write_matroska(r.randbytes(n)) for n in (64, 5000, 9000)] + [live(20)]
    frames = [bytes([i]) * n for i, n in enumerate((500, 20, 700, 3))]
    whole.append(media.HEADER + media.element(media.SEGMENT, media.element(media.CLUSTER, media.number(media.CLUSTER_TIME, 1) + media.simple_block(frames, 0, 3) + media.simple_block(frames, 0, 1))))
    for i in range(10_000):
        data = bytearray(r.choice(whole))
        for _ in range(r.randint(1, 6)):
            k = r.randrange(min(len(data), 400)) if r.random() < 0.7 else r.randrange(len(data))
            data[k] = r.choice((0, 255, 127, 128, r.randrange(256)))
        if r.random() < 0.2:
            del data[r.randrange(len(data)) :]
        try:
            found = media.read_matroska(bytes(data))
            assert all(p[0] < 1 << 31 and p[2] < 1 << 63 for p in found["packets"])
        except ValueError:
            pass
    bad = media.to_vint(1) + b"\x00\x00" + bytes([128 | 3 << 1]) + b"\x02" + b"\xff" + b"\x81" + b"zz"  # an EBML lace whose first size is unknown
    with pytest.raises(ValueError):
        media.read_matroska(media.HEADER + media.element(media.SEGMENT, media.element(media.CLUSTER, media.number(media.CLUSTER_TIME, 1) + media.element(media.SIMPLE_BLOCK, bad))))


def test_odd_and_empty_tables(spark, odd, odd_rows, none):
    got = media.media_digests(odd).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(x[0]), len((x[1] or "").encode())) for x in odd_rows)
    empties = [r for r in got if not r.n_bytes]
    assert len({tuple(r)[1:] for r in empties}) == 1 and empties[0].payload_bytes == 64 and empties[0].tail_crc32 == zlib.crc32(bytes(64))
    assert media.media_digests(none).count() == 0
    files = spark.createDataFrame([(None, None), (None, live(3)), (7, b""), (7, b"")], "error long, timestamp binary")
    packets = media.media_packets(files.toDF("key", "file"), "key", "file").collect()
    assert len(packets) == 5 and sum(r.error is not None for r in packets) == 2 and not any(r.cued for r in packets)
    assert media.media_packets(files.toDF("key", "file").limit(0), "key", "file").count() == 0
