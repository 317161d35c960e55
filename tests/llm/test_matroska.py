import random
import zlib

import pytest

from foliospark.llm import matroska as M


def payload(n):
    return bytes((i * 7 + i // 13) % 256 for i in range(n))


@pytest.mark.parametrize("frames", [1, 2, 9, 25, 1024, 1025, 3000])
def test_samples_come_back(frames):
    data = M.write_samples(payload(frames * M.FRAME))
    media = M.parse(data)
    assert M.samples_of(data, media) == payload(frames * M.FRAME)
    assert media.doc_type == "matroska" and media.tracks[1]["codec"] == "A_PCM/INT/LIT"
    assert [at for _, _, at in media.cues] == media.clusters
    assert len(media.packets) == frames
    assert all(a.timestamp_ns <= b.timestamp_ns for a, b in zip(media.packets, media.packets[1:], strict=False))


@pytest.mark.parametrize("lacing", M.LACINGS)
@pytest.mark.parametrize("sizes", [[5], [10, 10, 10], [300, 2, 255, 254, 0, 4000, 20000, 1]])
def test_laces(lacing, sizes):
    if lacing == "none" and len(sizes) > 1 or lacing == "fixed" and len(set(sizes)) > 1:
        return
    frames = [payload(n) for n in sizes]
    content = M.laced(frames, lacing)
    found, at = M.lace_sizes(content, 0, len(content), lacing)
    assert found == sizes and content[at:] == b"".join(frames)


def segment(*parts, unknown=False):
    content = b"".join(parts)
    head = M.element(M.EBML, M.element(M.DOC_TYPE, b"webm"))
    return head + ((0x18538067).to_bytes(4, "big") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + content if unknown else M.element(M.SEGMENT, content))


def block(track=1, offset=0, flags=0x80, frame=b"xy"):
    return M.coded(track) + offset.to_bytes(2, "big", signed=True) + bytes([flags]) + frame


def test_groups_unknown_sizes_and_voids():
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, block(2, -3, 0)) + M.whole(M.REFERENCE_BLOCK, 1))
    cluster = M.element(M.VOID, b"\0" * 9) + M.whole(M.TIMESTAMP, 10) + group + M.element(M.SIMPLE_BLOCK, block(1, 2))
    open_cluster = (0x1F43B675).to_bytes(4, "big") + b"\xff" + cluster
    media = M.parse(segment(open_cluster, open_cluster, unknown=True))
    assert [(p.track, p.timestamp_ns, p.keyframe, p.cluster, p.block) for p in media.packets] == [(2, 7_000_000, False, 0, 0), (1, 12_000_000, True, 0, 1), (2, 7_000_000, False, 1, 0), (1, 12_000_000, True, 1, 1)]


def test_numbers():
    for value in (0, 1, 126, 127, 128, 16382, 16383, 1 << 40):
        assert M.vint(M.coded(value), 0)[0] == value
    assert M.vint(b"\xff", 0)[0] == -1


@pytest.mark.parametrize("data", [b"", b"\0", b"RIFFxxxx", M.write_samples(payload(192))[:-5], segment(M.element(M.CLUSTER, M.element(M.SIMPLE_BLOCK, block(flags=0x86, frame=b"\x05\x90"))))])
def test_other_bytes_are_refused(data):
    with pytest.raises(M.MediaError):
        M.parse(data)


def test_rows(spark):
    rows = [(1, ""), (2, None), (3, "x" * 192), (4, "é" * 100_000), (4, "é" * 100_000), (None, "a\nb")]
    found = M.store_texts(spark.createDataFrame(rows, "doc_id long, text string"), with_media=True).collect()
    for r in found:
        raw = (r.text or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-16:]))
        assert M.samples_of(bytes(r.media), M.parse(bytes(r.media))) == padded
    assert len(found) == 6 and len({r.media_sha256 for r in found}) == 4
    assert M.store_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packet_table(spark):
    data = M.write_samples(payload(10 * 192))
    rows = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"no media")), (4, bytearray(data))], "doc_id long, media binary")
    found = M.packet_table(rows).collect()
    assert sum(r.row_id == 1 for r in found) == 10 and sum(r.row_id == 4 for r in found) == 10
    assert [(r.row_id, r.track) for r in found if r.error] == [(3, None)]
    one = [r for r in found if r.row_id == 1]
    assert b"".join(data[r.byte_start : r.byte_end] for r in one) == payload(10 * 192) and all(r.cued for r in one)


def test_corrupt_bytes_give_error_rows(spark):
    rng, good = random.Random(17), M.write_samples(payload(40 * 192))
    late = segment(M.element(M.CLUSTER, M.element(M.TIMESTAMP, b"\xff" * 8) + M.element(M.SIMPLE_BLOCK, block(1, 0))))
    long = segment(M.element(M.CLUSTER, M.element(M.TIMESTAMP, b"\x01" * 9) + M.element(M.SIMPLE_BLOCK, block(1, 0))))
    cases = [b"\xa0\xff" * 5000, (0x1F43B675).to_bytes(4, "big") + b"\xff" + b"\xa0\xff" * 5000, (0x18538067).to_bytes(4, "big") + b"\xff" + b"\x1f\x43\xb6\x75\xff" * 3000, late, long]
    for _ in range(150):
        data = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        cases.append(bytes(data[: rng.choice((len(data), rng.randrange(len(data))))]))
    for data in cases:
        try:
            M.parse(data)
        except M.MediaError:
            pass
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "doc_id long, media binary")
    found = M.packet_table(rows).collect()
    assert {r.row_id for r in found if r.error} >= {0, 1, 3, 4}
