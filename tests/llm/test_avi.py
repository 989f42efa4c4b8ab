"""Exact round trips through AVI motion-JPEG, the general JPEG decoder and shot detection."""

import hashlib
import zlib

import numpy as np
import pytest

from discloom.llm import avi


def test_zigzag_order():
    assert avi.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(avi.ZIGZAG) == list(range(64))


@pytest.mark.parametrize("n", [1, 3, 50])
def test_lossless_for_any_bytes(n):
    payload = np.random.default_rng(n).integers(0, 256, n * avi.FRAME).astype(np.uint8)
    payload[: avi.FRAME] = np.tile([0, 255], avi.FRAME // 2)
    video = avi.read_avi(avi.write_avi(avi.encode_frames(payload)))
    assert video.frame_ms == 40 and np.concatenate(avi.block_means(video.frames)).tobytes() == payload.tobytes()
    slow = avi.decode_jpeg(video.frames[-1])
    assert (slow == np.kron(payload[-avi.FRAME :].reshape(24, 24), np.ones((8, 8)))).all()


def test_general_decoder_with_ac_and_restarts():
    # two blocks, a restart after each: DC 10 and AC (1 zero, then -3), then DC -4
    tables = avi._segment(0xC4, b"\x00" + avi._tables(((2, (4, 3)),))) + avi._segment(0xC4, b"\x10" + avi._tables(((2, (0, 0x12)),)))
    head = b"\xff\xd8" + avi._segment(0xDB, b"\x00" + bytes([2] * 64)) + avi._segment(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0])) + tables + avi._segment(0xDD, b"\x00\x01") + avi._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    bits = lambda s: int(s.ljust(-(-len(s) // 8) * 8, "1"), 2).to_bytes(-(-len(s) // 8), "big")
    frame = head + bits("00" + "1010" + "01" + "00" + "00") + b"\xff\xd0" + bits("01" + "011" + "00") + b"\xff\xd9"
    _, found = avi.decode_coefficients(frame)
    want = np.zeros((2, 64), int)
    want[0, 0], want[0, 8], want[1, 0] = 10, -3, -4
    assert found.tolist() == want.tolist()
    assert avi.decode_jpeg(frame).shape == (8, 16)
    assert avi.block_means([frame])[0].tolist() == [round(10 * 2 / 8 + 128), 127]


def test_cuts_stand_where_the_picture_changes():
    images = np.concatenate([np.full((10, 576), 20), np.full((5, 576), 200), np.full((3, 576), 90)]).astype(np.uint8)
    assert avi.clips(images, np.array([0, 18])) == [[(0, 10), (10, 15), (15, 18)]]
    assert avi.clips(images, np.array([0, 12, 18])) == [[(0, 10), (10, 12)], [(0, 3), (3, 6)]]


def test_broken_files_raise():
    with pytest.raises(ValueError):
        avi.read_avi(b"RIFFxxxxWAVE")
    good = bytearray(avi.write_avi(avi.encode_frames(np.zeros(576, np.uint8))))
    good[good.index(b"movi") + 4] = 0
    with pytest.raises(ValueError):
        avi.read_avi(bytes(good))


def test_documents(spark):
    rows = [(1, "abc", 1), (2, None, 2), (3, "", 3), (4, "é" * 288, 4), (5, "x" * 577, 5), (6, "long " * 400_000, 6), (None, "abc", 7), (1, "abc", 8)]
    got = avi.media_features(avi.encode_media(spark.createDataFrame(rows, "doc_id long, text string, media int"))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8
    for i, t, _ in rows:
        raw, p = (t or "").encode(), avi.pad((t or "").encode())
        assert len(p) % 576 == 0 < len(p)
        assert (by[i].n_bytes, by[i].payload_bytes, by[i].payload_sha256, by[i].tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert by[2][1:] == by[3][1:] and by[1][1:] == by[None][1:]
    assert avi.clip_rows(avi.encode_media(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
