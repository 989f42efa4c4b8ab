"""Round trips of archives at every split size, false gzip magic, and damage."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from discloom.llm import warc


def make(pages):
    return b"".join(warc.make_record(i, u, p, hashlib.sha256(p).hexdigest(), r) for i, u, p, r in pages)


def read(data, size):
    out = []
    for start in range(0, len(data), size):
        out += list(warc.records_in(pa.BufferReader(data), start, min(len(data), start + size), len(data)))
    return [(o, f["x-page-id"], b) for o, f, b in out]


def test_every_split_owns_each_record_once():
    bait = warc.MAGIC * 50 + make([(99, "bait", b"inner", None)])
    noise = random.Random(1).randbytes(3000)
    data = make([(k, f"http://x/{k}", p, None) for k, p in enumerate([b"", b"a" * 5000, noise, b"tiny", bait[:40], warc.MAGIC])])
    whole = read(data, len(data))
    assert [x[1] for x in whole] == [str(k) for k in range(6)]
    for size in (1, 7, 100, 999, 4096):
        assert read(data, size) == whole


def test_damage_raises():
    data = bytearray(make([(1, "u", b"hello" * 100, None)]))
    data[-6] ^= 255
    with pytest.raises(ValueError):
        read(bytes(data), len(data))
    with pytest.raises(ValueError):
        read(bytes(data[: len(data) - 20]), len(data))


def test_pages_round_trip(spark):
    long = "é" * 60
    rows = [(5, "http://a/ä b\r\n", long, 1), (3, None, long, 1), (9, "u", long, 1), (3, None, long, 1), (1, "u", "short", 1), (2, "u", "short", 1), (4, "u", None, 1), (6, "u", "", 1), (None, "u", long, 1), (7, "u", "big " * 300_000, 1), (8, "u", "\x1f\x00\r\n\r\n" * 30, 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    manifest = warc.write_warc(frame)
    assert manifest.selectExpr("sum(records)").first()[0] == len(rows)
    got = warc.read_warc(manifest, 2000).collect()
    assert len(got) == len(rows)
    for r in got:
        page = next(x for x in rows if x[0] == r.page_id)
        payload = (page[2] or "").encode()
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(payload), hashlib.sha256(payload).hexdigest(), page[1])
        again = page[2] == long and r.page_id != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if again else ("response", None))
        assert r.payload is None if again else bytes(r.payload) == payload
    assert warc.read_warc(warc.write_warc(frame.limit(0))).collect() == []


def test_headers_of_any_length_at_every_split():
    rnd = random.Random(5)
    noisy = "http://x/" + "".join(rnd.choices("abcdefghij%2é ", k=200_000))
    data = make([(1, "http://x/" + "é" * 30_000, b"one", None), (2, noisy, b"two", None), (3, "http://x/a%20b", b"", None)])
    whole = read(data, len(data))
    assert [x[1] for x in whole] == ["1", "2", "3"]
    for size in (1000, 30_000, 77_777):
        assert read(data, size) == whole


def test_member_names_of_any_length():
    import struct

    inner = zlib.compressobj(3, zlib.DEFLATED, -15)
    plain = b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 7\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    body = inner.compress(plain) + inner.flush()
    member = b"\x1f\x8b\x08\x18\0\0\0\0\0\x03" + b"n" * 9000 + b"\0" + b"c" * 5000 + b"\0" + body + struct.pack("<II", zlib.crc32(plain), len(plain))
    assert [x[1] for x in read(member * 2, 4000)] == ["7", "7"]


def test_urls_come_back_as_they_are(spark):
    urls = ["http://x/a%20b", "http://x/a b", "", " led", "http://x/é", "a\r\nb: c", "100%", None, "x" * 200_000, "ü%41" * 60_000]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'t' as html", "1 as refers_to", "'x' as path")
    manifest = warc.write_warc(frame)
    got = warc.complete(warc.read_warc(manifest, 50_000), manifest)
    assert {r.page_id: r.url for r in got.collect()} == dict(enumerate(urls))
    short = manifest.withColumn("records", manifest["records"] + 1)
    with pytest.raises(ValueError):
        warc.complete(warc.read_warc(manifest), short)
