"""Media columns: AVI motion-JPEG, written, indexed, decoded and cut into timed clips.

A payload is stored 576 bytes to an intra frame: a baseline grayscale JPEG of 24 x 24 blocks whose quantised DC
coefficients are the bytes less 128 at a step of 8, all AC coefficients being zero. Every block is therefore flat
and any JPEG decoder shows the byte itself as its 8 x 8 samples: storage is lossless, and the blocks' means (the
"DC image") are the frame's 24 x 24 8-bit samples. Frames carry their own Huffman tables.

Reading: RIFF chunks are walked, idx1 locates the frames, headers are parsed and the entropy-coded segments of
many frames are decoded side by side in numpy, a block of each at a time; a frame that the side-by-side decoder
doesn't cover (AC coefficients, restart intervals) goes to decode_jpeg(), which takes any baseline grayscale frame.

Shots: frames' 16-bin histograms are compared with their predecessors'; a cut stands where half the L1 difference
exceeds both FLOOR and the mean plus SPREAD deviations of up to eight differences before it.

Edge cases: null and empty texts give one frame of bytes 255; a text of any length is taken whole, 4096 frames at a
time; a broken container raises ValueError in read_avi(). Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from discloom.llm.common import bounded_batches, byte_view, slices

SIDE = 24
FRAME = SIDE * SIDE
FRAME_MS = 40
BINS, WINDOW, SPREAD, FLOOR = 16, 8, 2.5, 0.12
STEP = 8
#: Frames encoded or decoded side by side.
LANES = 4096
#: Payload bytes of texts handled at once.
CHUNK = 2 << 20

#: DC categories by code length, shortest first: differences of bytes in prose are mostly of 3 to 7 bits.
DC_LENGTHS = ((2, (6, 5)), (3, (4, 3, 7)), (4, (2,)), (5, (1,)), (6, (0,)), (7, (8,)))
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _tables(lengths: tuple[tuple[int, tuple[int, ...]], ...]) -> bytes:
    counts = dict((n, len(s)) for n, s in lengths)
    return bytes(counts.get(n, 0) for n in range(1, 17)) + bytes(x for _, s in lengths for x in s)


def _codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a canonical Huffman table."""
    out, code, at = {}, 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[symbols[at]] = (code, n)
            code, at = code + 1, at + 1
        code <<= 1
    return out


HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + bytes([STEP] * 64))
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE * 8, SIDE * 8, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + _tables(DC_LENGTHS))
    + _segment(0xC4, b"\x10" + _tables(((1, (0,)),)))
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)


@lru_cache(1)
def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """For each difference -255..255: its DC code, its value's bits and the end-of-block code; and their length."""
    table = _tables(DC_LENGTHS)
    codes = _codes(table[:16], table[16:])
    value, length = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        bits = d if d >= 0 else d + (1 << size) - 1
        value[d + 255], length[d + 255] = ((code << size | bits) << 1), n + size + 1
    return value, length


def encode_frames(payload: np.ndarray) -> list[bytes]:
    """JPEG frames of a payload whose length is a multiple of 576."""
    value, length = _encoder()
    frames: list[bytes] = []
    for at in range(0, len(payload), FRAME * LANES):
        x = payload[at : at + FRAME * LANES].reshape(-1, FRAME).astype(np.int16) - 128
        d = np.diff(x, axis=1, prepend=np.int16(0)) + 255
        code, size = value[d], length[d]
        ends = np.cumsum(size, axis=1)
        full = (ends[:, -1] + 7) >> 3
        base = np.concatenate([[0], np.cumsum(full)])
        place = (ends - size) + (base[:-1] * 8)[:, None]
        shifted = (code << (24 - size - (place & 7)).astype(np.uint32)).ravel()
        where = (place >> 3).ravel()
        out = np.zeros(base[-1] + 3, np.uint8)
        for k in range(3):
            np.add.at(out, where + k, (shifted >> np.uint32(16 - 8 * k)).astype(np.uint8))
        out = out[: base[-1]]
        out[base[1:] - 1] |= ((1 << (full * 8 - ends[:, -1])) - 1).astype(np.uint8)
        stuffed = np.flatnonzero(out == 255)
        data = np.insert(out, stuffed + 1, 0).tobytes()
        bounds = (base + np.searchsorted(stuffed, base)).tolist()
        frames += [HEADER + data[a:b] + b"\xff\xd9" for a, b in zip(bounds, bounds[1:], strict=False)]
    return frames


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = SIDE * 8, height: int = SIDE * 8, frame_ms: int = FRAME_MS) -> bytes:
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", frame_ms * 1000, largest * 1000 // frame_ms, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, frame_ms, 1000, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    headers = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    body, index, at = [b"movi"], [], 4
    for f in frames:
        body.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + headers + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


@dataclass
class Video:
    frame_ms: float
    frames: list[bytes]


def read_avi(data: bytes) -> Video:
    """Frames of the first stream, found by idx1 (offsets from `movi` or from the file's start)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, micros, at, end = None, b"", None, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        kind = data[at + 8 : at + 12]
        if name == b"LIST" and kind == b"movi":
            movi = at + 8
        elif name == b"LIST" and kind == b"hdrl":
            place = data.index(b"avih", at, at + 8 + size)
            micros = struct.unpack_from("<I", data, place + 8)[0]
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi is None or micros is None:
        raise ValueError("AVI file without hdrl or movi")
    frames = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", index):
        if name[:2] != b"00" or name[2:] not in (b"dc", b"db"):
            continue
        start = movi + offset if data[movi + offset : movi + offset + 4] == name else offset
        if data[start : start + 4] != name or struct.unpack_from("<I", data, start + 4)[0] != size:
            raise ValueError("index and chunks disagree")
        frames.append(data[start + 8 : start + 8 + size])
    return Video(micros / 1000, frames)


@dataclass(frozen=True)
class Coding:
    """What a frame's headers say."""

    width: int
    height: int
    quant: tuple[int, ...]
    dc: tuple[bytes, bytes]
    ac: tuple[bytes, bytes]
    restart: int

    @property
    def blocks(self) -> int:
        return -(-self.width // 8) * -(-self.height // 8)


@lru_cache(64)
def _parse_header(head: bytes) -> Coding:
    quant, tables, restart, size, at = {}, {}, 0, None, 2
    while at < len(head):
        marker, n = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + n]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = struct.unpack_from(">64H" if wide else ">64B", body, 1)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                m = sum(body[1:17])
                tables[body[0]] = body[1:17], body[17 : 17 + m]
                body = body[17 + m :]
        elif marker == 0xC0:
            size = struct.unpack_from(">BHHBBBB", body)
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if size is None or size[3] != 1:
                raise ValueError("only grayscale frames are decoded")
            return Coding(size[2], size[1], quant[size[6]], tables[body[2] >> 4], tables[0x10 | body[2] & 15], restart)
        at += 2 + n
    raise ValueError("frame without scan")


def _split(frame: bytes) -> tuple[bytes, bytes]:
    """Headers up to the scan, and the entropy-coded bytes."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    if frame.startswith(HEADER):
        return HEADER, frame[len(HEADER) : -2]
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    return frame[:at], frame[at : frame.rindex(b"\xff\xd9")]


def decode_coefficients(frame: bytes) -> tuple[Coding, np.ndarray]:
    """Quantised coefficients (blocks, 64) in natural order, of any baseline grayscale frame."""
    head, data = _split(frame)
    coding = _parse_header(head)
    dc = {(n, c): s for s, (c, n) in _codes(*coding.dc).items()}
    ac = {(n, c): s for s, (c, n) in _codes(*coding.ac).items()}
    parts = [data] if not coding.restart else __import__("re").split(rb"\xff[\xd0-\xd7]", data)
    out = np.zeros((coding.blocks, 64), np.int32)
    block = 0
    for part in parts:
        bits = "".join(f"{b:08b}" for b in part.replace(b"\xff\x00", b"\xff"))
        at, last = 0, 0

        def symbol(codes: dict) -> int:
            nonlocal at
            for n in range(1, 17):
                if (s := codes.get((n, int(bits[at : at + n] or "0", 2)))) is not None and at + n <= len(bits):
                    at += n
                    return s
            raise ValueError("broken entropy-coded data")

        def number(n: int) -> int:
            nonlocal at
            v = int(bits[at : at + n], 2) if n else 0
            at += n
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        for _ in range(min(coding.restart or coding.blocks, coding.blocks - block)):
            last += number(symbol(dc))
            out[block, 0] = last
            k = 1
            while k < 64:
                s = symbol(ac)
                if s == 0:
                    break
                k += s >> 4
                if s != 0xF0:
                    out[block, ZIGZAG[k]] = number(s & 15)
                k += 1
            block += 1
    return coding, out


@lru_cache(1)
def _basis() -> np.ndarray:
    x, u = np.arange(8), np.arange(8)
    c = np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return c[:, None] * np.cos((2 * x[None, :] + 1) * u[:, None] * np.pi / 16)


def decode_jpeg(frame: bytes) -> np.ndarray:
    """The 8-bit samples of a baseline grayscale frame."""
    coding, found = decode_coefficients(frame)
    quant = np.zeros(64)
    quant[ZIGZAG] = coding.quant
    b = (found * quant).reshape(-1, 8, 8)
    samples = np.clip(np.rint(_basis().T @ b @ _basis() + 128), 0, 255).astype(np.uint8)
    wide, high = -(-coding.width // 8), -(-coding.height // 8)
    return samples.reshape(high, wide, 8, 8).transpose(0, 2, 1, 3).reshape(high * 8, wide * 8)[: coding.height, : coding.width]


@lru_cache(8)
def _lookup(coding: Coding) -> tuple[np.ndarray, np.ndarray, int, int] | None:
    """By the next 16 bits: category and code length of a DC code; the end-of-block code and its length."""
    size, length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    longest = 0
    for s, (c, n) in _codes(*coding.dc).items():
        size[c << (16 - n) : (c + 1) << (16 - n)], length[c << (16 - n) : (c + 1) << (16 - n)] = s, n
        longest = max(longest, n + s)
    end = _codes(*coding.ac).get(0)
    return None if end is None or coding.restart or longest + end[1] > 25 else (size, length, *end)


def block_means(frames: list[bytes]) -> list[np.ndarray]:
    """The DC image of each frame: 8-bit means of its blocks."""
    out: list[np.ndarray | None] = [None] * len(frames)
    groups: dict[bytes, list[int]] = {}
    data: list[bytes] = []
    for n, f in enumerate(frames):
        head, body = _split(f)
        groups.setdefault(head, []).append(n)
        data.append(body)
    for head, own in groups.items():
        coding = _parse_header(head)
        found = _lookup(coding)
        for at in range(0, len(own), LANES):
            lanes = own[at : at + LANES]
            means, good = (None, np.zeros(len(lanes), bool)) if found is None else _side_by_side([data[n] for n in lanes], coding, found)
            for k, n in enumerate(lanes):
                dc = means[k] if good[k] else decode_coefficients(frames[n])[1][:, 0]
                out[n] = np.clip(np.rint(dc * (coding.quant[0] / 8) + 128), 0, 255).astype(np.uint8)
    return out


def _side_by_side(data: list[bytes], coding: Coding, found: tuple[np.ndarray, np.ndarray, int, int]) -> tuple[np.ndarray, np.ndarray]:
    size_of, length_of, end, end_bits = found
    plain = [x.replace(b"\xff\x00", b"\xff") for x in data]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in plain])]).astype(np.int64)
    raw = np.frombuffer(b"".join(plain) + b"\xff" * 8, np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at, good, last = starts[:-1] * 8, np.ones(len(data), bool), np.zeros(len(data), np.int32)
    out = np.empty((coding.blocks, len(data)), np.int32)
    limit = len(window) * 8 - 1
    for k in range(coding.blocks):
        bits = window[at >> 3] << (at & 7).astype(np.uint32)
        code = bits >> np.uint32(16)
        n, size = length_of[code].astype(np.uint32), size_of[code].astype(np.uint32)
        rest = bits << n
        v = (rest >> np.uint32(1) >> (np.uint32(31) - size)).astype(np.int32)
        half = (np.int32(1) << size.astype(np.int32)) >> 1
        last = last + np.where(v < half, v - 2 * half + 1, v)
        out[k] = last
        good &= (n > 0) & ((rest << size) >> np.uint32(32 - end_bits) == end)
        at = np.minimum(at + n + size + end_bits, limit)
    good &= at <= starts[1:] * 8
    return out.T, good


def clips(images: np.ndarray, firsts: np.ndarray) -> list[list[tuple[int, int]]]:
    """Shots of several videos: images (frames, samples), firsts: where each video begins, and the end."""
    total = len(images)
    flat = (np.arange(total)[:, None] * BINS + (images >> 4)).ravel()
    shares = np.bincount(flat, minlength=total * BINS).reshape(total, BINS) / images.shape[1]
    diff = np.zeros(total)
    diff[1:] = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    video = np.searchsorted(firsts, np.arange(total), side="right") - 1
    lead = np.maximum(firsts[video] + 1, np.arange(total) - WINDOW)
    n = np.maximum(np.arange(total) - lead, 0)
    sums = np.concatenate([[0], np.cumsum(diff)])
    squares = np.concatenate([[0], np.cumsum(diff * diff)])
    at, lead = np.arange(total), np.minimum(lead, np.arange(total))
    mean = (sums[at] - sums[lead]) / np.maximum(n, 1)
    deviation = np.sqrt(np.maximum((squares[at] - squares[lead]) / np.maximum(n, 1) - mean * mean, 0))
    cut = (diff > np.maximum(FLOOR, np.round(mean + SPREAD * deviation, 9))) & (at > firsts[video])
    out = []
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        marks = [0, *(np.flatnonzero(cut[a:b])).tolist(), int(b - a)]
        out.append([(x, y) for x, y in zip(marks, marks[1:], strict=False) if y > x])
    return out


def pad(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % FRAME or (0 if text else FRAME))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        raw = data.tobytes()
        for a, b in slices(offsets, CHUNK):
            payloads = [pad(raw[offsets[k] : offsets[k + 1]]) for k in range(a, b)]
            frames = encode_frames(np.frombuffer(b"".join(payloads), np.uint8))
            media, at = [], 0
            for p in payloads:
                media.append(write_avi(frames[at : at + len(p) // FRAME]))
                at += len(p) // FRAME
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _groups(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    start, held, size = 0, [], 0
    for k, x in enumerate(column):
        held.append(x.as_py())
        size += len(held[-1])
        if size >= 2 * CHUNK:
            yield start, held
            start, held, size = k + 1, [], 0
    if held:
        yield start, held


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, media in _groups(batch.column(2)):
            videos = [read_avi(x) for x in media]
            images = np.stack(block_means([f for v in videos for f in v.frames]))
            firsts = np.concatenate([[0], np.cumsum([len(v.frames) for v in videos])])
            shots = clips(images, firsts)
            payload = images.tobytes()
            rows = []
            for k, (v, x, own) in enumerate(zip(videos, media, shots, strict=True)):
                p = payload[firsts[k] * FRAME : firsts[k + 1] * FRAME]
                spans = [{"clip": n, "first_frame": a, "frames": b - a, "start_ms": int(a * v.frame_ms), "end_ms": int(b * v.frame_ms)} for n, (a, b) in enumerate(own)]
                told = f"frames={len(v.frames)};clips=" + ",".join(f"{s['start_ms']}-{s['end_ms']}" for s in spans)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(x), hashlib.sha256(x).hexdigest(), told, spans))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, len(media)), batch.column(1).slice(start, len(media)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"],
            )


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<clip:int,first_frame:int,frames:int,start_ms:bigint,end_ms:bigint>>"


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (before padding), media (an AVI file)."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_write, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """FEATURES' columns for rows of doc_id, n_bytes and media."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, FEATURES)


def clip_rows(media: DataFrame) -> DataFrame:
    """One row for each shot: doc_id, clip, first_frame, frames, start_ms, end_ms."""
    return media_features(media).select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")
