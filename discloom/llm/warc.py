"""WARC archives: written one gzip member a record, read back by a splittable reader.

Writing: pages of equal payloads of at least 100 bytes are stored once, as the response of the smallest page_id;
the others are revisit records that name its digest and refer to it. Finding them moves only (page_id, digest, size)
rows through a shuffle; html travels only if the table of revisits is too large for the planner to broadcast.
Each task writes files into the shared folder under names of its own attempt, and the manifest of files is
itself a table committed by Spark: what a lost attempt wrote is in no manifest.

Reading: files are cut into byte ranges. A task scans its range for the gzip magic, validates a candidate by decoding
its first bytes up to the end of the WARC headers, and owns the records that start inside its range, reading beyond its
end where the last one does; after a record the next one starts where its member ends. A member that passes and
then proves broken (checksum, length, digest) raises ValueError, so damage is never skipped in silence.

Edge cases: null html is an empty payload, null urls are left out of the headers; ties on page_id with equal payloads
are all responses; a null page_id is written as an empty id and read back as null, and is never the one referred to
where another page has the payload. A url that can't stand in a header as it is (control characters, blanks, letters
beyond ASCII) is percent-escaped there and kept whole in a field beside it; any other is stored and read as it stands. Headers
may have any length. Extra columns are not looked at.
Archives are opened by pyarrow.fs, so any store that it knows will do.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from discloom.llm.common import bounded_batches, materialise, scratch_path

LEAST_REVISIT = 100
SPLIT_BYTES = 4 << 20
#: Bytes of records after which a task starts another file.
FILE_BYTES = 256 << 20
LEVEL = 3
MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_KINDS = {"response", "revisit"}


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member."""
    block = _HTTP if refers_to is not None else _HTTP + payload
    uri = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url is not None else None
    fields = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", uri), ("X-Original-URL", quote(url, safe="") if url != uri else None), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if refers_to is not None else None),
        ("WARC-Refers-To", _record_id(refers_to) if refers_to is not None else None),
        ("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Refers-To-Page-ID", None if refers_to is None else str(refers_to)), ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        done, out, size, records, name = [], None, 0, 0, ""
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size, records = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = make_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, records))
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["path", "bytes", "records"])

    return write


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of each page that repeats another's payload of at least LEAST_REVISIT bytes."""
    rows = pages.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", F.sha2("html", 256).alias("digest"))
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").select("digest", "refers_to")
    return rows.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write_warc(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) as archives under folder; returns the manifest: path, bytes, records."""
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or scratch_path(spark, "warc")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    again = materialise(revisits(pages), "revisits").withColumnsRenamed({"page_id": "again", "digest": "same"})
    full = pages.withColumn("digest", F.sha2("html", 256))
    full = full.join(again, full["page_id"].eqNullSafe(again["again"]) & (full["digest"] == again["same"]), "left")
    return materialise(full.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_writer(folder), "path string, bytes long, records long"), "manifest")


class _Window:
    """A file's bytes from a place on, read as needed and dropped once passed."""

    def __init__(self, file: pa.NativeFile, at: int, size: int):
        self.file, self.base, self.size, self.data = file, at, size, b""

    def upto(self, end: int) -> None:
        while self.base + len(self.data) < min(end, self.size):
            start = self.base + len(self.data)
            piece = self.file.read_at(min(_READ, self.size - start), start)
            if not piece:
                raise ValueError(f"file ends at byte {start}, before its {self.size} bytes")
            self.data += piece

    def bytes_at(self, at: int, n: int) -> bytes:
        self.upto(at + n)
        return self.data[at - self.base : at - self.base + n]

    def forget(self, at: int) -> None:
        if at - self.base >= 2 * _READ:
            self.data, self.base = self.data[at - self.base :], at


def _headers(raw: bytes) -> dict[str, str] | None:
    lines = raw.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        return None
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return fields if fields.get("warc-type") and fields.get("content-length", "").isdigit() else None


def _deflate_at(window: _Window, at: int) -> int | None:
    """Where the compressed data of a gzip member begins; None if its header can't be one."""
    head = window.bytes_at(at, 10)
    if len(head) < 10 or head[3] & 0xE0:
        return None
    flags, place = head[3], at + 10
    if flags & 4:
        place += 2 + int.from_bytes(window.bytes_at(place, 2), "little")
    for bit in (8, 16):
        if flags & bit:
            while (length := (piece := window.bytes_at(place, 4096)).find(0)) < 0:
                if not piece:
                    return None
                place += len(piece)
            place += length + 1
    return place + (2 if flags & 2 else 0)


def _candidate(window: _Window, at: int) -> bool:
    """Do the bytes at `at` begin a member that holds WARC headers? Its checksum is left to _member()."""
    place = _deflate_at(window, at)
    if place is None:
        return False
    inflate, head, end = zlib.decompressobj(-15), bytearray(), -1
    try:
        while end < 0 and not inflate.eof:
            piece = window.bytes_at(place, 4096)
            if not piece:
                return False
            seen = max(0, len(head) - 3)
            head += inflate.decompress(piece)
            if not head.startswith(b"WARC/1."[: len(head)]):
                return False
            end, place = head.find(b"\r\n\r\n", seen), place + len(piece)
    except zlib.error:
        return False
    return end >= 0 and _headers(bytes(head[:end])) is not None


def _member(window: _Window, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record whose member begins at `at`."""
    inflate, parts, place = zlib.decompressobj(31), [], at
    while not inflate.eof:
        piece = window.bytes_at(place, 1 << 16)
        if not piece:
            raise ValueError(f"truncated record at byte {at}")
        try:
            parts.append(inflate.decompress(piece))
        except zlib.error as e:
            raise ValueError(f"broken record at byte {at}: {e}") from e
        place += len(piece)
    head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
    fields = _headers(head)
    if fields is None or len(rest) != int(fields["content-length"]) + 4:
        raise ValueError(f"bad record at byte {at}")
    return fields, rest[:-4], place - len(inflate.unused_data)


def records_in(file: pa.NativeFile, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record that starts in [start, end)."""
    window, at, chained = _Window(file, start, size), start, False
    while at < end:
        window.forget(at)
        if not (chained and window.bytes_at(at, 3) == MAGIC):
            while True:
                window.upto(min(at + _READ, end + 2))
                found = window.data.find(MAGIC, at - window.base, min(window.base + len(window.data), end + 2) - window.base)
                if found >= 0:
                    at = window.base + found
                    if at >= end:
                        return
                    if _candidate(window, at):
                        break
                    at += 1
                elif window.base + len(window.data) >= min(end + 2, size):
                    return
                else:
                    at = max(at, window.base + len(window.data) - 2)
                    window.forget(at)
        fields, block, after = _member(window, at)
        yield at, fields, block
        at, chained = after, True


RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long"


def _rows(path: str, start: int, end: int, size: int) -> Iterator[tuple]:
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as file:
        for offset, fields, block in records_in(file, start, end, size):
            kind = fields["warc-type"]
            if kind not in _KINDS:
                continue
            digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
            refers = fields.get("x-refers-to-page-id")
            if kind == "response":
                payload = block.partition(b"\r\n\r\n")[2]
                told, digest, n = digest, hashlib.sha256(payload).hexdigest(), len(payload)
                if told and told != digest:
                    raise ValueError(f"{path}: digest of the record at byte {offset} differs")
            else:
                payload, n = None, int(fields["x-payload-length"])
            page, whole = fields.get("x-page-id"), fields.get("x-original-url")
            url = unquote(whole) if whole is not None else fields.get("warc-target-uri")
            yield int(page) if page else None, url, payload, n, digest, kind, int(refers) if refers else None, path, offset


def _reader(payloads: bool):
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.strip().split()[0] for x in RECORDS.split(",")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(kinds))], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for splits in batches:
            for path, start, end, size in zip(*(splits.column(c).to_pylist() for c in ("path", "start", "stop", "bytes")), strict=True):
                held, weight = [], 0
                for r in _rows(path, start, end, size):
                    held.append(r if payloads else (*r[:2], None, *r[3:]))
                    weight += (len(r[2] or b"") if payloads else 0) + 400
                    if weight >= 8 << 20:
                        yield batch(held)
                        held, weight = [], 0
                if held:
                    yield batch(held)

    return read


def read_warc(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """RECORDS' columns of every response and revisit record; manifest: path and bytes of each archive."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    splits = manifest.where("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
    splits = splits.withColumn("stop", F.least(F.col("start") + split_bytes, "bytes"))
    spark: SparkSession = manifest.sparkSession
    spread = max(1, min(splits.count(), 4 * spark.sparkContext.defaultParallelism))
    return splits.repartition(spread, "path", "start").select("path", "start", "stop", "bytes").mapInArrow(_reader(payloads), RECORDS)


def complete(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """records, written down, once each archive has given as many as its manifest says; ValueError otherwise."""
    records = materialise(records, "records")
    read = records.groupBy("path").agg(F.count("*").alias("read"))
    short = manifest.join(read, "path", "left").where(F.coalesce("read", F.lit(0)) != F.col("records")).select("path", "records", "read").first()
    if short is not None:
        raise ValueError(f"{short.path} holds {short.records} records, {short.read or 0} were read")
    return records


ORACLE = f"""
with p as (
  select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as digest, octet_length(encode(coalesce(html, ''))) as n from pages
), firsts as (
  select digest, min(page_id) as first from p where n >= {LEAST_REVISIT} group by digest
)
select p.page_id, p.n::bigint as payload_bytes, p.digest as payload_digest,
  case when f.first is null or p.page_id = f.first then 'response' else 'revisit' end as record_type,
  case when p.page_id <> f.first then f.first end as refers_to
from p left join firsts f on p.digest = f.digest and p.n >= {LEAST_REVISIT}
"""
