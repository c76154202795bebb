"""WARC records in ZIP-packaged archives, read by range without extraction.

Writing: every task packs its records into ZIP files in the shared folder. Each package holds
``archive/data.warc.gz`` (one gzip member a record), ``indexes/index.cdx`` (JSON lines with
offset and length of each record) and ``datapackage.json``, all *stored*, so the bytes of a record lie at a known place of the
package. Records whose payload is that of another one become ``revisit`` records.

Reading: ``members`` reads a package's end of central directory, its ZIP64 counterpart where the 32-bit
fields overflow, the central directory and the members' local headers; ``locate`` reads its index; ``read_records`` fetches the byte range
of each record, one package's neighbouring records in one request, and parses it. Nothing is unpacked to disk.

All files go through ``pyarrow.fs``, so the shared folder may be any store that it opens (``file``, ``hdfs``, ``s3`` under
Spark's names too, ``gs``). A task writes under a name of its own attempt, and only attempts whose manifest row
was committed are read, so lost executors and repeated attempts leave no duplicates.

Edge cases: a null html is an empty payload; payloads under ``MIN_REVISIT`` bytes are always responses; rows
repeating the smallest ``page_id`` of a payload are all responses; a null ``page_id`` is a revisit where the payload has
another id, else a response; urls may be null; an empty table writes no package and reads no record; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cores, file_system, materialize, new_path, small_batches, table

MIN_REVISIT = 100
PACKAGE_BYTES = 64 << 20
_READ_BYTES = 4 << 20
_LEVEL = 1
#: Signatures of the ZIP format (APPNOTE 4.3).
_LOCAL, _CENTRAL, _END, _END64, _AT64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF
_DATE = (1 << 5) | 1  # 1980-01-01
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


# ---- packages ----


class Package:
    """Writes a ZIP file of stored members to a stream; ``zip64`` forces the 64-bit structures."""

    def __init__(self, out, zip64: bool = False) -> None:
        self.out, self.at, self.zip64, self.entries = out, 0, zip64, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, parts: list[bytes]) -> None:
        crc, size, at = 0, sum(map(len, parts)), self.at
        for p in parts:
            crc = zlib.crc32(p, crc)
        wide = self.zip64 or size >= _MAX32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        sizes = (_MAX32, _MAX32) if wide else (size, size)
        raw = name.encode()
        self._put(struct.pack("<4s5H3L2H", _LOCAL, 45 if wide else 20, 0x800, 0, 0, _DATE, crc, *sizes, len(raw), len(extra)) + raw + extra)
        for p in parts:
            self._put(p)
        self.entries.append((raw, crc, size, at))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.entries:
            wide = self.zip64 or size >= _MAX32 or at >= _MAX32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
            shown = (_MAX32, _MAX32, _MAX32) if wide else (size, size, at)
            self._put(struct.pack("<4s6H3L5H2L", _CENTRAL, 45 if wide else 20, 45 if wide else 20, 0x800, 0, 0, _DATE, crc, *shown[:2], len(raw), len(extra), 0, 0, 0, 0, shown[2]) + raw + extra)
        size, n = self.at - start, len(self.entries)
        if self.zip64 or start >= _MAX32 or n >= _MAX16:
            at64 = self.at
            self._put(struct.pack("<4sQ2H2L4Q", _END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<4sLQL", _AT64, 0, at64, 1))
            n, size, start = _MAX16, _MAX32, _MAX32
        self._put(struct.pack("<4s4H2LH", _END, 0, 0, n, n, size, start, 0))


def members(read, size: int) -> dict[str, tuple[int, int]]:
    """Data offset and size of each stored member; ``read(at, n)`` gives bytes of a package of ``size`` bytes."""
    tail_at = max(0, size - 22 - _MAX16)
    tail = read(tail_at, size - tail_at)
    i = tail.rfind(_END)
    while i >= 0 and (len(tail) < i + 22 or i + 22 + struct.unpack_from("<H", tail, i + 20)[0] != len(tail)):
        i = tail.rfind(_END, 0, i)
    if i < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HLL", tail, i + 10)
    if n == _MAX16 or length == _MAX32 or start == _MAX32:
        if tail[i - 20 : i - 16] != _AT64:
            raise ValueError("no ZIP64 locator")
        end64 = read(struct.unpack_from("<Q", tail, i - 12)[0], 56)
        if end64[:4] != _END64:
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, out, at = read(start, length), {}, 0
    for _ in range(n):
        if directory[at : at + 4] != _CENTRAL:
            raise ValueError("the central directory is damaged")
        method, packed, plain, n_name, n_extra, n_note, local = *struct.unpack_from("<H", directory, at + 10), *struct.unpack_from("<LL3H", directory, at + 20), struct.unpack_from("<L", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra, x = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while x + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, x)
            if kind == 1:  # holds only those fields that overflow, in this order
                wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, x + 4))
                plain, packed, local = (next(wide) if v == _MAX32 else v for v in (plain, packed, local))
            x += 4 + width
        if method == 0:
            head = read(local, 30)
            if head[:4] != _LOCAL:
                raise ValueError("a local header is damaged")
            out[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
        at += 46 + n_name + n_extra + n_note
    return out


# ---- records ----


def _header(s: object) -> str:
    return "".join(c if c.isprintable() else "%{:02X}".format(ord(c) & 0xFF) for c in str(s))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record as one gzip member."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def parse(raw: bytes) -> tuple:
    """A row of ``RECORD`` from a gzip member; a response's payload must match its digest."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    key = lambda name: int(x) if (x := warc.get(name, "")[len("<urn:page:") : -1]) else None
    digest, kind = warc["warc-payload-digest"].removeprefix("sha256:"), warc["warc-type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of record {warc['warc-record-id']} is damaged")
    return key("warc-record-id"), int(_fields(http)["content-length"]), digest, kind, key("warc-refers-to"), warc.get("warc-target-uri"), payload if kind == "response" else None


# ---- Spark ----


def plan_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) plus ``payload_digest`` and ``refers_to``.

    Digests are grouped as narrow rows with partial aggregation, so a payload that a third of all pages share is no hot
    group; the pages' html moves once, by ``page_id`` and digest.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    full = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    narrow = full.where(F.octet_length("payload") >= MIN_REVISIT).select("page_id", "payload_digest")
    first = narrow.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = narrow.join(first, "payload_digest").where(F.coalesce(F.col("page_id") > F.col("refers_to"), F.lit(True)))
    again = again.select(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"), "refers_to").distinct()
    return full.join(again, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")), "left").drop("r_id", "r_digest")


def write_archives(planned: DataFrame, to: str, zip64: bool = False) -> DataFrame:
    """Writes the packages under ``to``; the manifest: ``path``, ``bytes``, ``records`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(to)
        task, done, parts, index, size = TaskContext.get(), 0, [], [], 0
        name = f"{base}/warc-{task.partitionId():05d}-{task.taskAttemptId()}"

        def flush() -> pa.RecordBatch:
            nonlocal done, parts, index, size
            path = f"{name}-{done:04d}.zip"
            with store.open_output_stream(path) as out:
                p = Package(out, zip64)
                p.add("archive/data.warc.gz", parts)
                p.add("indexes/index.cdx", ["".join(index).encode()])
                p.add("datapackage.json", [json.dumps({"profile": "data-package", "resources": [{"path": "archive/data.warc.gz", "bytes": size}]}).encode()])
                p.close()
            row = pa.RecordBatch.from_pydict({"path": [path], "bytes": [p.at], "records": [len(index)]}, pa.schema({"path": pa.string(), "bytes": pa.int64(), "records": pa.int64()}))
            done, parts, index, size = done + 1, [], [], 0
            return row

        for b in batches:
            for i in range(b.num_rows):
                page, url, payload, digest, refers = (b.column(c)[i].as_py() for c in ("page_id", "url", "payload", "payload_digest", "refers_to"))
                raw = record(page, url, payload, digest, refers)
                index.append(json.dumps({"url": url, "digest": digest, "offset": size, "length": len(raw)}) + "\n")
                parts.append(raw)
                size += len(raw)
                if size >= PACKAGE_BYTES:
                    yield flush()
        if parts:
            yield flush()

    store, base = file_system(to)
    store.create_dir(base, recursive=True)
    rows = planned.select("page_id", "url", "payload", "payload_digest", "refers_to")
    return rows.mapInArrow(run, "path string, bytes long, records long")


@contextmanager
def _reader(store, path: str) -> Iterator[Callable[[int, int], bytes]]:
    """A function that reads ranges of an open file, which is closed behind the block."""
    with store.open_input_file(path) as f:

        def read(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        yield read


def locate(manifest: DataFrame, at: str) -> DataFrame:
    """Byte ranges of runs of records: ``path``, ``offset``, ``length`` and the ``sizes`` of the records in the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(at)
        for b in batches:
            for path, size in zip(b.column("path").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                with _reader(store, path) as read:
                    found = members(read, size)
                    data, (index_at, index_size) = found["archive/data.warc.gz"][0], found["indexes/index.cdx"]
                    cdx = read(index_at, index_size)
                rows, start, sizes = ([], [], []), 0, []
                for line in io.BytesIO(cdx):
                    x = json.loads(line)
                    if sizes and (x["offset"] != start + sum(sizes) or x["offset"] - start >= _READ_BYTES):
                        for r, v in zip(rows, (data + start, sum(sizes), sizes), strict=True):
                            r.append(v)
                        sizes = []
                    if not sizes:
                        start = x["offset"]
                    sizes.append(x["length"])
                if sizes:
                    for r, v in zip(rows, (data + start, sum(sizes), sizes), strict=True):
                        r.append(v)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows[0])), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.int64()))], ["path", "offset", "length", "sizes"])

    return manifest.select("path", "bytes").mapInArrow(run, "path string, offset long, length long, sizes array<long>")


def read_records(ranges: DataFrame, at: str) -> DataFrame:
    """Rows of ``RECORD``, by one range read for each run of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(at)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = [c.split()[0] for c in RECORD.split(", ")]
        for b in batches:
            for path, offset, length, sizes in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length", "sizes")), strict=True):
                with _reader(store, path) as read:
                    raw, rows, pos = read(offset, length), [], 0
                for n in sizes:
                    rows.append(parse(raw[pos : pos + n]))
                    pos += n
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return ranges.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, zip64: bool = False) -> DataFrame:
    """Writes the pages as packages in the shared folder and reads them back."""
    spark = pages.sparkSession
    small_batches(spark)
    to = new_path(spark, "warc")
    manifest = materialize(write_archives(plan_revisits(pages), to, zip64), "warc-manifest")
    ranges = materialize(locate(manifest.repartition(cores(spark), "path"), to), "warc-ranges")
    return read_records(ranges.repartition(max(cores(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "offset"), to)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > least THEN least END AS refers_to
FROM m
"""
