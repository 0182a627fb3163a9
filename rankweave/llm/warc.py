"""Web archives in ZIP packages: WARC records with revisits, and a reader that range-reads them in place.

A package is a ZIP file with stored members ``archive/data.warc.gz`` (each record its own gzip member), ``indexes/index.cdxj``
(a line for each record: URL key, time, and JSON with offset and length) and ``datapackage.json``. The reader parses the
end record, its ZIP64 form and the central directory itself, finds where a stored member's bytes lie, and reads only the
ranges that the index names; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.common import small_batches
from rankweave.session import new_scratch_path, stored
from rankweave.sources.tables import spread, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of WARC data after which a new package is begun; bytes read at once.
PACKAGE, READ = 256 << 20, 4 << 20
TIME = "1970-01-01T00:00:00Z"


# ---------------------------------------------------------------- ZIP directory


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


class ZipDirectory:
    """The central directory of a ZIP file of ``size`` bytes, read through ``read(offset, length)``."""

    def __init__(self, read, size: int) -> None:
        self.read = read
        tail_at = max(0, size - 65_557)
        tail = read(tail_at, size - tail_at)
        found = tail.rfind(b"PK\x05\x06")
        while found >= 0 and found + 22 + struct.unpack_from("<H", tail, found + 20)[0] != len(tail):
            found = tail.rfind(b"PK\x05\x06", 0, found)
        if found < 0:
            raise ValueError("no end of a central directory")
        count, length, start = struct.unpack_from("<HII", tail, found + 10)
        if found >= 20 and tail[found - 20 : found - 16] == b"PK\x06\x07":
            end64 = read(struct.unpack_from("<Q", tail, found - 12)[0], 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
        raw, at = read(start, length), 0
        self.members: dict[str, Member] = {}
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("a damaged central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, whole, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
            header = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # 64-bit values, only of the fields that are full, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    whole = next(wide) if whole == 0xFFFFFFFF else whole
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                extra = extra[4 + n :]
            self.members[name] = Member(name, method, whole, packed, header)
            at += 46 + n_name + n_extra + n_comment

    def start(self, name: str) -> int:
        """Where the bytes of a stored member begin in the file."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} is compressed: it can't be read in ranges")
        local = self.read(member.header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return member.header + 30 + n_name + n_extra


# ---------------------------------------------------------------- records


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(uri: str | None) -> int | None:
    digits = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(digits[1]) if digits else None


def _clean(value: str) -> str:
    """A header value without line ends or other control characters."""
    return re.sub(r"[\x00-\x1f\x7f]", " ", value).strip()


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has the HTTP header alone, whose Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {TIME}",
        f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The WARC header, the HTTP header (names in lower case) and the payload bytes of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda part: {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in part.decode("utf-8", "surrogatepass").split("\r\n")[1:])}
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def url_key(url: str) -> str:
    """Host in reverse order, then the path, in lower case."""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}){parts.path}{'?' + parts.query if parts.query else ''}".lower()


class PackageWriter:
    """Streams records into a package; the index lines alone are held."""

    def __init__(self, sink) -> None:
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, url: str | None, record: bytes) -> None:
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        raw = pack.compress(record) + pack.flush()
        self.data.write(raw)
        place = json.dumps({"url": _clean(url or ""), "offset": str(self.at), "length": str(len(raw)), "filename": "data.warc.gz"}, ensure_ascii=False)
        self.lines.append(f"{re.sub(r'[ ]', '%20', url_key(_clean(url or '')))} 19700101000000 {place}\n")
        self.at += len(raw)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(sorted(self.lines)).encode("utf-8", "surrogatepass"))
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA, "bytes": self.at}, {"path": INDEX}]}))
        self.zip.close()


def _writer(folder: str, package: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        draft = f"{root}/.{task.taskAttemptId()}.draft"
        made, sink, out, n = [], None, None, 0

        def end() -> None:
            out.close()
            sink.close()
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.wacz"
            fs.move(draft, f"{root}/{name}")
            made.append((name, fs.get_file_info(f"{root}/{name}").size, n))

        for batch in batches:
            for page_id, url, html, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    sink, n = fs.open_output_stream(draft), 0
                    out = PackageWriter(sink)
                out.add(url, warc_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to, revisit))
                n += 1
                if out.at >= package:
                    end()
                    out = None
        if out is not None:
            end()
        names, sizes, counts = zip(*made) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["path", "n_bytes", "n_records"])

    return write


def write_packages(pages: DataFrame, folder: str, least_bytes: int = 0, package: int = PACKAGE) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) in packages under ``folder``; the manifest (path, n_bytes, n_records).

    Of the rows with equal payloads of at least ``least_bytes``, those with the largest page_id are responses and the others
    revisits that refer to it; rows with smaller payloads are all responses. A null html is an empty payload. Names hold the
    attempt of the task, so one that runs again leaves the packages of the other alone, and the manifest names those of the
    attempt that counts.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.unhex(F.sha1(payload)).alias("sha1"), (F.length(payload) >= least_bytes).alias("counts"))
    # only payloads that come again have a row here, so the other side of a common one can be split at will
    first = rows.where("counts").groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    rows = rows.join(first, "sha1", "left")
    revisit = F.col("counts") & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", "html", "sha1", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    rows = rows.withColumn("sha1", _base32(F.col("sha1")))
    rows = rows.sortWithinPartitions("page_id", "url")
    manifest = small_batches(rows).mapInArrow(_writer(folder, package), "path string, n_bytes long, n_records long")
    return stored(manifest, "packages")


def _base32(sha1):
    """20 bytes in base32, in groups of 5 bits."""
    bits = F.lpad(F.conv(F.hex(F.substring(sha1, 1, 5)), 16, 32), 8, "0")
    for k in range(1, 4):
        bits = F.concat(bits, F.lpad(F.conv(F.hex(F.substring(sha1, 5 * k + 1, 5)), 16, 32), 8, "0"))
    return F.translate(bits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(read, size: int) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Every record that the indexes of a package name, by ranges of the archive members, in order of place."""
    directory = ZipDirectory(read, size)
    for name in [n for n in directory.members if n.startswith("indexes/") and n.endswith(".cdxj")]:
        at = directory.start(name)
        places: dict[str, list[tuple[int, int]]] = {}
        for line in read(at, directory.members[name].size).split(b"\n"):
            if line:
                entry = json.loads(line[line.index(b"{") :].decode("utf-8", "surrogatepass"))
                places.setdefault(f"archive/{entry['filename']}", []).append((int(entry["offset"]), int(entry["length"])))
        for archive, own in places.items():
            start = directory.start(archive)
            own.sort()
            k = 0
            while k < len(own):
                last = k + 1
                while last < len(own) and own[last][0] + own[last][1] - own[k][0] <= READ:
                    last += 1
                raw = read(start + own[k][0], own[last - 1][0] + own[last - 1][1] - own[k][0])
                for offset, length in own[k:last]:
                    yield parse_record(zlib.decompress(raw[offset - own[k][0] :][:length], 31))
                k = last


def _reader(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['path']}") as source:
                    found = []
                    for warc, http, payload in records(lambda at, n: source.read_at(n, at), row["n_bytes"]):
                        digest = warc["warc-payload-digest"].removeprefix("sha1:")
                        if warc["warc-type"] == "response" and payload_digest(payload) != digest:
                            raise ValueError(f"the payload of {warc['warc-record-id']} does not have its digest")
                        found.append((_page_id(warc["warc-record-id"]), int(http["content-length"]), digest, warc["warc-type"], _page_id(warc.get("warc-refers-to"))))
                        if len(found) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)
                            found = []
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    return read


def read_packages(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, from the packages; a package to a task."""
    files = manifest.select("path", "n_bytes")
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(_reader(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as packages under ``folder`` (the shared scratch folder where None) and read them back.

    Nulls in any column are kept as far as a record can say them: a null url is empty, a page without page_id has a null
    page_id and is a response if no equal payload has one. Other columns are ignored; an empty table gives no rows.
    """
    folder = folder or new_scratch_path(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, folder, least_bytes), folder)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


#: The same from the table alone; base32 is made of groups of five hex digits.
OP3_SQL = """
WITH raw AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
digests AS (SELECT page_id, html, octet_length(encode(html)) AS n, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS first FROM raw),
spelled AS (
  SELECT *, array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, CAST(k // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> (15 - k % 4 * 5)) & 31 AS INTEGER) + 1, 1)), '') AS digest FROM digests
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM spelled
"""
