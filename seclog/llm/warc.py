"""WARC records in ZIP packages, read by range.

A package is a ZIP file with two stored (not deflated) members: ``archive/data.warc.gz``, where each record is
a gzip member of its own, and ``indexes/index.cdxj`` with a line for each record: sort key, time, and JSON with
its offset and length. The reader parses the end-of-directory record, the ZIP64 locator and directory if
there are any, and the central directory; it finds a stored member's bytes behind its local header and then
reads the index and blocks of records by range. Nothing is unpacked to disk, and one block of
records is in memory at a time.

A page's payload is its html in UTF-8; a null html is an empty payload. Of the pages with equal payloads of at least
``min_bytes`` bytes, that of the smallest ``page_id`` is a response and the others are revisits that name it;
pages of equal smallest id are all responses; a null id is larger than any other, and if all are null all are responses.
A revisit has no payload, but its HTTP header keeps the length and its WARC header the digest.
Urls may be null (no target header); line breaks and blanks in urls are percent-encoded.

Packages are written and read by ``pyarrow.fs`` under a shared folder. A task writes files of its own and only
the files of tasks that ended well are in the manifest, so a lost executor leaves no half package in the result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut_lineage, table, text_batches, utf8, with_small

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed and a new one begun beyond this many bytes or records.
PACKAGE_BYTES, PACKAGE_RECORDS = 256 << 20, 50_000
#: Bytes of neighbouring records that are read at once.
BLOCK_BYTES = 8 << 20
LEVEL = 3
DATE = "2020-01-01T00:00:00Z"
EOL = b"\r\n"


def open_store(uri: str):
    """A file system and the path on it. ``file:/a``, ``file:///a`` and ``/a`` are alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


# ------------------------------------------------------------------ records

def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_url(url: str) -> str:
    """The url with blanks and control characters percent-encoded, so that it fits on a line."""
    return re.sub(r"[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """A WARC/1.1 record: a response, or (payload None) a revisit."""
    http = EOL.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % size, b"", b""])
    block = http + (payload or b"")
    head = ["WARC/1.1", "WARC-Type: " + ("response" if payload is not None else "revisit"), f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + plain_url(url))
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + EOL + EOL


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def http(self) -> dict[str, str]:
        return _fields(self.block.partition(EOL + EOL)[0])

    @property
    def payload(self) -> bytes:
        return self.block.partition(EOL + EOL)[2]


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse(data: bytes) -> Record:
    """A record from its uncompressed bytes; the lengths and the block digest must hold."""
    head, _, rest = data.partition(EOL + EOL)
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    headers = _fields(head)
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != EOL + EOL:
        raise ValueError("a WARC record's length is wrong")
    if headers.get("warc-block-digest", "").removeprefix("sha1:") not in ("", base32_sha1(block)):
        raise ValueError("a WARC block does not match its digest")
    return Record(headers, block)


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


# ------------------------------------------------------------------ ZIP directory

@dataclass
class Member:
    name: str
    method: int
    size: int
    stored: int
    at: int  # of the local header


ReadAt = Callable[[int, int], bytes]  # (offset, length)


def members(read: ReadAt, size: int) -> list[Member]:
    """The central directory of a ZIP or ZIP64 file of ``size`` bytes."""
    tail_at = max(0, size - 22 - 65535)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\5\6", 0, end)  # these four bytes may stand in the comment
    if end < 0:
        raise ValueError("not a ZIP file")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        sign, _, wide_at, _ = struct.unpack("<4sIQI", read(tail_at + end - 20, 20))
        if sign != b"PK\6\7":
            raise ValueError("the ZIP64 locator is missing")
        sign, _, _, _, _, _, _, count, length, start = struct.unpack("<4sQHHIIQQQQ", read(wide_at, 56))
        if sign != b"PK\6\6":
            raise ValueError("the ZIP64 directory is missing")
    directory, out, at = read(start, length), [], 0
    for _ in range(count):
        sign, flags, method, stored, full, n, extra, comment, local = struct.unpack_from("<4s4xHH8xIIHHH8xI", directory, at)
        if sign != b"PK\1\2":
            raise ValueError("the ZIP directory is damaged")
        name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        fields, pos = directory[at + 46 + n : at + 46 + n + extra], 0
        while pos + 4 <= len(fields):
            kind, width = struct.unpack_from("<HH", fields, pos)
            if kind == 1:  # holds, in this order, those values that do not fit
                wide = iter(struct.unpack_from(f"<{width // 8}Q", fields, pos + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                local = next(wide) if local == 0xFFFFFFFF else local
            pos += 4 + width
        out.append(Member(name, method, full, stored, local))
        at += 46 + n + extra + comment
    return out


def data_start(read: ReadAt, m: Member) -> int:
    """Where a stored member's bytes begin; the local header may have other extra fields than the directory."""
    if m.method != 0:
        raise ValueError(f"{m.name} is compressed, so it cannot be read by range")
    sign, n, extra = struct.unpack("<4s22xHH", read(m.at, 30))
    if sign != b"PK\3\4":
        raise ValueError("a local ZIP header is missing")
    return m.at + 30 + n + extra


# ------------------------------------------------------------------ writing

class _Sink:
    """A stream without seek or tell, as ``zipfile`` expects of one that can only be appended to."""

    def __init__(self, out):
        self.write, self.flush = out.write, lambda: None


class Package:
    """A package that is being written."""

    def __init__(self, store, path: str):
        self.path, self.count, self.at, self.lines = path, 0, 0, []
        self.out = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Sink(self.out), "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)

    def add(self, page_id, url, payload, digest, size, refers_to) -> None:
        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        data = pack.compress(record(page_id, url, payload, digest, size, refers_to)) + pack.flush()
        self.member.write(data)
        host, slash, path = re.sub(r"^[^:]*://", "", plain_url(url or "")).partition("/")
        fields = {"url": url, "mime": "text/html" if payload is not None else "warc/revisit", "status": "200", "digest": f"sha1:{digest}", "length": str(len(data)), "offset": str(self.at), "filename": RECORDS}
        self.lines.append(f"{','.join(reversed(host.split('.')))}){slash}{path} {re.sub(r'[^0-9]', '', DATE)} {json.dumps(fields)}\n")
        self.count += 1
        self.at += len(data)

    def close(self) -> tuple[str, int]:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.writelines(x.encode() for x in sorted(self.lines))
        self.zip.close()
        self.out.close()
        return self.path, self.count


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        package, done = None, []
        for b in batches:
            for page_id, url, payload, size, sha1, first in zip(*b.columns):
                if package is None:
                    store.create_dir(base, recursive=True)
                    package = Package(store, f"{base}/{uuid.uuid4().hex}.wacz")
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                package.add(page_id.as_py(), url.as_py(), payload.as_py(), digest, size.as_py(), first.as_py())
                if package.at > PACKAGE_BYTES or package.count >= PACKAGE_RECORDS:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        yield pa.RecordBatch.from_pydict({"package": pa.array([p for p, _ in done], pa.string()), "records": pa.array([n for _, n in done], pa.int64())})

    return run


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes packages of ``page_id, url, html`` under ``folder``; the manifest ``package, records``.

    Payloads are not shuffled unless the digests that occur twice are too many to broadcast.
    """
    text_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", utf8(F.col("html")).alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"))
    twice = rows.where(F.col("size") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    twice = cut_lineage(twice.select("sha1", "first"))
    again = (F.col("size") >= min_bytes) & F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    typed = with_small(rows, twice, ["sha1"], "left").withColumn("again", F.coalesce(again, F.lit(False)))
    typed = typed.select("page_id", "url", F.when(~F.col("again"), F.col("payload")).alias("payload"), "size", "sha1", F.when(F.col("again"), F.col("first")).alias("first"))
    return cut_lineage(typed.mapInArrow(_writer(folder), "package string, records long"))


# ------------------------------------------------------------------ reading

def _reader(store, path: str) -> tuple[ReadAt, int]:
    f = store.open_input_file(path)

    def read(at: int, length: int) -> bytes:
        f.seek(at)
        data = f.read(length)
        if len(data) != length:
            raise ValueError(f"{path} ends too early")
        return data

    return read, f.size()


def index_of(read: ReadAt, size: int) -> tuple[int, list[tuple[int, int]]]:
    """Where a package's records begin, and their offsets and lengths in order."""
    found = {m.name: m for m in members(read, size)}
    lines = read(data_start(read, found[INDEX]), found[INDEX].size).splitlines()
    fields = [json.loads(x.split(b" ", 2)[2]) for x in lines]
    return data_start(read, found[RECORDS]), sorted((int(x["offset"]), int(x["length"])) for x in fields)


def _indexed(folder: str):
    """Of packages, the blocks of neighbouring records: package, offset, the records' lengths."""
    kind = pa.schema([("package", pa.string()), ("at", pa.int64()), ("lengths", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                base, places = index_of(*_reader(store, path))
                blocks: list[tuple[int, list[int]]] = []
                for at, length in places:
                    if blocks and blocks[-1][0] + sum(blocks[-1][1]) == base + at and sum(blocks[-1][1]) + length <= BLOCK_BYTES:
                        blocks[-1][1].append(length)
                    else:
                        blocks.append((base + at, [length]))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(blocks)), pa.array([x for x, _ in blocks], pa.int64()), pa.array([y for _, y in blocks], pa.list_(pa.int64()))], schema=kind)

    return run


COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _read_blocks(folder: str, payloads: bool):
    names = [x.split()[0] for x in COLUMNS.split(", ")][: None if payloads else -1]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    kind = pa.schema(list(zip(names, kinds)))

    def row(r: Record) -> tuple:
        h = r.headers
        whole = h["warc-type"] == "response"
        digest = h["warc-payload-digest"].removeprefix("sha1:")
        size = int(r.http["content-length"])
        if whole and (len(r.payload) != size or base32_sha1(r.payload) != digest):
            raise ValueError("a payload does not match its header")
        return _page(h["warc-record-id"]), size, digest, h["warc-type"], _page(h.get("warc-refers-to")), h.get("warc-target-uri"), r.payload if whole else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for b in batches:
            for path, at, lengths in zip(*(c.to_pylist() for c in b.columns)):
                read, _ = _reader(store, path)
                data, pos, rows = memoryview(read(at, sum(lengths))), 0, []
                for n in lengths:
                    rows.append(row(parse(zlib.decompress(data[pos : pos + n], 31))))
                    pos += n
                cols = list(zip(*rows))[: len(names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(cols, kind)], schema=kind)

    return run


def read_packages(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the packages in ``manifest``: ``COLUMNS``, without ``payload`` unless asked for."""
    blocks = manifest.select("package").mapInArrow(_indexed(folder), "package string, at long, lengths array<long>")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = COLUMNS if payloads else COLUMNS.rpartition(", ")[0]
    return blocks.repartition(n).mapInArrow(_read_blocks(folder, payloads), schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record, read back from the packages: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_packages(table(spark, sf_dir, "pages"), folder)
    found = read_packages(manifest, folder, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The digest's 40 hex digits are cut into eights of 20 bits, and each into four base32 digits.
SQL = """
with p as (select page_id, coalesce(html, '') html from pages),
f as (select html, min(page_id) first from p group by 1),
d as (select p.page_id, octet_length(encode(p.html))::bigint size, sha1(p.html) h, first from p join f on f.html = p.html),
w as (select *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, i * 5 + 1, 5))::int) v from d)
select page_id, size payload_bytes, array_to_string(list_transform(v, lambda x:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), '') payload_digest,
  case when page_id = first or first is null then 'response' else 'revisit' end record_type,
  case when page_id is distinct from first then first end refers_to
from w
"""
