import io
import struct
import zipfile

import pytest

from seclog.llm.queries import queries
from seclog.llm.warc import base32_sha1, data_start, index_of, members, parse, read_packages, record, write_packages


def reader(data):
    return lambda at, n: data[at : at + n]


def archive(comment=b"", wide=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open("a/b.txt", "w", force_zip64=wide) as f:
            f.write(b"hello")
        z.writestr("ü.txt", b"x" * 100)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("comment", [b"", b"note PK\5\6 in here", b"c" * 65535])
def test_directory(comment):
    data = archive(comment, wide=True)
    found = {m.name: m for m in members(reader(data), len(data))}
    at = data_start(reader(data), found["a/b.txt"])
    assert data[at : at + found["a/b.txt"].size] == b"hello" and found["ü.txt"].size == 100


def test_zip64_directory():
    """The 16- and 32-bit fields hold all ones, so the values stand in the ZIP64 records."""
    body, name = b"payload", b"m"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<HHQQ", 1, 16, 7, 7)
    extra = struct.pack("<HHB", 0x9999, 1, 0) + struct.pack("<HHQQQ", 1, 24, 7, 7, 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    start = len(local) + len(body)
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), start)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, start + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = local + body + central + wide + locator + end
    (m,) = members(reader(data), len(data))
    at = data_start(reader(data), m)
    assert (m.name, m.size, data[at : at + m.size]) == ("m", 7, body)


def test_damage_is_noticed():
    data = archive()
    with pytest.raises(ValueError):
        members(reader(data[:-30]), len(data) - 30)
    with pytest.raises(ValueError):
        parse(record(1, "http://a/", b"abc", base32_sha1(b"abc"), 3, None).replace(b"abc", b"abd"))


def test_records():
    r = parse(record(7, "http://a/b c\n", "é".encode(), base32_sha1("é".encode()), 2, None))
    assert r.headers["warc-target-uri"] == "http://a/b%20c%0A" and r.payload == "é".encode()
    r = parse(record(8, None, None, "D", 5, 7))
    assert r.headers["warc-type"] == "revisit" and r.headers["warc-refers-to"] == "<urn:page:7>" and r.http["content-length"] == "5" and r.payload == b""


def test_round_trip_and_range_reads(spark, tmp_path):
    rows = [(i, f"http://h{i}.org/", f"page {i % 6} " * (i % 6 * 50)) for i in range(40)] + [(50, None, None), (51, "http://x/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for least in (0, 100):
        folder = f"file://{tmp_path}/p{least}"
        manifest = write_packages(pages, folder, least)
        out = {r.page_id: r for r in read_packages(manifest, folder).collect()}
        first = {}
        for i, url, html in rows:
            data = (html or "").encode()
            head = first.setdefault(data, i)
            again = head != i and len(data) >= least
            assert (out[i].record_type, out[i].refers_to) == (("revisit", head) if again else ("response", None))
            assert (out[i].payload_bytes, out[i].payload_digest, out[i].url) == (len(data), base32_sha1(data), url)
            assert out[i].payload == (None if again else data)
        for r in manifest.collect():
            data = open(r.package, "rb").read()
            base, places = index_of(reader(data), len(data))
            assert len(places) == r.records and zipfile.ZipFile(r.package).testzip() is None


def test_query(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = queries()["op2_warc"](spark, sf).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in out} == {(i, len(d), base32_sha1(d)) for i, d in pages.items()}
