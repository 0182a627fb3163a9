import io
import zipfile

import pytest
from pyspark.sql import types as T

from rankweave.llm import warc


def over(raw):
    return (lambda at, n: raw[at : at + n]), len(raw)


def expected(rows, least=0):
    out = set()
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = max(same) if same and len(raw) >= least else page_id
        revisit = first != page_id
        out.add((page_id, len(raw), warc.payload_digest(raw), "revisit" if revisit else "response", first if revisit else None))
    return out


@pytest.mark.parametrize("least", [0, 4])
def test_pages(spark, least):
    rows = [(1, "http://a.b/c", "<p>x"), (2, None, "<p>x"), (3, "u v\n", None), (4, "http://[bad", ""), (5, "http://é.org/?q", "é🙂\r\n\r\nWARC/1.1"), (None, "n", "<p>x"), (7, "z", "long " * 200_000), (8, "s", "abc"), (9, "s", "abc")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int").repartition(3)
    assert set(map(tuple, warc.archive_pages(pages, least_bytes=least).collect())) == expected(rows, least)


def test_repeated_rows_and_only_null_ids(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (None, "u", "other"), (None, "u", "other")]
    got = sorted(map(str, map(tuple, warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())))
    assert len(got) == 4 and all("'response'" in r for r in got)


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], T.StructType.fromDDL("page_id long, url string, html string"))).count() == 0


def test_packages_roll_over(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"{k} " * 3000) for k in range(30)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_packages(pages, f"file://{tmp_path}", package=2000)
    assert manifest.count() > 3
    assert warc.read_packages(manifest, f"file://{tmp_path}").select("page_id").distinct().count() == 30


def test_sql_base32(spark):
    row = spark.sql("select unhex(sha1('abc')) as s").select(warc._base32(warc.F.col("s"))).head()
    assert row[0] == warc.payload_digest(b"abc")


def test_standard_tools_read_the_package():
    sink = io.BytesIO()
    out = warc.PackageWriter(sink)
    for k in range(5):
        out.add(f"http://x/{k}", warc.warc_record(k, f"http://x/{k}", b"body", warc.payload_digest(b"body"), None, False))
    out.close()
    with zipfile.ZipFile(io.BytesIO(sink.getvalue())) as z:
        assert z.testzip() is None and z.getinfo(warc.DATA).compress_type == zipfile.ZIP_STORED
    got = list(warc.records(*over(sink.getvalue())))
    assert [g[0]["warc-record-id"] for g in got] == [f"<urn:page:{k}>" for k in range(5)] and {g[2] for g in got} == {b"body"}


def test_zip64_directories(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        for k in range(4):
            z.writestr(zipfile.ZipInfo(f"m{k}"), f"member {k} " * 50)
        z.comment = b"PK\x05\x06 a misleading comment"
    raw = sink.getvalue()
    assert b"PK\x06\x06" in raw and b"PK\x06\x07" in raw
    directory = warc.ZipDirectory(*over(raw))
    for k in range(4):
        at = directory.start(f"m{k}")
        assert raw[at : at + directory.members[f"m{k}"].size].decode() == f"member {k} " * 50


def test_compressed_members_are_refused():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "x" * 1000)
    with pytest.raises(ValueError):
        warc.ZipDirectory(*over(sink.getvalue())).start("a")
    with pytest.raises(ValueError):
        warc.ZipDirectory(*over(b"not a zip"))
