import hashlib
import io
import zipfile

import pytest
from llm_data import rows_of

from seqloom.llm import op7_warc as op
from seqloom.llm import ziparchive

BIG = "<p>" + "x" * 1200 + "</p>"
#: page_id, url, html
PAGES = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://a/é b", "<p>small</p>"), (5, "http://a/5", "<p>small</p>"), (6, "http://a/6", None), (7, "http://a/7", ""),
    (8, "http://a/8", "é" * 500), (9, "http://a/9", "é" * 500), (10, "http://a/10", "y\r\n\r\n" * 5000), (11, "u", "é" * 499), (12, "u", "é" * 499), (-5, "u", BIG), (None, "u", BIG), (None, "u", "z" * 2000), (None, "u", "z" * 2000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, digest string, payload string").repartition(3)


def brute(rows):
    largest = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and i is not None:
            largest[raw] = max(largest.get(raw, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        refers = largest.get(raw)
        refers = None if refers == i else refers
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


@pytest.mark.parametrize("zip64", [False, True])
def test_pages_come_back(spark, zip64):
    archives = op.write_archives(pages(spark), archive_bytes=4000, zip64=zip64)
    assert archives.count() > 3
    got = op.read_archives(archives, payload=True)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows_of(got, *columns) == brute(PAGES)
    htmls = {i: h for i, _, h in PAGES}
    for r in got.collect():
        if r["record_type"] == "response" and r["page_id"] is not None:
            assert bytes(r["payload"]).decode() == (htmls[r["page_id"]] or "")
        assert (r["payload"] is None) == (r["record_type"] == "revisit")


def test_originals_by_a_shuffle_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_ROWS", 0)
    got = op.read_archives(op.write_archives(pages(spark)))
    assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute(PAGES)


def test_no_pages(spark):
    empty = pages(spark).filter("false")
    assert op.read_archives(op.write_archives(empty)).count() == 0


def test_archives_are_zip_files_to_others(spark):
    for r in op.write_archives(pages(spark)).collect():
        z = zipfile.ZipFile(io.BytesIO(r["archive"]))
        assert z.testzip() is None
        assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
        assert {op.DATA, op.INDEX} <= set(z.namelist())


def test_reads_archives_of_others_by_ranges():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.writestr("first", b"12345")
        with z.open("wide", "w", force_zip64=True) as f:
            f.write(b"abcdef" * 100)
        z.writestr("packed", b"q" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\5\6 in it"
    data, asked = raw.getvalue(), []

    def read_at(at, n):
        asked.append(n)
        return data[at : at + n]

    a = ziparchive.Archive(read_at, len(data))
    assert list(a.members) == ["first", "wide", "packed"]
    asked.clear()
    assert a.read("wide", 6, 12) == b"abcdefabcdef" and sum(asked) <= 42
    assert a.read("first") == b"12345" and a.read("first", 3, 99) == b"45" and a.read("first", 9) == b""
    with pytest.raises(ValueError, match="compressed"):
        a.place("packed")
    with pytest.raises(ValueError, match="end"):
        ziparchive.of_bytes(b"no archive")


def test_a_changed_payload_is_noticed():
    raw = op.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert op.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        op.parse(raw.replace(b"payload\r\n\r\n", b"pavload\r\n\r\n"))
    for i in (0, 1, 1 << 62, -1, -(1 << 63), None):
        assert op.page_of(op.record_id(i)) == i


def test_archives_in_files_are_read_by_ranges(spark, tmp_path):
    many = [(i, "http://a", f"{i} " * 900) for i in range(700)]
    raw = op.write_archives(pages(spark, many).coalesce(1), archive_bytes=1 << 20).collect()
    for i, r in enumerate(raw):
        (tmp_path / f"{i}.wacz").write_bytes(r["archive"])
    files = spark.createDataFrame([((tmp_path / f"{i}.wacz").as_uri(),) for i in range(len(raw))] + [(None,)], "path string")
    got = op.read_files(files, payload=True)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows_of(got, *columns) == brute(many)
    a = ziparchive.of_uri((tmp_path / "0.wacz").as_uri())
    start, size = a.place(op.DATA)
    assert a.read_at(start, 2) == b"\x1f\x8b" and a.read_at(a.size - 1, 99) == a.read_at(a.size - 1, 1) and size < a.size


def test_nulls_in_a_column_of_archives(spark):
    none = spark.createDataFrame([(None,)], "archive binary")
    assert op.read_archives(none).count() == 0
