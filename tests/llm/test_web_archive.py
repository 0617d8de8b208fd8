import gzip
import hashlib

import pytest

from corpusloom.llm import web_archive as W

V1 = b"filedesc://a.arc 0.0.0.0 20240102030405 text/plain 11\n1 0 test\nX\n\n"
BODY = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>\r\n\r\nWARC/1.0</p>"


def test_arc_versions():
    v1 = V1 + b"http://x/ 1.2.3.4 20240102030405 text/html %d\n" % len(BODY) + BODY + b"\n"
    got = list(W.parse_arc(v1))
    assert [r.version for r in got] == [1, 1] and got[1].block == BODY and got[1].fields["ip"] == "1.2.3.4"
    v2 = b"filedesc://a.arc 0.0.0.0 20240102030405 text/plain 9\n2 0 test\n\n" + b"http://x/ 1.2.3.4 2024 text/html 200 c - 12 a.arc %d\n" % len(BODY) + BODY + b"\n"
    got = list(W.parse_arc(v2))
    assert got[1].version == 2 and got[1].fields["status"] == "200" and got[1].block == BODY


@pytest.mark.parametrize("bad", [b"http://x/ 1.2.3.4 2024 text/html 99\nshort", b"http://x/ 1.2.3.4 2024 text/html\n", b"http://x/ 1.2.3.4 2024 text/html x1\n", b"no end"])
def test_arc_errors(bad):
    with pytest.raises(W.ArchiveError):
        list(W.parse_arc(bad))


def test_conversion_and_round_trip():
    arc = W.ArcRecord(1, {"url": "http://x/", "ip": "1.2.3.4", "date": "20240102030405", "mime": "text/html", "length": str(len(BODY))}, BODY)
    w = W.convert(arc)
    assert (w.headers["WARC-Type"], w.headers["WARC-Date"], w.headers["Content-Length"]) == ("response", "2024-01-02T03:04:05Z", str(len(BODY)))
    assert w.headers["WARC-Record-ID"] == W.convert(arc).headers["WARC-Record-ID"]
    v = W.as_revisit(w, "<urn:uuid:0>")
    data = w.to_bytes() + v.to_bytes()
    assert list(W.parse_warc(data)) == [w, v]
    assert W.unpacked(gzip.compress(data[:50]) + gzip.compress(data[50:])) == data
    assert W.convert(W.ArcRecord(1, arc.fields, b"plain")).headers["WARC-Type"] == "resource"


def test_odd_pages(spark):
    big, inner = "x" * 1200 + "é", "WARC/1.0\r\n\r\nx\n\r\n\r\n" * 200
    rows = [(1, "u", big), (2, "u 2\n", big), (5, None, big), (5, None, big), (3, "u", None), (4, "", ""), (None, "u", big), (9, "u", "short"), (10, "u", "short"), (11, "u", inner), (12, "q", inner)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.LegacyArchive().run(df).collect()), key=repr)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        last = max([j for j, _, h in rows if h == html and j is not None], default=None) if len(raw) >= 1000 and i is not None else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if last is not None and last != i else "response", last if last != i else None))
    assert got == sorted(want, key=repr)
    assert W.LegacyArchive().run(df.where("1 = 0")).count() == 0


def test_files_are_bounded_by_bytes(spark):
    rows = [(i, f"http://x/{i}\x01 \x7f", "<p>" + "y" * (40_000 if i % 10 == 0 else 500) + str(i % 30)) for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    from corpusloom.llm._store import Scratch

    scratch, archive = Scratch(spark, "test"), W.LegacyArchive(bytes_per_file=20_000)
    path = scratch.path("archives")
    archive.write(df, path, scratch)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).collect()
    assert len(files) > 6
    for f in files:
        records = list(W.parse_warc(W.unpacked(bytes(f.content))))
        assert len(records) == 1 or sum(len(r.to_bytes()) for r in records) <= 20_000 + len(records)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.payload_ok) for r in archive.read(spark, path, scratch).collect()}
    assert got == {i: (len(h), "response" if len(h) < 1000 or i == max(j for j, _, x in rows if x == h) else "revisit", True if len(h) < 1000 or i == max(j for j, _, x in rows if x == h) else None) for i, _, h in rows}
