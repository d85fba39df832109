import gzip
import hashlib

import pytest

from netquant.llm import archives, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, id string, type string, digest string"

V1 = (
    b"filedesc://old.arc 0.0.0.0 19961022100000 text/plain 76\n1 0 Someone\nURL IP-address Archive-date Content-type Archive-length\n\n"
    b"\nhttp://a.example/x y 10.0.0.1 19961022 text/html; charset=x 21\nHTTP/1.0 200 OK\r\n\r\nab\n"
    b"\ndns:a.example 10.0.0.2 19961022100102 text/dns 6\na.\n\nIN\n"
)
V2 = (
    b"filedesc://new.arc 0.0.0.0 20010101000000 text/plain 120\n2 0 Someone\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n"
    b"http://b.example/ 10.0.0.1 20010101000001 text/html 200 - - 177 new.arc 19\nHTTP/1.1 200 OK\r\n\r\n\n"
)


def test_versions_are_parsed_by_their_lines():
    body = V1[V1.index(b"\n") + 1 :]
    declared = len(b"1 0 Someone\nURL IP-address Archive-date Content-type Archive-length\n\n")
    one = list(archives.parse_arc(V1.replace(b"plain 76", b"plain %d" % declared), "f"))
    assert body and [r.block for r in one[1:]] == [b"HTTP/1.0 200 OK\r\n\r\nab", b"a.\n\nIN"]
    assert (one[1].url, one[1].content_type, one[1].archive) == (b"http://a.example/x y", b"text/html; charset=x", "old.arc")
    assert [archives.warc_type(r) for r in one] == ["warcinfo", "response", "resource"]
    head = V2.index(b"\n") + 1
    block = V2[head : V2.index(b"http://b")]
    two = V2.replace(b"plain 120", b"plain %d" % len(block))
    for data in (two, gzip.compress(two), gzip.compress(two[:200]) + gzip.compress(two[200:])):
        found = list(archives.parse_arc(data, "g"))
        assert [(r.url, r.block) for r in found[1:]] == [(b"http://b.example/", b"HTTP/1.1 200 OK\r\n\r\n")]
        assert two[found[1].offset :].startswith(b"http://b")


@pytest.mark.parametrize("broken", [b"http://a 1.1.1.1 2001 text/html\n", b"http://a 1.1.1.1 20010101000000 text/html 99\nabc\n", b"filedesc://x 0.0.0.0 20010101000000 text/plain 4\n9 0\n\n"])
def test_other_forms_are_errors(broken):
    with pytest.raises(ValueError):
        list(archives.parse_arc(broken, "f"))


def test_dates_and_identifiers():
    assert archives.iso_date(b"1996") == "1996-01-01T00:00:00Z"
    assert archives.iso_date(b"199610221003") == "1996-10-22T10:03:00Z"
    assert archives.iso_date(b"19961022100305123") == "1996-10-22T10:03:05Z"
    assert archives.iso_date(b"19961399000000") == "1970-01-01T00:00:00Z"
    assert archives.record_id("a", 5) == archives.record_id("a", 5) != archives.record_id("a", 6)


def test_equivalent_warc_record():
    record = archives.ArcRecord("old.arc", 90, "http://a.example/é".encode(), b"10.0.0.1", b"19961022100000", b"text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\npay\r\n\r\nload")
    for refers in (None, ("<urn:uuid:1>", "http://z/", "1996-01-01T00:00:00Z")):
        (back,) = archives.parse_warc(archives.as_warc(record, refers) + archives.GAP)
        h = back.headers
        assert (h["WARC-Type"], h["WARC-Date"], h["WARC-Target-URI"]) == ("revisit" if refers else "response", "1996-10-22T10:00:00Z", "http://a.example/é")
        assert h["WARC-Payload-Digest"] == archives.digest(b"pay\r\n\r\nload") and h["WARC-Block-Digest"] == archives.digest(back.block)
        assert back.block == (b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n" if refers else record.block)
        assert h.get("WARC-Refers-To") == (refers[0] if refers else None)


def brute(rows):
    out = []
    for k, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data]
        rank = lambda p: -(1 << 70) if p is None else p
        best = max(same, key=rank)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), len(data) >= 1000 and rank(page) < rank(best), best))
    return out


def check(found, rows):
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=repr)
    want = sorted(((p, n, d, "revisit" if again else "response", best if again else None) for p, n, d, again, best in brute(rows)), key=repr)
    assert got == want


@pytest.mark.parametrize("archive_bytes", [64_000_000, 5_000])
def test_round_trip(spark, archive_bytes):
    long = "WARC/1.0\r\n\r\nhttp://x 0.0.0.0 20000101000000 text/html 12\nfiledesc://é漢😀\x00 " * 20
    rows = [(1, "http://a/ b\n", "x"), (2, None, None), (3, "http://a/", ""), (4, "", "x"), (None, "http://n/", long), (-5, "http://m/", long), (70, "http://é/", long)]
    rows += [(100 + i, f"http://h/{i}", "y" * 1000) for i in range(60)] + [(200 + i, f"http://h/{i}", "z" * 999) for i in range(5)] + [(300, "u", "é" * 500), (301, "u", "é" * 500)]
    df = spark.createDataFrame([(*r, "i", "t", "d") for r in rows], SCHEMA).repartition(3)
    check(archives.archived_pages(df, archive_bytes=archive_bytes).collect(), rows)


def test_repeated_rows_keep_one_response(spark):
    rows = [(9, "http://a/", "q" * 2000)] * 4 + [(3, "http://a/", "q" * 2000)]
    df = spark.createDataFrame([(*r, "i", "t", "d") for r in rows], SCHEMA)
    found = archives.archived_pages(df).collect()
    assert len(found) == 5 and [r["record_type"] for r in found].count("response") == 1
    assert {r["refers_to"] for r in found if r["record_type"] == "revisit"} == {9}
    assert archives.archived_pages(df.limit(0)).collect() == []


def test_op13_on_the_table(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    check(queries.op13(spark, SF).collect(), rows)
