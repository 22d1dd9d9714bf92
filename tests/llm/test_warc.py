"""Archives against a plain model, and foreign archives."""

import gzip
import hashlib

from unitlife.llm import warc

SCHEMA = "page_id long, url string, html string, record string, digest string"


def pages():
    big, other = "é" * 600, "x" * 999
    rows = [(1, "u1", big), (7, "u7", big), (3, None, big), (4, "u4", other), (5, "u5", other), (6, "u6", None), (8, "u8", ""),
            (9, "u\r\n9", "WARC/1.1\r\n\r\n\r\n" + big), (10, "a%20b", "WARC/1.1\r\n\r\n\r\n" + big), (11, "u", big + "\x00"),
            (None, "n", big), (7, "u7", big), (12, "z", "y" * 1000), (12, "z", "y" * 1000)]
    return [(*r, "r", "d") for r in rows]


def expected(rows):
    out = []
    body = lambda r: (r[2] or "").encode()
    for r in rows:
        ids = [x[0] for x in rows if body(x) == body(r) and x[0] is not None]
        kept = max(ids, default=None)
        again = len(body(r)) >= 1000 and r[0] != kept
        out.append((str(r[0]), len(body(r)), hashlib.sha1(body(r)).hexdigest(), "revisit" if again else "response",
                    kept if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = pages()
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a"), date="2020-01-01T00:00:00Z")
    read = warc.resolved(warc.read_archives(spark, str(tmp_path / "a")))
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read.collect()]
    assert sorted(got, key=str) == expected(rows)
    texts = {(r.page_id, bytes(r.payload).decode()) for r in read.collect()}
    assert texts == {(r[0], r[2] or "") for r in rows}
    urls = {r.page_id: r.url for r in read.collect()}
    assert urls[3] is None and urls[9] == "u%0D%0A9" and urls[10] == "a%20b"


def test_empty(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "a"))
    assert warc.read_archives(spark, str(tmp_path / "a"), payloads=False).count() == 0


def test_reads_archives_of_one_member_per_record(spark, tmp_path):
    record = (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 24\r\n\r\n"
              b"HTTP/1.0 200 OK\r\n\r\nhello\r\n\r\n")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "w.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    rows = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert [bytes(r.payload) for r in rows] == [b"hello"] * 2 and rows[0].page_id is None
