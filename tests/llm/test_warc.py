import base64
import gzip
import hashlib

import pytest

from quantloom.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [
    (1, "https://a.example/x y\r\nz", "<p>é</p>\r\n\r\nWARC/1.1\r\n\r\n"),
    (2, None, None),
    (3, "https://b.example/", ""),
    (9, "u", "<p>same</p>"),
    (4, "u4", "<p>same</p>"),
    (9, "u", "<p>same</p>"),
    (5, "v", "x" * 3_000_000),
    (None, "w", "<p>same</p>"),
    (None, "w", "alone"),
    (20, "e", "\r\n"),
    (21, "e", "\r\nx\r\n\r\n\r\n"),
    (22, "e", "\n\r\n\r\n\r\r\n\r"),
]
SCHEMA = "page_id long, url string, html string, payload int, original string"


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "o") for r in rows], SCHEMA)


@pytest.mark.parametrize("min_bytes", [0, 1, 12])
def test_round_trip(spark, tmp_path, min_bytes):
    out = warc.archive(pages(spark), str(tmp_path / "a"), min_bytes).collect()
    last = {}
    for page_id, _, html in ROWS:
        if page_id is not None and len((html or "").encode()) >= min_bytes:
            last[html or ""] = max(page_id, last.get(html or "", page_id))
    want = []
    for page_id, url, html in ROWS:
        html = html or ""
        original = last.get(html)
        other = original is not None and original != page_id
        url = url and "".join(url.split())
        want.append((page_id, url, len(html.encode()), digest(html), "revisit" if other else "response", original if other else None, None if other else html.encode()))
    assert sorted(map(tuple, out), key=repr) == sorted(((*x[:6], x[6] if x[6] is None else bytearray(x[6])) for x in want), key=repr)


def test_empty_table(spark, tmp_path):
    assert warc.archive(pages(spark, []), str(tmp_path / "b")).count() == 0


def test_files_are_gzip_of_records(spark, tmp_path):
    warc.archive(pages(spark), str(tmp_path / "c"))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "c").glob("*.gz")))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")
    one = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [b for _, b in warc.parse(bytes([x]) for x in one * 3)] == [b"hi"] * 3
    with pytest.raises(ValueError):
        list(warc.parse([one[:-5]]))


def test_many_digests_are_not_sent_about(spark):
    rows = [(i, "u", f"page {i // 2}") for i in range(60)]
    few = warc.resolve(warc.headers(pages(spark, rows)))
    many = warc.resolve(warc.headers(pages(spark, rows)), broadcast_digests=5)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()


def test_large_pages_are_streamed(spark, tmp_path):
    rows = [(i, "u", f"{i}\r\n\r\n" + "<p>large</p>\r\n" * 300_000) for i in range(12)]
    out = warc.archive(pages(spark, rows).coalesce(1), str(tmp_path / "d"), payloads=False).collect()
    assert sorted((r.page_id, r.payload_digest) for r in out) == [(i, digest(h)) for i, _, h in rows]
