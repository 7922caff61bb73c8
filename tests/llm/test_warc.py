import base64
import hashlib
import re
from collections import Counter

import pytest

from credence.llm import warc
from credence.llm.common import new_folder

from .helpers import clashing

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://a.org/1", "<p>one</p>"), (2, "http://a.org/2", "<p>two é😀</p>"), (3, "http://b.org/3", "<p>one</p>"),
    (4, None, "<p>one</p>"), (5, "http://b.org/x\r\nWARC-Type: forged", None), (6, "http://b.org/6", ""), (7, "u", "y" * 300_000),
    (8, "http://a.org/8", "\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n"), (None, "http://n.org", "<p>one</p>"), (None, "http://n.org", "alone"),
]


def expected(rows, least=0):
    largest = {}
    for page_id, _, html in rows:
        if page_id is not None:
            largest[html or ""] = max(largest.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = largest.get(html or "")
        revisit = len(payload) >= least and page_id != first
        out.append((page_id, len(payload), digest, "revisit" if revisit else "response", first if revisit else None))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 5, 11])
def test_digests_and_revisits(spark, least):
    got = warc.archived(clashing(spark.createDataFrame(ROWS, PAGES), "sha256", "payload", "revisit"), least)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == expected(ROWS, least)


def test_records_round_trip(spark):
    path = new_folder(spark, "test-warc")
    warc.archive(spark.createDataFrame(ROWS, PAGES), path)
    html = {r[0]: (r[2] or "").encode() for r in ROWS if r[0] is not None}
    seen = 0
    for r in warc.rebuilt_records(spark, path).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        assert int(fields["Content-Length"]) == len(body) - 4
        http, _, payload = body[:-4].partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK")
        if r.page_id is not None:
            assert bytes(r.payload) == html[r.page_id]
            assert payload == (html[r.page_id] if fields["WARC-Type"] == "response" else b"")
            assert int(re.search(rb"Content-Length: (\d+)", http).group(1)) == len(html[r.page_id])
            seen += 1
    assert seen == 8
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in ROWS})


def test_changed_bytes_are_noticed(spark):
    path = new_folder(spark, "test-warc")
    warc.archive(spark.createDataFrame(ROWS[:3], PAGES), path)
    spark.read.parquet(f"{path}/payloads").selectExpr("sha256", "CAST('forged' AS binary) AS payload").write.parquet(f"{path}-2/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}-2/records")
    with pytest.raises(Exception, match="does not have the digest"):
        warc.read_archive(spark, f"{path}-2").collect()


def test_equal_rows_and_no_rows(spark):
    rows = [(1, "u", "same")] * 3 + [(0, "v", "same")]
    got = warc.archived(spark.createDataFrame(rows, PAGES)).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter({(1, "response", None): 3, (0, "revisit", 1): 1})
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0


def test_one_payload_in_a_third_of_the_rows(spark):
    rows = [(k, f"u{k}", "hot" if k % 3 == 0 else f"page {k}") for k in range(600)]
    got = warc.archived(spark.createDataFrame(rows, PAGES).repartition(9)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(rows)
