"""Archives: round trip of payloads, framing and digest faults, revisits, defined cases."""

import gzip
import io

import pytest
from framelens.llm import warc as W

KIND = "page_id long, url string, html string"


def test_payloads_come_back(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: (r.url, r.html) for r in pages.collect()}
    got = W.round_trip(pages).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.url == want[r.page_id][0]
        assert r.record_type == "revisit" or r.html == want[r.page_id][1]


def test_members_are_one_record_each():
    data = b"".join(W.record(i, f"http://x/{i}", b"p" * i * 1000, None, False) for i in range(4))
    found = list(W.records(io.BytesIO(data)))
    assert [len(p) for _, p, _ in found] == [0, 1000, 2000, 3000]
    with gzip.open(io.BytesIO(data)) as f:  # a plain gzip reader sees all members
        assert f.read().count(b"WARC/1.1") == 4
    assert [f["WARC-Record-ID"] for f, _, _ in W.records(io.BytesIO(data))] == [f"<urn:page:{i}>" for i in range(4)]


@pytest.mark.parametrize("fault", ["cut", "length", "digest"])
def test_faults_raise(fault):
    data = W.record(1, "http://x", b"hello", None, False)
    if fault == "cut":
        data = data[:-6]
    else:
        plain = gzip.decompress(data)
        data = gzip.compress(plain.replace(b"hello", b"hellO") if fault == "digest" else plain.replace(b"hello", b"hello!"))
    with pytest.raises((ValueError, EOFError)):
        list(W.records(io.BytesIO(data)))


def test_defined_cases(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (None, "u", "same"), (5, "u\r\nX: y", "ä\U0001F600\r\n\r\nz"), (6, "u", "q" * 500000), (6, "u", "q" * 500000)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS original", "'x' AS digest_")
    got = {}
    for r in W.round_trip(df).collect():
        got.setdefault(r.page_id, []).append((r.record_type, r.refers_to, r.payload_bytes))
    assert got[1] == [("response", None, 4)] and got[2] == [("revisit", 1, 4)] and got[None] == [("revisit", 1, 4)]
    assert got[3] == [("response", None, 0)] and got[4] == [("revisit", 3, 0)]
    assert got[6] == [("response", None, 500000)] * 2
    short = {r.page_id: r.record_type for r in W.round_trip(df, min_revisit_bytes=5).collect()}
    assert short[2] == "response" and short[4] == "response"
    assert W.round_trip(df.where("false")).count() == 0
