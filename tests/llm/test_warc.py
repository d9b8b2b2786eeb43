import gzip
import hashlib

import pytest

from cdmspark.llm.common import new_folder
from cdmspark.llm.warc import coalesced, decide, op6_warc, parse, read_records, record, write_archives

BIG = "é" * 700
ROWS = [(1, "http://a/", BIG), (2, "http://b/ x\r\nWARC-Type: no", BIG), (3, None, "small"), (4, "u", "small"), (5, "u", None),
        (6, "u", ""), (None, "u", BIG), (8, "u", "x" * 3_000_000), (9, "u", "x" * 3_000_000), (9, "u", "x" * 3_000_000),
        (10, "u", "a\r\n\r\nWARC/1.1\r\n" * 100)]


def brute(rows):
    best = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000 and i is not None:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = h in best and i != best[h]
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", best[h] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    folder = new_folder(spark, "warc")
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")
    index = write_archives(decide(df), folder)
    got = read_records(index, folder).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS)
    assert sorted(str(r.url) for r in index.collect()) == sorted(str(u) for _, u, _ in ROWS)
    some = index.filter("page_id in (3, 10)")
    assert sorted(r.page_id for r in read_records(some, folder).collect()) == [3, 10]
    empty = write_archives(decide(df.limit(0)), folder)
    assert empty.count() == 0 and read_records(empty, folder).count() == 0


def test_one_member_is_a_record():
    raw = record(7, "http://x/ä b", b"<p>" * 500, hashlib.sha1(b"<p>" * 500).hexdigest(), None, False)
    text = gzip.decompress(raw)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"<p>\r\n\r\n")
    assert parse(raw)["payload_bytes"] == 1500
    with pytest.raises(Exception):
        parse(gzip.compress(text.replace(b"<p><p>", b"<q><p>", 1)))


def test_reads_are_joined_by_gap():
    assert coalesced([(0, 10), (100, 5), (10, 20), (10 ** 7, 3)]) == [
        (0, 105, [(0, 10), (10, 20), (100, 5)]), (10 ** 7, 3, [(10 ** 7, 3)])]


def test_revisits_of_a_page_id_that_repeats(spark, tmp_root):
    """Two pages 9 of other html: each revisit gets the figures of its own payload."""
    html = {"a": "a" * 1500, "b": "b" * 2500}
    rows = [(9, "u", html["a"]), (9, "u", html["b"]), (5, "u", html["a"]), (4, "u", html["b"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_root}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.refers_to) for r in op6_warc(spark, tmp_root).collect()
           if r.record_type == "revisit"}
    assert got == {i: (len(h), hashlib.sha1(h.encode()).hexdigest(), 9) for i, h in ((5, html["a"]), (4, html["b"]))}
