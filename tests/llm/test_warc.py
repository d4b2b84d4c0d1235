import base64
import gzip
import hashlib

import pyarrow.fs as pafs

from rillstone.llm import warc
from rillstone.storage import shared_dir

PAGES = [
    (5, "http://a/x?q=1 2", "<p>same</p>"),
    (3, "http://b/", "<p>same</p>"),
    (9, None, None),
    (8, "http://c/\r\nX: y", ""),
    (1, "http://d/", "<p>\r\n\r\nöther</p>" * 2000),
    (3, "http://b/again", "<p>same</p>"),
    (None, "http://e/", "<p>same</p>"),
    (None, None, "lonely"),
]
SCHEMA = "page_id long, url string, html string, payload string, offset long, revisit boolean"


def table(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", 1, True) for r in rows], SCHEMA).repartition(3)


def brute(rows, least_bytes=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        least = min(same, default=None)
        revisit = len(data) >= least_bytes and least is not None and i != least and sum((h or "") == (html or "") for _, _, h in rows) > 1
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", least if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = warc.round_trip(table(spark)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(PAGES)
    long = warc.round_trip(table(spark), min_bytes=100).collect()
    assert sorted((tuple(r) for r in long), key=str) == brute(PAGES, 100)
    assert warc.round_trip(table(spark, [])).collect() == []


def test_index_points_at_members(spark):
    folder = shared_dir(spark)
    index = warc.write_archives(table(spark), folder)
    files, root = pafs.FileSystem.from_uri(folder)
    for r in index.collect():
        with files.open_input_file(f"{root}/{r.archive}") as f:
            member = f.read_at(r.length, r.offset)
        assert gzip.decompress(member).startswith(b"WARC/1.1\r\n")
        assert warc.parse_record(member)["page_id"] == r.page_id
    chosen = warc.read_records(index.where("page_id = 1"), folder).collect()
    assert [bytes(r.payload).decode() for r in chosen] == [PAGES[4][2]]


URLS = ["http://c/\r\nX: y", "http://a/x?q=1 2", "http://a/%41%20b", " http://a/ ", "http://ü/ñ?☃", "", "http://a/\u2028x", 'say "hi"', None, "http://a/\x85"]


def test_record_headers():
    member = warc.format_record(7, "http://c/\r\nX: y", b"hi", 3, True)
    record = warc.parse_record(member)
    assert record["refers_to"] == 3 and record["payload"] is None and record["payload_bytes"] == 2 and record["url"] == "http://c/\r\nX: y"
    assert not any(line.startswith(b"X: y") for line in gzip.decompress(member).split(b"\r\n"))
    assert b"WARC-Target-URI: http://a/%41%20b\r\n" in gzip.decompress(warc.format_record(1, "http://a/%41%20b", b""))


def test_urls_come_back_and_references_resolve(spark):
    pages = [(*r, "x", 1, True) for r in [*PAGES, *((100 + i, u, f"page {i % 4}") for i, u in enumerate(URLS))]]
    folder = shared_dir(spark)
    got = warc.read_records(warc.write_archives(spark.createDataFrame(pages, SCHEMA).repartition(3), folder), folder).collect()
    assert sorted(((r.page_id, r.url) for r in got), key=str) == sorted(((p[0], p[1]) for p in pages), key=str)
    responses = {r.record_id: r for r in got if r.record_type == "response"}
    for r in got:
        assert (r.refers_to_id in responses and responses[r.refers_to_id].page_id == r.refers_to and responses[r.refers_to_id].payload_digest == r.payload_digest) if r.record_type == "revisit" else r.refers_to_id is None
    names = {(r.record_id, r.page_id, r.payload_digest) for r in got}
    assert len({n for n, *_ in names}) == len(names)


def test_reads_are_dealt_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 200)
    folder = shared_dir(spark)
    index = warc.write_archives(table(spark), folder)
    assert warc.read_records(index, folder).rdd.getNumPartitions() > 4
    assert sorted(((r.page_id, r.payload_bytes) for r in warc.read_records(index, folder).collect()), key=str) == sorted(((i, len((h or "").encode())) for i, _, h in PAGES), key=str)
