from __future__ import annotations

import base64
import hashlib
import random

import pytest

from coratia.llm import warc
from coratia.plans.lineage import fresh_path

SCHEMA = "page_id long, url string, html string, file string"


def pages() -> list[tuple]:
    rng = random.Random(3)
    bodies = ["<p>é</p>", "", "a\r\n\r\nWARC/1.1\r\n\r\nb", "x" * 3_000, "\n", *[f"page {k}" for k in range(20)]]
    hosts = ["http://www.b.example.org/", "https://a.example.org:80/x?y#z", "ftp://u@c/", "no url", "http://d", "http://é.x/a b"]
    return [(i, rng.choice(hosts), rng.choice(bodies), "f") for i in range(200, 0, -1)] + [(300, None, None, None)]


def test_records_and_order_by_definition(spark):
    rows = pages()
    got = warc.archive(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(r["page_id"] for r in got) == sorted(r[0] for r in rows)
    first: dict = {}
    for i, _, html, _ in sorted(rows, key=lambda r: r[0]):
        first.setdefault(html or "", i)
    by_id = {r[0]: r for r in rows}
    for r in got:
        html = by_id[r["page_id"]][2] or ""
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), digest)
        own = first[html] == r["page_id"]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if own else ("revisit", first[html]))
    ordered = sorted(got, key=lambda r: r["capture_no"])
    assert [r["capture_no"] for r in ordered] == list(range(len(rows)))
    keys = [(r["url_key"], r["captured_at"], r["page_id"]) for r in ordered]
    assert keys == sorted(keys)


def test_many_ranges_merge_to_one_order(spark):
    folder = fresh_path(spark, "archives")
    table = spark.createDataFrame([(i, "http://one.example/", f"p{i % 50}", "") for i in range(500)], SCHEMA)
    warc.write_archives(table.repartition(6), folder, archive_bytes=20_000)
    index = warc.merged_index(warc.read_archives(spark, folder), per_range=40).collect()
    assert [r["page_id"] for r in sorted(index, key=lambda r: r["capture_no"])] == list(range(500))
    assert len({r["file"] for r in index}) > 6


def test_offsets_lead_to_the_records(spark):
    folder = fresh_path(spark, "archives")
    warc.write_archives(spark.createDataFrame(pages(), SCHEMA), folder)
    found = warc.read_archives(spark, folder).filter("record_type = 'response'").limit(5).collect()
    paths = {r["path"].rsplit("/", 1)[-1]: r["content"] for r in spark.read.format("binaryFile").load(folder).collect()}
    for r in found:
        record = bytes(paths[r["file"]][r["offset"] : r["offset"] + r["length"]])
        assert record.startswith(b"WARC/1.1\r\n") and record.count(b"WARC-Type: response") == 1
        assert len(list(warc.parse(record + b"\r\n\r\n"))) == 1


def test_damage_is_noticed():
    def record(body: bytes, digest: str) -> bytes:
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1>\r\nWARC-Target-URI: u\r\nWARC-Date: d\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    good = base64.b32encode(hashlib.sha1(b"abc").digest()).decode()
    assert len(list(warc.parse(record(b"abc", good) * 2))) == 2
    for bad in (record(b"abd", good), record(b"abc", good)[:-2], b"junk" + record(b"abc", good)):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(rng.randint(0, 20) for _ in range(rng.choice([0, 1, 30]))) for _ in range(k)]
    merged = list(warc.LoserTree([iter(r) for r in runs]))
    assert [item for _, item in merged] == sorted(x for r in runs for x in r)
    assert merged == sorted(merged, key=lambda x: (x[1], x[0]))


def test_repeated_rows_and_missing_ids(spark):
    rows = [(4, "http://b/", "same", ""), (4, "http://b/", "same", ""), (4, "http://a/", "same", "")]
    rows += [(None, "http://c/", "same", ""), (9, "http://d/", "same", ""), (None, None, "other", ""), (None, None, "other", "")]
    got = warc.archive(spark.createDataFrame(rows, SCHEMA)).collect()
    told = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got)
    assert told == sorted(
        [("4", "response", "None"), ("4", "revisit", "4"), ("4", "revisit", "4"), ("9", "revisit", "4"), ("None", "revisit", "4")]
        + [("None", "response", "None"), ("None", "revisit", "None")]
    )
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0
