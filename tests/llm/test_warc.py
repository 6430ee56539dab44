import gzip
import hashlib
import io
import random

import pytest

from cadenza.llm import warc as W


def pages(spark, rows):
    return spark.createDataFrame(
        rows, "page_id bigint, url string, html string")


def test_round_trip_with_revisits(spark, scratch):
    big, other = "<p>é</p>" * 200, "x" * 1000
    rows = [(1, "http://a/", big), (2, None, big), (9, "http://b/\r\nx", big),
            (3, "u", "small"), (4, "u", "small"), (5, "u", None),
            (6, "u", ""), (7, "u", other), (8, "u", other[:-1]),
            (9, "http://b/", big), (None, "u", big),
            (10, "u", "\r\n\r\n" * 3), (11, "u", "z" * 700_000)]
    records = W.plan_records(scratch, pages(spark, rows).repartition(3))
    listed = W.write_archives(scratch, records)
    got = W.read_archives(listed).collect()
    assert len(got) == len(rows) and all(r["verified"] for r in got)
    full = {}
    for page_id, _, html in rows:
        if len((html or "").encode()) >= 1000 and page_id is not None:
            full[html] = max(full.get(html, page_id), page_id)
    want = sorted(str((p, len((h or "").encode()),
                       hashlib.sha1((h or "").encode()).hexdigest(),
                       full.get(h) if full.get(h, p) != p else None))
                  for p, _, h in rows)
    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"],
                       r["refers_to"])) for r in got) == want
    by_digest = {hashlib.sha1((h or "").encode()).hexdigest():
                 (h or "").encode() for _, _, h in rows}
    for r in got:
        assert (r["record_type"] == "revisit") == (r["refers_to"] is not None)
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == by_digest[r["payload_digest"]]
        else:
            assert r["payload"] is None


def test_archives_are_gzip_members(spark, scratch):
    rows = [(i, "http://h/", f"page {i}") for i in range(50)]
    listed = W.write_archives(scratch, W.plan_records(
        scratch, pages(spark, rows).coalesce(1))).collect()
    assert [r["records"] for r in listed] == [50]
    path = listed[0]["path"].removeprefix("file://")
    plain = gzip.open(path).read()
    assert plain.count(b"WARC/1.1\r\n") == 50


@pytest.mark.parametrize("size", [1, 7, 100, 10 ** 6])
def test_members_come_whole_from_any_chunks(monkeypatch, size):
    monkeypatch.setattr(W, "READ_BYTES", size)
    rng = random.Random(size)
    parts = [bytes(rng.randrange(256) for _ in range(rng.randrange(300)))
             for _ in range(9)]
    stream = io.BytesIO(b"".join(map(W.gzip_member, parts)))
    assert list(W.members(stream)) == parts


def test_faults_are_seen():
    digest = hashlib.sha1(b"body").hexdigest()
    good = W.record(1, "u", "body", digest, 4, None)
    assert W.parse(good)["verified"]
    assert not W.parse(good.replace(b"body", b"bodx"))["verified"]
    with pytest.raises(ValueError):
        W.parse(good[:-3])
    with pytest.raises(ValueError):
        list(W.members(io.BytesIO(W.gzip_member(good)[:-4])))


def test_empty_table(spark, scratch):
    listed = W.write_archives(scratch, W.plan_records(
        scratch, pages(spark, []).limit(0)))
    assert W.read_archives(listed).count() == 0
