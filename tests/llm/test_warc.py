"""WARC archives: round trips, revisits against brute force, archives of lost attempts."""

import base64
import gzip
import hashlib
import io
from collections import defaultdict

import pytest

from paypulse.llm import shared, warc

CLASHES = "record_id archive position payload first n last digest original".split()


def make_pages(spark, rows):
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *CLASHES) for r in rows], f"page_id long, url string, html string, {extra}")


def brute_force(rows, min_bytes=0):
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[html or ""].append(page_id)
    out = []
    for text, ids in groups.items():
        data = text.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        ids.sort(key=lambda i: (i is None, i or 0))
        for k, page_id in enumerate(ids):
            again = k > 0 and len(data) >= min_bytes
            out.append((page_id, len(data), digest, "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=repr)


def run(spark, folder, rows, min_bytes=0, archive_bytes=warc.ARCHIVE_BYTES):
    warc.write_archives(make_pages(spark, rows), f"{folder}/crawl", archive_bytes=archive_bytes)
    warc.deduplicate(spark, f"{folder}/crawl", f"{folder}/out", min_bytes, archive_bytes)
    found = warc.resolve(warc.read_records(spark, f"{folder}/out", payloads=False))
    return sorted((tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


ROWS = [
    (5, "http://a/1", "<p>same</p>"), (3, "http://a/2", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://b", "other\r\n\r\nWARC/1.1\r\n"),
    (2, "http://c\r\nX-Page-ID: 77", "other\r\n\r\nWARC/1.1\r\n"), (4, "u", None), (6, "u", ""), (None, "u", ""), (None, "v", "only null ids"),
    (None, "w", "only null ids"), (7, "x", "ä ö 你好"), (7, "x", "ä ö 你好"), (8, "y", "long " * 400_000), (10, "z", "long " * 400_000),
] + [(100 + k, f"http://hot/{k}", "hot page") for k in range(300)]


@pytest.mark.parametrize(("min_bytes", "archive_bytes", "heavy"), [(0, 2000, 1000), (5, 1 << 20, 3)])
def test_revisits_against_brute_force(spark, tmp_path, monkeypatch, min_bytes, archive_bytes, heavy):
    monkeypatch.setattr(shared, "HEAVY_KEYS", heavy)
    assert run(spark, str(tmp_path), ROWS, min_bytes, archive_bytes) == brute_force(ROWS, min_bytes)


def test_archives_are_warc(spark, tmp_path):
    warc.write_archives(make_pages(spark, ROWS).coalesce(1), f"{tmp_path}/crawl", date="2024-01-01T00:00:00Z")
    before = warc.read_records(spark, f"{tmp_path}/crawl")
    assert sorted(((r.page_id, bytes(r.payload).decode()) for r in before.collect()), key=repr) == sorted(((i, t or "") for i, _, t in ROWS), key=repr)
    warc.deduplicate(spark, f"{tmp_path}/crawl", f"{tmp_path}/out")
    manifest = warc.read_manifest(spark, f"{tmp_path}/out").collect()
    assert sum(r.records for r in manifest) == len(ROWS)
    unpacked = 0
    for row in manifest:
        raw = open(row.archive.removeprefix("file:"), "rb").read()
        whole = gzip.decompress(raw)
        assert len(raw) == row.bytes and whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n")
        for record in warc.decode_records(io.BytesIO(raw)):
            unpacked += len(record.block)
            assert record.block.startswith(b"HTTP/1.1 200 OK\r\n")
            if record.fields["WARC-Type"] == "revisit":
                assert not record.payload() and record.fields["WARC-Profile"] == warc.PROFILE
                assert record.fields["WARC-Refers-To"] and record.fields["WARC-Refers-To-Date"] == "2024-01-01T00:00:00Z"
    assert unpacked < 2_100_000  # one of the two long pages
    urls = {r.page_id: r.url for r in before.collect()}
    assert urls[2] == "http://c X-Page-ID: 77" and urls[9] is None


def test_deduplicating_again_changes_nothing(spark, tmp_path):
    first = run(spark, str(tmp_path), ROWS)
    warc.deduplicate(spark, f"{tmp_path}/out", f"{tmp_path}/again")
    again = warc.resolve(warc.read_records(spark, f"{tmp_path}/again")).drop("url")
    assert sorted((tuple(r) for r in again.collect()), key=repr) == first


def test_files_outside_the_manifest_are_not_read(spark, tmp_path):
    warc.write_archives(make_pages(spark, ROWS[:4]), f"{tmp_path}/crawl")
    (tmp_path / "crawl" / "archives" / "part-000000-lost-0000.warc.gz").write_bytes(b"half of a rec")
    assert warc.read_records(spark, f"{tmp_path}/crawl").count() == 4


def test_a_revisit_without_its_original(spark, tmp_path):
    run(spark, str(tmp_path), ROWS)
    records = warc.read_records(spark, f"{tmp_path}/out").where("page_id <> 100 or page_id is null")
    lost = warc.resolve(records).where("page_id = 101").first()
    assert (lost.record_type, lost.payload_bytes, lost.refers_to) == ("revisit", None, None)


def test_no_pages(spark, tmp_path):
    assert run(spark, str(tmp_path), []) == []


def test_a_cut_archive_is_an_error():
    data = warc.encode_record(warc.Record({"WARC-Type": "response"}, b"x" * 1000))
    assert [r.block for r in warc.decode_records(io.BytesIO(data * 3))] == [b"x" * 1000] * 3
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.decode_records(io.BytesIO(data[:-9])))
