import hashlib
import io
import os
import random
import struct

import pytest
import zstandard

from vectrove.llm import warc
from vectrove.llm.warc import SKIPPABLE_MAGIC, parse_record, plan_records, read_archive, read_warc, record_bytes, write_archive, write_warc

BIG = "<html>" + "same page " * 40 + "</html>"
ROWS = [(3, "u3", BIG), (1, "u1", BIG), (2, None, BIG), (4, "u4", "short"), (5, "u5", "short"), (6, "u6", None), (7, "u7", ""), (None, "u", BIG), (1, "u1", BIG), (8, "u\r\n8", "x" * 300_000), (9, "é", "日本" * 60)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, record_type string, payload long")


def brute(rows):
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        revisit = h in first and i != first[h]
        out.append((i is None, i or 0, len(h), hashlib.sha256(h).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("archive_bytes", [1, 1 << 24])
def test_round_trip(spark, tmp_path, archive_bytes):
    manifest = write_warc(plan_records(pages(spark, ROWS)), f"file://{tmp_path}/warc", archive_bytes)
    got = read_warc(manifest).collect()
    assert sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS)
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response" and r.page_id in (6, 8, 9)} == {6: "", 8: "x" * 300_000, 9: "日本" * 60}
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    assert sum(r.n_records for r in manifest.collect()) == len(ROWS)


@pytest.mark.parametrize("change", [{"opens": lambda folder: False}, {"BROADCAST_DIGESTS": 0}])
def test_other_file_systems_and_many_repeated_digests(spark, tmp_path, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(warc, name, value)
    rows = ROWS + [(100 + i, f"u{i}", "<p>" + "the parked page " * 10) for i in range(50)]
    got = read_warc(write_warc(plan_records(pages(spark, rows)), f"{tmp_path}/other", 1 << 16)).collect()
    assert sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    assert os.path.exists(f"{tmp_path}/other") == ("opens" not in change)


def test_names_of_file_systems_and_of_records():
    assert not warc.opens("unknown-scheme://host/folder")
    ids = {record_bytes(1, "u", b"same", "d", "response", None).split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for _ in range(50)}
    assert len(ids) == 50


def test_no_pages(spark, tmp_path):
    assert read_warc(write_warc(plan_records(pages(spark, [])), f"{tmp_path}/none")).count() == 0


def test_files_that_the_manifest_does_not_list_are_not_read(spark, tmp_path):
    manifest = write_warc(plan_records(pages(spark, ROWS[:3])), f"{tmp_path}/w")
    with open(f"{tmp_path}/w/left-by-a-lost-task.warc.zst", "wb") as f:
        f.write(b"half an archive")
    assert read_warc(manifest).count() == 3


def test_archive_layout():
    r = random.Random(2)
    records = [record_bytes(i, f"http://x/{i}", f"<p>{' '.join(r.choice(['red', 'green', 'blue']) for _ in range(200))}</p>".encode(), "d" * 64, "revisit", 1) for i in range(60)]
    out = io.BytesIO()
    write_archive(out, records)
    data = out.getvalue()
    magic, size = struct.unpack_from("<II", data)
    assert magic == SKIPPABLE_MAGIC
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    assert zstandard.ZstdCompressionDict(raw).dict_id() != 0
    assert list(read_archive(data)) == records
    # Each record is a frame of its own, which the dictionary alone opens.
    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).decompressobj().decompress(data[8 + size :])
    assert first == records[0]
    assert parse_record(records[3])["page_id"] == 3


def test_damage_is_found():
    with pytest.raises(ValueError, match="digest"):
        parse_record(record_bytes(1, "u", b"payload", "0" * 64, "response", None))
    out = io.BytesIO()
    write_archive(out, [os.urandom(500), os.urandom(90_000)])
    with pytest.raises(ValueError, match="ends inside"):
        list(read_archive(out.getvalue()[:-2000]))
