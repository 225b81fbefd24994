"""Web archives: round trips, what readers check, and the SQL."""

from __future__ import annotations

import base64
import hashlib
import io
import struct

import duckdb
import pytest
import zstandard as zstd

from sparkbayes.llm import warc

PAGES = [
    (1, "https://a.example/x?q=1", "<p>one</p>", "clash"), (2, "https://a.example/y", "<p>one</p>", "clash"), (9, "http://b.example/\r\nEvil: 1", "<p>one</p>", "clash"), (3, None, None, "clash"), (4, "", "", "clash"),
    (5, "http://c.example/é", "größe \r\n\r\nWARC/1.1\r\n\r\n \x00 日本", "clash"), (6, "u", "z" * 3_000_000, "clash"), (7, "u", "z" * 3_000_000, "clash"), (7, "v", "z" * 3_000_000, "clash"), (None, "n", "<p>one</p>", "clash"), (None, "n", "alone", "clash"),
    *[(100 + i, f"http://d.example/{i}", f"<html><body><h1>Title {i % 40}</h1><p>Some words about {i % 40}</p></body></html>" * 20, "clash") for i in range(300)],
]


def wanted(least: int = 0) -> list[tuple]:
    largest: dict = {}
    for i, _, html, _ in PAGES:
        if i is not None:
            largest[html or ""] = max(i, largest.get(html or "", i))
    out = []
    for i, _, html, _ in PAGES:
        raw = (html or "").encode()
        first = largest.get(html or "") if len(raw) >= least else None
        revisit = first is not None and first != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, record_type string").repartition(3)


def rows(found) -> list[tuple]:
    number = lambda x: None if x is None else int(x)
    return sorted(((number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in found.collect()), key=str)


def test_round_trip(spark, pages, tmp_path):
    warc.write(warc.records(pages), f"file://{tmp_path}/a", archiveBytes=4000)
    found = warc.read(spark, f"file://{tmp_path}/a")
    assert rows(found) == wanted()
    assert len(list((tmp_path / "a").glob("*.warc.zst"))) > 5  # archives are cut
    text = {i: html for i, _, html, _ in PAGES}
    for r in found.where("record_type = 'response' and record_id is not null").collect():
        assert bytes(r.payload).decode() == (text[int(r.record_id)] or "")
        assert r.error is None
    urls = {r.record_id: r.url for r in found.collect()}
    assert urls["9"] == "http://b.example/%0D%0AEvil:%201" and urls["5"] == "http://c.example/é" and urls["3"] is None


def test_small_payloads_are_all_responses(spark, pages, tmp_path):
    warc.write(warc.records(pages, least_bytes=1000), f"file://{tmp_path}/a")
    assert rows(warc.read(spark, f"file://{tmp_path}/a", payload=False)) == wanted(1000)


def test_an_empty_table(spark, pages, tmp_path):
    warc.write(warc.records(pages.limit(0)), f"file://{tmp_path}/a")
    assert warc.read(spark, f"file://{tmp_path}/a").collect() == []


def test_the_sql_agrees(spark):
    kept = [p for p in PAGES if p[0] is not None]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
        db.executemany("INSERT INTO pages VALUES (?, ?, ?)", [p[:3] for p in kept])
        got = db.execute(warc.SQL).fetchall()
    assert sorted(got, key=str) == [w for w in wanted() if w[0] is not None]


def test_the_archive_begins_with_its_dictionary(spark, pages, tmp_path):
    warc.write(warc.records(pages).coalesce(1), f"file://{tmp_path}/a")
    raw = max((tmp_path / "a").glob("*.warc.zst"), key=lambda f: f.stat().st_size).read_bytes()
    magic, size = struct.unpack_from("<II", raw)
    assert magic == 0x184D2A5D
    dictionary = zstd.ZstdCompressionDict(zstd.ZstdDecompressor().decompress(raw[8 : 8 + size]))
    assert zstd.get_frame_parameters(raw[8 + size :]).dict_id == dictionary.dict_id()
    frames = [*warc.Frames(io.BytesIO(raw))]
    assert b"WARC-Type: warcinfo" in frames[0] and all(f.startswith(b"WARC/1.1\r\n") and f.endswith(b"\r\n\r\n") for f in frames)


ROW = {"record_id": "1", "record_type": "response", "refers_to": None, "url": "u", "payload": b"hello", "payload_bytes": 5, "payload_digest": base64.b32encode(hashlib.sha1(b"hello").digest()).decode()}
GOOD = warc.page_record(ROW, "2020-01-01T00:00:00Z")
BAD = {
    "version": GOOD.replace(b"WARC/1.1", b"WARK/1.1"), "length": GOOD.replace(b"hello", b"hello!"), "digest": GOOD.replace(b"hello", b"jello"), "end": GOOD[:-2], "no id": GOOD.replace(b"WARC-Record-ID", b"X-Record-ID"),
    "not a number": GOOD.replace(b"Content-Length: 5", b"Content-Length: x"), "no colon": GOOD.replace(b"WARC-Date:", b"WARC-Date"), "no blank line": b"WARC/1.1\r\nWARC-Type: response\r\n", "no status": GOOD.replace(b"HTTP/1.1", b"HTTQ 1.1"),
    "revisit of nothing": GOOD.replace(b"WARC-Type: response", b"WARC-Type: revisit"),
}


@pytest.mark.parametrize("what", BAD)
def test_wrong_records_are_refused(what):
    assert warc.parsed(GOOD)["payload"] == b"hello"
    with pytest.raises(ValueError):
        warc.parsed(BAD[what])


def test_archives_from_elsewhere(spark, tmp_path):
    """A plain dictionary, skippable frames between records, a bad record, other kinds of records, and a cut end."""
    samples = [GOOD[:-9] + str(i).encode() * 9 for i in range(2000)]
    dictionary = zstd.train_dictionary(4096, samples)
    coder = zstd.ZstdCompressor(dict_data=dictionary)
    other = warc.record("metadata", "<urn:uuid:1>", b"x: y\r\n", "2020-01-01T00:00:00Z", "application/warc-fields")
    parts = [struct.pack("<II", 0x184D2A5D, len(dictionary.as_bytes())) + dictionary.as_bytes(), coder.compress(GOOD), struct.pack("<II", 0x184D2A50, 3) + b"abc", coder.compress(BAD["digest"]), coder.compress(other), coder.compress(GOOD)]
    (tmp_path / "x.warc.zst").write_bytes(b"".join(parts))
    (tmp_path / "y.warc.zst").write_bytes(b"".join(parts[:2]) + parts[1][:-5])
    found = warc.read(spark, f"file://{tmp_path}", mode="PERMISSIVE").collect()
    assert sorted((r.record_id or "", (r.error or "")[:23]) for r in found) == [("", "x.warc.zst, record 1: t"), ("", "y.warc.zst, record 1: a"), ("1", ""), ("1", ""), ("1", "")]
    with pytest.raises(Exception, match="record 1: (the payload's length or digest|a frame is cut short)"):
        warc.read(spark, f"file://{tmp_path}").collect()
