"""Web archives of Zstandard frames, written and read as a Spark data source (operator 13).

An archive (``.warc.zst``) begins with a skippable frame that holds a dictionary, followed by one frame a record, so
a reader needs the dictionary once and then decodes record after record. The dictionary is trained on an archive's
first records, up to ``SAMPLE`` bytes of them; it changes the archive's size and nothing else. A writing task cuts a new archive
after ``archiveBytes``, so reading tasks are bounded. Archives of lost or repeated task attempts count for nothing: a
reader goes by the list that the commit leaves.

Reading checks every record: the version line, the headers it needs, that Content-Length is the block's length, the
record's end, the HTTP head, its Content-Length, and the payload's SHA-1 digest. By default (mode ``FAILFAST``) what is
wrong ends the job with the archive's name and the record's number; in mode ``PERMISSIVE`` it becomes a row with ``error``.

Of records with equal payloads the one with the largest id is a response; the others are revisits, without payload, that name it.

Defined cases: a null payload is the empty one; null or empty urls are written as no target; control characters in a
url are percent-encoded; rows that repeat the largest id of a group are all responses, as a revisit couldn't tell them
apart; a null id revisits the group's response, and is a response itself where its group has no other id; a payload of
any length is one record; an empty table gives no records; columns other than id, url and payload aren't written.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import ready, release, shared_dir, table

SAMPLE, CLIP, DICTIONARY = 1 << 20, 1 << 16, 1 << 16  # bytes of the sample, of one record in it, of the dictionary
CHUNK, BATCH = 1 << 16, 4 << 20  # bytes read at a time, and of a batch given to Spark
# Frame magics, the list of archives, the profile of revisits.
DICTIONARY_FRAME, SKIPPABLE, FRAME = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
LIST = "_archives.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = [("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())]
SCHEMA = "record_id string, record_type string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary, error string"


def filesystem(path: str):
    """The file system of a shared folder's URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def named(record_id: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if record_id is None else f"<urn:record:{quote(record_id, safe='')}>"


def id_of(name: str) -> str | None:
    return unquote(name.removeprefix("<urn:record:").removesuffix(">")) if name.startswith("<urn:record:") else None


def head(fields: list[tuple[str, str | None]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in fields if v), "", ""]).encode()


def clean_url(url: str | None) -> str | None:
    return "".join(quote(c) if c < "!" or c == "\x7f" else c for c in url) if url else None


def record(kind: str, name: str, block: bytes, date: str, content: str, more: list[tuple[str, str | None]] = ()) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), *more, ("Content-Type", content), ("Content-Length", str(len(block)))]
    return head(fields, "WARC/1.1") + block + b"\r\n\r\n"


def page_record(row: dict, date: str) -> bytes:
    """A response with its payload, or a revisit without."""
    payload = row["payload"] if row["record_type"] == "response" else b""
    block = head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(row["payload_bytes"]))], "HTTP/1.1 200 OK") + payload
    more = [("WARC-Target-URI", clean_url(row["url"])), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}")]
    if row["record_type"] == "revisit":
        more += [("WARC-Profile", PROFILE), ("WARC-Refers-To", named(row["refers_to"]))]
    return record(row["record_type"], named(row["record_id"]), block, date, "application/http; msgtype=response", more)


class Archive:
    """One archive being written: records wait until the dictionary's sample is full."""

    def __init__(self, fs, path: str, date: str, level: int, sample: int):
        self.path, self.date, self.level, self.sample = path, date, level, sample
        self.out, self.waiting, self.sampled, self.held, self.coder, self.size, self.records = fs.open_output_stream(path, compression=None), [], 0, 0, None, 0, 0

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.coder:
            self._put(self.coder.compress(data))
            return
        self.waiting.append(data)
        self.sampled += min(len(data), CLIP)
        self.held += len(data)
        if self.sampled >= self.sample or self.held >= 16 * self.sample:
            self.begin()

    def begin(self) -> None:
        import zstandard as zstd

        options = {"level": self.level, "write_checksum": True, "write_content_size": True}
        try:
            dictionary = zstd.train_dictionary(DICTIONARY, [x[:CLIP] for x in self.waiting], k=200, d=8)
        except zstd.ZstdError:  # too few records for a dictionary: the archive has none
            self.coder = zstd.ZstdCompressor(**options)
        else:
            self.coder = zstd.ZstdCompressor(dict_data=dictionary, **options)
            packed = zstd.ZstdCompressor(level=19).compress(dictionary.as_bytes())
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self._put(self.coder.compress(record("warcinfo", named(None), b"software: sparkbayes\r\nformat: WARC File Format 1.1\r\n", self.date, "application/warc-fields")))
        for data in self.waiting:
            self._put(self.coder.compress(data))
        self.waiting = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if not self.coder:
            self.begin()
        self.out.close()


@dataclass
class Written(WriterCommitMessage):
    archives: list  # of (name, records, bytes)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.most, self.level = options["path"].rstrip("/"), int(options.get("archiveBytes", 256 << 20)), int(options.get("level", 3))
        self.date = options.get("date") or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        fs, at = filesystem(self.path)
        fs.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = filesystem(self.path)
        done, archive = [], None
        for batch in iterator:
            columns = [batch.column(name) for name in ("record_id", "record_type", "refers_to", "url", "payload_digest", "payload_bytes", "payload")]
            for i in range(batch.num_rows):
                if archive is None:
                    archive = Archive(fs, f"{at}/{uuid.uuid4().hex}.warc.zst", self.date, self.level, min(SAMPLE, self.most))
                archive.add(page_record({name: c[i].as_py() for name, c in zip(("record_id", "record_type", "refers_to", "url", "payload_digest", "payload_bytes", "payload"), columns, strict=True)}, self.date))
                if archive.size >= self.most:
                    archive.close()
                    done.append(archive)
                    archive = None
        if archive is not None:
            archive.close()
            done.append(archive)
        release()
        return Written([(a.path.rpartition("/")[2], a.records, a.size) for a in done])

    def commit(self, messages: list) -> None:
        fs, at = filesystem(self.path)
        archives = [x for m in messages if m for x in m.archives]
        with fs.open_output_stream(f"{at}/{LIST}") as out:
            out.write(json.dumps(archives).encode())

    def abort(self, messages: list) -> None:
        fs, at = filesystem(self.path)
        for name, *_ in (x for m in messages if m for x in m.archives):
            fs.delete_file(f"{at}/{name}")


class Frames:
    """An archive's records in order: the leading skippable frame's dictionary, then one frame at a time."""

    def __init__(self, stream):
        self.stream, self.rest, self.dictionary = stream, b"", None

    def _need(self, n: int) -> bool:
        """Have ``n`` bytes at hand, unless the archive ends first."""
        while len(self.rest) < n:
            more = self.stream.read(max(CHUNK, n - len(self.rest)))
            if not more:
                return False
            self.rest += more
        return True

    def _skippable(self) -> bytes:
        size = struct.unpack_from("<I", self.rest, 4)[0]
        if not self._need(8 + size):
            raise ValueError("a skippable frame is cut short")
        data, self.rest = self.rest[8 : 8 + size], self.rest[8 + size :]
        return data

    def __iter__(self) -> Iterator[bytes]:
        import zstandard as zstd

        first = True
        while self._need(1):
            if not self._need(8):
                raise ValueError("a frame is cut short")
            magic = struct.unpack_from("<I", self.rest)[0]
            if magic & 0xFFFFFFF0 == SKIPPABLE:
                data = self._skippable()
                if first and magic == DICTIONARY_FRAME:
                    if data[:4] == struct.pack("<I", FRAME):
                        data = zstd.ZstdDecompressor().decompress(data)
                    self.dictionary = zstd.ZstdCompressionDict(data)
                first = False
                continue
            if magic != FRAME:
                raise ValueError("neither a Zstandard nor a skippable frame")
            first = False
            yield self._frame(zstd.ZstdDecompressor(dict_data=self.dictionary).decompressobj())

    def _frame(self, one) -> bytes:
        out = []
        while True:
            out.append(one.decompress(self.rest))
            self.rest = one.unused_data if one.eof else b""
            if one.eof:
                return b"".join(out)
            if not self._need(1):
                raise ValueError("a frame is cut short")


def fields_of(raw: bytes, what: str) -> tuple[str, dict[str, str]]:
    """First line and fields, by lower-cased name, of a head."""
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"{what}: a line without a field's name")
        out[name.strip().lower()] = value.strip()
    return first, out


def length_of(fields: dict[str, str], what: str) -> int:
    text = fields.get("content-length", "")
    if not (text.isascii() and text.isdigit()):
        raise ValueError(f"{what}: no valid Content-Length")
    return int(text)


def parsed(data: bytes) -> dict | None:
    """A record's row, checked; None for records that aren't pages."""
    top, blank, rest = data.partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("the header has no end")
    first, fields = fields_of(top, "header")
    if first not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC version line")
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date") if not fields.get(k)]:
        raise ValueError(f"no {missing[0]}")
    size = length_of(fields, "header")
    if len(rest) != size + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError(f"Content-Length {size} isn't the block's length")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, blank, payload = rest[:size].partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("the HTTP head has no end")
    status, head_fields = fields_of(http, "HTTP head")
    if not status.startswith("HTTP/"):
        raise ValueError("no HTTP status line")
    full, digest = length_of(head_fields, "HTTP head"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != full or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("the payload's length or digest isn't the one stated")
    if kind == "revisit" and (payload or not digest or fields.get("warc-profile") != PROFILE or not fields.get("warc-refers-to")):
        raise ValueError("a revisit with a payload, or without digest, profile or reference")
    return {"record_id": id_of(fields["warc-record-id"]), "record_type": kind, "refers_to": id_of(fields.get("warc-refers-to", "")), "url": fields.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": full, "payload": payload if kind == "response" else None}


class OneArchive(InputPartition):
    def __init__(self, name: str):
        self.name = name


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"].rstrip("/"), options.get("payload", "true").lower() == "true"
        self.strict = options.get("mode", "FAILFAST").upper() == "FAILFAST"

    def partitions(self) -> list[OneArchive]:
        from pyarrow import fs as pafs

        fs, at = filesystem(self.path)
        if fs.get_file_info(f"{at}/{LIST}").type == pafs.FileType.NotFound:  # archives from elsewhere
            names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(at)) if f.base_name.endswith(".warc.zst"))
        else:
            with fs.open_input_stream(f"{at}/{LIST}") as f:
                names = [x[0] for x in json.loads(f.read())]
        return [OneArchive(n) for n in names] or [OneArchive("")]

    def read(self, partition: OneArchive) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, at = filesystem(self.path)
        rows, size = [], 0
        with fs.open_input_stream(f"{at}/{partition.name}", compression=None) as stream:
            for row in self.rows(stream, partition.name):
                rows.append(row)
                size += len(row.get("payload") or b"") + 300
                if size >= BATCH:
                    yield self.batch(rows)
                    rows, size = [], 0
        yield self.batch(rows)
        release()

    def rows(self, stream, name: str) -> Iterator[dict]:
        frames, number = iter(Frames(stream)), 0
        while True:
            try:
                data = next(frames, None)
            except Exception as e:  # what follows a broken frame can't be found
                yield self.wrong(name, number, e)
                return
            if data is None:
                return
            try:
                row = parsed(data)
            except ValueError as e:
                row = self.wrong(name, number, e)
            number += 1
            if row is not None:
                yield row if self.payload else row | {"payload": None}

    def wrong(self, name: str, number: int, error: Exception) -> dict:
        said = f"{name}, record {number}: {error}"
        if self.strict:
            raise ValueError(said) from error
        return {"error": said}

    @staticmethod
    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in FIELDS], names=[k for k, _ in FIELDS])


class WarcSource(DataSource):
    """``spark.read.format("warc_zst")`` and ``df.write.format("warc_zst")``; see the module for options and checks."""

    @classmethod
    def name(cls) -> str:
        return "warc_zst"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def known(spark: SparkSession) -> SparkSession:
    ready(spark).dataSource.register(WarcSource)
    return spark


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: four groups of 40 bits, each as eight digits of base 32, in the other alphabet."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", *, least_bytes: int = 0) -> DataFrame:
    """A row for each record to write. Payloads of fewer than ``least_bytes`` bytes are always responses.

    Equal payloads meet by their SHA-256; the largest id of each is found before the rows themselves are shuffled.
    """
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), data.alias("payload")).withColumn("content", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("content").agg(F.max("id").alias("largest"))
    revisit = F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest"))
    return rows.join(first, "content", "left").select(
        F.col("id").cast("string").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("largest").cast("string")).alias("refers_to"),
        F.col("url").cast("string").alias("url"), base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(found: DataFrame, path: str, **options) -> None:
    """Records as archives below ``path``, a folder that all executors share."""
    known(found.sparkSession)
    found.write.format("warc_zst").options(**options).mode("append").save(path)


def read(spark: SparkSession, path: str, *, payload: bool = True, mode: str = "FAILFAST") -> DataFrame:
    return known(spark).read.format("warc_zst").option("payload", str(payload).lower()).option("mode", mode).load(path)


def query(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(records(table(spark, sf_dir, "pages")), path)
    found = read(spark, path, payload=False)
    return found.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


SQL = """
WITH full_pages AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS largest, unhex(sha1(payload))::BIT::VARCHAR AS bits FROM full_pages)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: substr(bits, (5 * i + j + 1)::INT, 1)::INT << (4 - j)::INT))::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN largest IS DISTINCT FROM page_id AND largest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN largest IS DISTINCT FROM page_id THEN largest END AS refers_to
FROM grouped
"""
