"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

The writer rolls files of about ROLL bytes in the shared folder, each with a dictionary trained on its first records
(a fixed record template where these are too few to train on). Files are written under a name of their own and named in
the result, so a repeated task leaves an orphan and no damage. The reader streams a file: it loads the dictionary,
decodes one frame at a time, and checks magic numbers, versions, mandatory headers, lengths, digests and trailers.

Payloads of equal digest and length are stored once: the record with the largest page_id is the response, the others
revisit it. Defined results: null html is the empty payload; rows that tie on page_id and payload are all responses;
a null page_id is the smallest, and written as an empty value; null urls are written as urn:page:<page_id>; a very long
payload is one frame, which a task holds whole; an empty table gives no archive and no rows; extra columns are ignored.
Record ids are made of page_id, payload and the row's place in the table, so repeated rows have their own and a revisit names
its response's (of tied responses the last row's).
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import qualified, shared_dir, spill, tidied

SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
ROLL = 64 << 20
DICT_BYTES = 16 << 10
#: Bytes of records that a file's dictionary is trained on.
TRAIN_BYTES = 1 << 20
DATE = "2020-01-01T00:00:00Z"
CHUNK = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page_id, sha: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha}:{place}')}>"


def record(page_id, url, payload: bytes, refers_to, revisit: bool, place: int = 0, refers_place: int = 0) -> bytes:
    """One WARC record. A revisit holds the HTTP header only; its Content-Length there is that of the full payload."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    ident = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, sha, place)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or f'urn:page:{ident}').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Page-Id: {ident}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, sha, refers_place)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(record(0, "http://", b"<!DOCTYPE html><html><head></head><body></body></html>", None, False), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """Files in folder; closed() names them."""

    def __init__(self, folder: str, roll: int = ROLL):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.roll, self.waiting, self.held, self.out, self.size = roll, [], 0, None, 0
        self.names: list[str] = []

    def add(self, rec: bytes) -> None:
        if self.out is None:
            self.waiting.append(rec)
            self.held += len(rec)
            if self.held >= TRAIN_BYTES:
                self._open()
        else:
            self._write(rec)

    def _open(self) -> None:
        d = dictionary(self.waiting)
        name = f"{uuid.uuid4().hex}.warc.zst"
        self.out, self.size = self.fs.open_output_stream(f"{self.path}/{name}", compression=None), 0
        self.names.append(name)
        raw = d.as_bytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=True)
        waiting, self.waiting, self.held = self.waiting, [], 0
        for rec in waiting:
            self._write(rec)

    def _write(self, rec: bytes) -> None:
        if self.out is None:
            self.add(rec)
            return
        frame = self.packer.compress(rec)
        self.out.write(frame)
        self.size += len(frame)
        if self.size >= self.roll:
            self._end()

    def _end(self) -> None:
        self.out.close()
        self.out = None

    def closed(self) -> list[str]:
        while self.waiting:
            self._open()
        if self.out is not None:
            self._end()
        return self.names


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(f"not a valid archive: {what}")


def parse(rec: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, validated."""
    head, gap, rest = rec.partition(b"\r\n\r\n")
    _need(bool(gap), "a record's header has no end")
    lines = head.decode().split("\r\n")
    _need(lines[0] in ("WARC/1.0", "WARC/1.1"), f"version {lines[0][:20]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        _need(bool(colon), f"header line {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        _need(name in fields, f"no {name}")
    _need(fields["content-length"].isdigit(), "content-length")
    n = int(fields["content-length"])
    _need(len(rest) == n + 4 and rest[n:] == b"\r\n\r\n", f"a block of {len(rest) - 4} bytes, {n} announced")
    block = rest[:n]
    if "warc-block-digest" in fields:
        _need(fields["warc-block-digest"] == f"sha1:{digest(block)}", "block digest")
    return fields, block


def frames(stream):
    """Records of an open file, one for each frame; holds one chunk and one record."""
    held = stream.read(8)
    if not held:
        return
    _need(len(held) == 8, "it ends inside the leading frame")
    magic, size = struct.unpack("<II", held)
    options = {}
    held = b""
    if magic == SKIPPABLE:
        raw = stream.read(size)
        _need(len(raw) == size, "it ends inside the dictionary")
        if raw[:4] == FRAME:  # the dictionary may be compressed itself
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        options["dict_data"] = zstandard.ZstdCompressionDict(raw, dict_type=kind)
    else:
        held = struct.pack("<II", magic, size)
    unpack = zstandard.ZstdDecompressor(**options)
    while held or (held := stream.read(CHUNK)):
        while len(held) < 4 and (more := stream.read(CHUNK)):
            held += more
        _need(held[:4] == FRAME, "a frame's magic number")
        one, parts = unpack.decompressobj(), []
        while True:
            parts.append(one.decompress(held))
            if one.eof:
                held = one.unused_data
                break
            held = stream.read(CHUNK)
            _need(bool(held), "it ends inside a frame")
        yield b"".join(parts)


def unpacked(fields: dict[str, str], block: bytes) -> tuple:
    """page_id, url, html (None in revisits), payload_bytes, payload_digest, record_type, refers_to."""
    http, gap, payload = block.partition(b"\r\n\r\n")
    _need(bool(gap), "an HTTP header has no end")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    kind, sha = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    _need(length is not None, "no length of the payload")
    if kind == "response":
        _need(len(payload) == length, f"a payload of {len(payload)} bytes, {length} announced")
        _need(digest(payload) == sha, "payload digest")
    number = lambda x: int(x) if x not in ("", "None") else None
    return number(fields.get("x-page-id", "")), fields.get("warc-target-uri"), payload if kind == "response" else None, length, sha, kind, number(fields.get("x-refers-to-page-id", "")) if kind == "revisit" else None


def write_archives(pages: DataFrame, folder: str | None = None, roll: int = ROLL) -> DataFrame:
    """Archive every row of pages(page_id, url, html); archive: the files' URIs."""
    spark = pages.sparkSession
    folder = qualified(spark, folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    # only payloads that several rows have travel to the join's small side
    several = spill(rows.groupBy("sha", "size").agg(F.max(F.struct("page_id", "place")).alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "size", "last"), "payloads")
    again = F.col("last").isNotNull() & ~F.col("last.page_id").eqNullSafe(F.col("page_id"))
    rows = rows.join(several, ["sha", "size"], "left").select("page_id", "url", "html", "place", F.col("last.page_id").alias("last"), F.col("last.place").alias("last_place"), again.alias("again"))

    def run(batches):
        w = Writer(folder, roll)
        for batch in batches:
            html = batch.column("html")
            for k, (page_id, url, place, last, last_place, again) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "place", "last", "last_place", "again")))):
                w.add(record(page_id, url, html[k].as_py().encode(), last, again, place, last_place or 0))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in w.closed()], pa.string())], ["archive"])

    return spill(rows.mapInArrow(tidied(run), "archive string"), "archives")


def read_archives(archives: DataFrame, with_html: bool = True) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to of every record in the named files."""
    names = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                out, held = [], 0
                with fs.open_input_stream(path, compression=None) as f:
                    for rec in frames(f):
                        row = unpacked(*parse(rec))
                        html = row[2].decode() if with_html and row[2] is not None else None
                        out.append((*row[:2], html, *row[3:]))
                        held += len(rec) if with_html else 200
                        if held > 4 << 20:
                            yield batch_of(out)
                            out, held = [], 0
                if out:
                    yield batch_of(out)

    tasks = min(max(1, archives.count()), 20_000)
    return archives.select("archive").repartition(tasks).mapInArrow(tidied(run), "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long")
