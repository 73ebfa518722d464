"""WARC archives: a writer with revisit records, and a reader that salvages what lies behind damage."""
from __future__ import annotations

import hashlib
import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huskwatch.llm.common import local_path, shared_folder, spread

VERSION = b"WARC/1.1\r\n"
#: Payloads below this many bytes are never replaced by a revisit.
SHORTEST = 100
#: An archive is closed once it holds so many bytes; one larger record still goes into one file.
ARCHIVE_BYTES = 64 << 20
_MAGIC = b"\x1f\x8b\x08"
#: Where a record may begin in an archive of gzip members, of plain records, or of a form not known yet.
_MARKS = {True: re.compile(_MAGIC), False: re.compile(rb"WARC/1\."), None: re.compile(_MAGIC + rb"|WARC/1\.")}
_READ = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_file(uri: str, mode: str):
    """A binary file in the shared folder: opened directly where it is mounted, else by its store's own client."""
    if (path := local_path(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    store, path = pafs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if mode == "wb" else store.open_input_file(path)


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """One record; header values have their line breaks and percent signs escaped."""
    lines = [f"{k}: {v.replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A')}" for k, v in {"WARC-Type": kind, **fields, "Content-Length": str(len(block))}.items()]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The record of a page; without an id it gets a random one, and a revisit has only the digest and the length of its payload."""
    name = "" if page_id is None else str(page_id)
    fields = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": url or "", "Page-Id": name,
              "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}", "Payload-Length": str(len(payload)), "Content-Type": "application/http; msgtype=response"}
    if revisit:
        fields |= {"WARC-Profile": _PROFILE, "Refers-To-Page-Id": str(refers_to)}
        return record("revisit", fields, b"HTTP/1.1 200 OK\r\n\r\n")
    return record("response", fields, _HTTP % len(payload) + payload)


def member(data: bytes) -> bytes:
    """A gzip member of its own, so that a reader can start at any record."""
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def with_revisits(pages: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """page_id, url, payload, digest, refers_to, revisit.

    Of equal payloads of at least ``shortest`` bytes, the rows with the smallest page_id are responses and the others revisit
    it; rows without an id come last, and are all responses where no row of the payload has one."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    # Short payloads get keys that match nothing, so that many equal ones do not meet in one task.
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    rows = rows.withColumn("digest", F.when(F.length("payload") >= shortest, F.sha2("payload", 256)).otherwise(alone))
    first = rows.where(F.length("payload") >= shortest).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    found = rows.join(first, "digest", "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return found.select("page_id", "url", "payload", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, folder: str | None = None, compressed: bool = True, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages and returns the manifest: one row (path, records, bytes) per archive.

    Each task attempt writes files of its own name and only the manifest of the attempts that succeeded is committed, so a
    lost executor leaves at most files that no manifest names."""
    folder = folder or shared_folder(pages.sparkSession)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, path, n, size = None, "", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if file is None:
                    path, n, size = f"{folder}/archives/{uuid.uuid4().hex}.warc{'.gz' if compressed else ''}", 0, 0
                    file = open_file(path, "wb")
                data = page_record(row["page_id"], row["url"], row["payload"], row["refers_to"], row["revisit"])
                data = member(data) if compressed else data
                file.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    file.close()
                    file = None
                    yield pa.record_batch({"path": [path], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})
        if file is not None:
            file.close()
            yield pa.record_batch({"path": [path], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    with_revisits(pages).mapInArrow(put, "path string, records long, bytes long").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


@dataclass
class Found:
    """A record, or with ``gap`` the reason for which bytes [start, end) of the archive were put aside."""

    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    gap: str = ""


class Source:
    """A file as a window that grows forward; what lies before ``keep`` is let go."""

    def __init__(self, file: io.BufferedIOBase) -> None:
        self.file, self.base, self.data, self.ended = file, 0, b"", False

    def more(self) -> bool:
        if not self.ended:
            got = self.file.read(max(_READ, len(self.data)))
            self.ended = not got
            self.data += got
        return not self.ended

    def keep(self, at: int) -> None:
        self.data, self.base = self.data[at - self.base:], at

    def find(self, what: re.Pattern, longest: int, at: int) -> int:
        """Place of the next match (of at most ``longest`` bytes) at or after a place, or -1; bytes passed over are let go."""
        while (m := what.search(self.data, at - self.base)) is None:
            at = max(at, self.base + len(self.data) - longest + 1)
            self.keep(at)
            if not self.more():
                return -1
        return self.base + m.start()


class Damaged(Exception):
    """A check failed; the text names it."""


def _headers(raw: bytes) -> dict[str, str]:
    first, *lines = raw.split(b"\r\n")
    if not first.startswith(b"WARC/1."):
        raise Damaged("version line")
    out = {}
    for line in lines:
        name, colon, value = line.partition(b": ")
        if not colon:
            raise Damaged("header line")
        if name != b"WARC-Concurrent-To" and name.decode("latin-1") in out:
            raise Damaged("repeated header")  # the rest of one header block and the start of another
        out[name.decode("latin-1")] = value.decode("utf-8", "replace").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    if not out.get("Content-Length", "").isdigit():
        raise Damaged("content length")
    return out


def _checked(headers: dict[str, str], block: bytes) -> None:
    if headers.get("WARC-Type") == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if headers.get("WARC-Payload-Digest") != f"sha256:{hashlib.sha256(payload).hexdigest()}":
            raise Damaged("payload digest")


def _plain_record(source: Source, at: int) -> Found:
    """The record at a place; raises Damaged if any check fails."""
    while (end := source.data.find(b"\r\n\r\n", at - source.base)) < 0:
        if len(source.data) - (at - source.base) > _READ or not source.more():
            raise Damaged("header end")
    raw = source.data[at - source.base:end]
    headers = _headers(raw)
    begin = end + 4 + source.base
    need = begin + int(headers["Content-Length"]) + 4
    while source.base + len(source.data) < need:
        if not source.more():
            raise Damaged("truncated block")
    block = source.data[begin - source.base:need - 4 - source.base]
    if source.data[need - 4 - source.base:need - source.base] != b"\r\n\r\n":
        raise Damaged("record end")
    _checked(headers, block)
    return Found(at, need, headers, block)


def _member_record(source: Source, at: int) -> Found:
    """The record in the gzip member at a place; raises Damaged if any check fails."""
    if source.data[at - source.base:at - source.base + 3] != _MAGIC:
        raise Damaged("member magic")
    unpress, out, fed = zlib.decompressobj(31), [], at
    try:
        while not unpress.eof:
            chunk = source.data[fed - source.base:fed - source.base + _READ]
            if not chunk and not source.more():
                raise Damaged("truncated member")
            out.append(unpress.decompress(chunk))
            fed += len(chunk)
            if out and not b"".join(out[:1]).startswith(VERSION[:7]) and len(out[0]) >= 7:
                raise Damaged("version line")
    except zlib.error as e:
        raise Damaged("member data") from e
    inner = Source(io.BytesIO(b"".join(out)))
    inner.more()
    found = _plain_record(inner, 0)
    return Found(at, fed - len(unpress.unused_data), found.headers, found.block)


def salvage(file: io.BufferedIOBase) -> Iterator[Found]:
    """All records of an archive that pass every check, and the byte gaps between them.

    After a failed check the search goes on one byte further for the next gzip member or version line that gives a whole valid
    record. Both forms are tried side by side until a record is found, whose form the rest of the archive has. Holds one record
    and the bytes of one failed attempt at a time."""
    source = Source(file)
    source.more()
    packed: bool | None = None
    at, bad, why = 0, -1, ""
    while True:
        source.keep(at)
        if not source.data and not source.more():
            break
        try:
            while len(source.data) < 16 and source.more():
                pass
            member = source.data[:3] == _MAGIC if packed is None else packed
            found = (_member_record if member else _plain_record)(source, at)
            packed = member
        except Damaged as e:
            if bad < 0:
                bad, why = at, str(e)
            at = source.find(_MARKS[packed], 7, at + 1)
            if at < 0:
                break
            continue
        if bad >= 0:
            yield Found(bad, found.start, gap=why)
            bad = -1
        yield found
        at = found.end
    if bad >= 0:
        yield Found(bad, source.base + len(source.data), gap=why)


def read(manifest: DataFrame) -> DataFrame:
    """A row per record or gap: path, start, end, gap (null for records), record_type, page_id, url, digest, payload_bytes, refers_to, payload.

    An archive is one task's work and is bounded by the writer. The payload of a revisit is null; its digest and length are
    those of the full payload. Empty archives give no rows."""
    kind = ("path string, start long, end long, gap string, record_type string, page_id long, url string, digest string, payload_bytes long, "
            "refers_to long, payload binary")
    names = [c.split()[0] for c in kind.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in kind.split(", ")]

    def rows(path: str) -> Iterator[tuple]:
        with open_file(path, "rb") as file:
            for x in salvage(file):
                h = x.headers
                if x.gap:
                    yield (path, x.start, x.end, x.gap, *[None] * 7)
                    continue
                payload = x.block.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
                number = lambda k, h=h: int(v) if (v := h.get(k, "")).lstrip("-").isdigit() else None
                digest = h.get("WARC-Payload-Digest", "").removeprefix("sha256:") if payload is None else hashlib.sha256(payload).hexdigest()
                size = number("Payload-Length") if payload is None else len(payload)
                yield path, x.start, x.end, None, h["WARC-Type"], number("Page-Id"), h.get("WARC-Target-URI"), digest, size, number("Refers-To-Page-Id"), payload

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for r in rows(path):
                    held.append(r)
                    size += len(r[-1] or b"")
                    if len(held) >= 1000 or size >= 8 << 20:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return spread(manifest.select("path"), "path").mapInArrow(get, kind)


def digest(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from the archives that were written of the pages."""
    found = read(write(pages)).where("gap is null")
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
