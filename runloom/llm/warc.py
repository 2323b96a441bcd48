"""Operator 9: WARC archives, written and read as a sequence of records.

Every record is a gzip member of its own. The reader holds a window of compressed bytes, inflates
member by member, takes the header up to its blank line and the block by Content-Length, and checks
the digests of block and payload while they pass. Tasks write archives of bounded size into a shared
folder; a written table lists those of successful attempts, and each is read by one task.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.tables import saved, shared_folder

#: Payloads under this many bytes are stored every time.
SHARED_BYTES = 100
ARCHIVE_BYTES = 64 << 20
_CHUNK = 1 << 16
_END = b"\r\n\r\n"


class WarcError(ValueError):
    """A record that is cut short, badly framed or fails a digest."""


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzip member. A response holds an HTTP message with the payload; a revisit holds the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + _END
    block = http + (payload if kind == "response" else b"")
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Page": "" if page_id is None else str(page_id),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": str(len(payload)),
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To-Page"] = "" if refers_to is None else str(refers_to)
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    member = zlib.compressobj(6, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
    return member.compress(head.encode() + block + _END) + member.flush()


class _Members:
    """Inflated bytes of one gzip member after the other."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.raw, self.ready = stream, b"", b""
        self.inflater = None

    def next_member(self) -> bool:
        self.raw = self.raw or self.stream.read(_CHUNK)
        self.inflater, self.ready = zlib.decompressobj(16 + zlib.MAX_WBITS), b""
        return bool(self.raw)

    def more(self) -> bytes:
        """The next inflated bytes of the member; none at its end."""
        while not self.inflater.eof:
            self.raw = self.raw or self.stream.read(_CHUNK)
            if not self.raw:
                raise WarcError("the archive ends within a record")
            out = self.inflater.decompress(self.raw, _CHUNK)
            self.raw = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            if out:
                return out
        return b""

    def until(self, mark: bytes) -> bytes:
        while mark not in self.ready:
            if not (new := self.more()):
                raise WarcError("a header does not end")
            self.ready += new
        head, _, self.ready = self.ready.partition(mark)
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """Exactly n bytes, in pieces."""
        while n:
            self.ready = self.ready or self.more()
            if not self.ready:
                raise WarcError("a block is shorter than its Content-Length")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode(errors="replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def read_records(stream: BinaryIO, keep: bool = True) -> Iterator[tuple[dict[str, str], bytes | None, int, str]]:
    """Header fields, payload (None unless ``keep``), payload length and digest of each record. Raises WarcError."""
    members = _Members(stream)
    try:
        while members.next_member():
            fields = _fields(members.until(_END))
            block, payload, held, size, http = hashlib.sha256(), hashlib.sha256(), [], 0, b""
            inside = False
            for piece in members.take(int(fields["content-length"])):
                block.update(piece)
                if not inside:
                    http += piece
                    if _END not in http:
                        continue
                    http, _, piece = http.partition(_END)
                    inside = True
                payload.update(piece)
                size += len(piece)
                if keep:
                    held.append(piece)
            tail = members.ready + b"".join(iter(members.more, b""))
            if tail != _END:
                raise WarcError("a record does not end after its block")
            if fields["warc-block-digest"] != f"sha256:{block.hexdigest()}":
                raise WarcError("a block does not have its digest")
            digest = fields["warc-payload-digest"].removeprefix("sha256:")
            if fields["warc-type"] == "response" and digest != payload.hexdigest():
                raise WarcError("a payload does not have its digest")
            if fields["warc-type"] == "revisit":
                size = int(fields["warc-payload-length"])
            yield fields, b"".join(held) if keep else None, size, digest
    except (zlib.error, KeyError, ValueError) as e:
        raise e if isinstance(e, WarcError) else WarcError(str(e)) from e


def _archive(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}.warc.gz"  # a retried task writes other files
    return system.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, written = None, []
        for batch in batches:
            for page, url, payload, digest, kind, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")), strict=True):
                if out is None:
                    out, name = _archive(folder)
                    written.append([name, 0, 0])
                member = record(kind.as_py(), page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py())
                out.write(member)
                written[-1][1] += 1
                written[-1][2] += len(member)
                if written[-1][2] >= ARCHIVE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        names, counts, sizes = zip(*written, strict=True) if written else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "records", "bytes"])

    return run


def _read(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name in batch.column("archive").to_pylist():
                system, path = fs.FileSystem.from_uri(name)
                with system.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for fields, payload, size, digest in read_records(stream, keep):
                        refers = fields.get("warc-refers-to-page")
                        rows.append((int(p) if (p := fields["warc-page"]) else None, fields["warc-target-uri"], size, digest, fields["warc-type"], int(refers) if refers else None, payload))
                        held += len(payload or b"")
                        if len(rows) == 5000 or held > 16 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                    yield _rows(rows)

    return run


_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _KINDS, strict=True)], _NAMES)


def write_warc(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) and returns the table of archives: archive, records, bytes.

    The payload is html in UTF-8, empty for null. Of records with equal payloads of at least
    SHARED_BYTES, that with the smallest page_id is a response and the others revisit it. Rows that
    repeat the smallest page_id are responses too; rows without page_id come after all others, and
    are responses if none has one. Other columns are ignored; an empty table writes no archive.
    """
    folder = folder or shared_folder(pages.sparkSession)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = held.where(F.octet_length("payload") >= SHARED_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    placed = held.join(first, "digest", "left").withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first")))
    return saved(placed.select("page_id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(_write(folder), "archive string, records long, bytes long"))


def read_warc(archives: DataFrame, keep_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null unless kept; empty for revisits) of every record.

    A damaged archive fails its task with WarcError: no record is dropped in silence.
    """
    n = max(archives.count(), 1)
    return archives.select("archive").repartitionByRange(n, "archive").mapInArrow(_read(keep_payload), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
