r"""WARC archives compressed with Zstandard: one frame per record behind a dictionary frame.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record
is a Zstandard frame of its own.  ``archives`` writes a table of (path, content), the columns of
Spark's ``binaryFile`` source, to the shared folder, so it works on any store Spark reaches;
``records`` reads such rows back, from that table or from ``.warc.zst`` files loaded with
``spark.read.format("binaryFile")``.  ``export`` writes an archive table as files.

Duplicates: of rows whose payload has the same SHA-1 and at least ``min_bytes`` bytes, those with
the largest page_id become response records, the others revisits that refer to it.  The payload
digests are counted on narrow rows with partial maxima; the pages then join on the digest.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import bound_batches, staged

MAGIC = 0x184D2A5D
PAYLOAD_AT_ONCE = 4 << 20        # payload bytes of an archive, beyond which it is closed
DICT_BYTES, DICT_FROM = 16 << 10, 256 << 10
FEED = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that does not hold what its headers say."""


# --- writing ---------------------------------------------------------------------------------

def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; with ``refers_to`` a revisit, which keeps the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe='%/:=&?~#+!$,;@()*[]' + chr(39))}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The records behind a dictionary trained on the first of them."""
    samples, size = [], 0
    for r in records:
        if size >= DICT_FROM:
            break
        samples.append(r[:DICT_FROM])
        size += len(samples[-1])
    try:
        trained = zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:          # too few or too small samples: their raw bytes serve as well
        trained = zstandard.ZstdCompressionDict(b"".join(samples)[:DICT_BYTES].ljust(8, b" "),
                                                dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = trained.as_bytes()
    one = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", MAGIC, len(raw)), raw, *map(one.compress, records)])


def _marked(pages: DataFrame, min_bytes: int) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"), F.length(payload).alias("size"))
    dups = (rows.where(F.col("size") >= min_bytes).groupBy("digest", "size")
            .agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "size", "top"))
    return rows.join(dups, ["digest", "size"], "left").select(
        "page_id", "url", "payload", F.unhex("digest").alias("digest"),
        F.when(~F.col("top").eqNullSafe(F.col("page_id")), F.col("top")).alias("refers_to"))


def archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html); returns the table (path, content).

    A null html is an empty payload and a null url an empty target.  Rows that repeat the largest
    page_id of their payload are responses each; where a payload's page_ids are all null, so are
    those.  Further columns are not read."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, open_, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            nonlocal made, open_, size
            name, content = f"part-{part:05d}-{made:05d}.warc.zst", archive(open_)
            made, open_, size = made + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["path", "content"])

        for b in batches:
            for page_id, url, payload, digest, refers in zip(*(c for c in b.columns)):
                payload = payload.as_py()
                open_.append(record(page_id.as_py(), url.as_py(), payload, digest.as_py(), refers.as_py()))
                size += len(payload)
                if size >= PAYLOAD_AT_ONCE:
                    yield close()
        if open_:
            yield close()

    bound_batches(pages.sparkSession)
    return staged(_marked(pages, min_bytes).mapInArrow(write, "path string, content binary"), "warc")


def export(table: DataFrame, folder: str) -> DataFrame:
    """Write an archive table as files below ``folder``, a path that every executor has mounted.

    Each file appears by a rename, so a repeated task replaces it whole.  Returns the file paths."""
    def put(batches):
        for b in batches:
            names = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                names.append(os.path.join(folder, path))
                os.makedirs(folder, exist_ok=True)
                partial = f"{names[-1]}.{os.getpid()}.{TaskContext.get().taskAttemptId()}"
                with open(partial, "wb") as f:
                    f.write(content.as_py())
                os.replace(partial, names[-1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["path"])
    return staged(table.mapInArrow(put, "path string"), "warc-files")


# --- reading ---------------------------------------------------------------------------------

def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames after the dictionary frame; each must end before the next starts."""
    if len(content) < 8:
        raise WarcError("no dictionary frame")
    magic, size = struct.unpack_from("<II", content)
    if magic != MAGIC or 8 + size > len(content):
        raise WarcError("the archive does not start with a whole dictionary frame")
    raw = content[8: 8 + size]
    if raw[:4] == b"\x28\xb5\x2f\xfd":      # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    at, view = 8 + size, memoryview(content)
    while at < len(content):
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            if at >= len(content):
                raise WarcError("the last frame is cut off")
            fed = view[at: at + FEED]
            try:
                out.append(frame.decompress(fed))
            except zstandard.ZstdError as e:
                raise WarcError(f"bad frame before byte {at + len(fed)}: {e}") from e
            at += len(fed) - len(frame.unused_data)
        yield b"".join(out)


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"not a header: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def _page(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+|null)>", urn)
    if not m:
        raise WarcError(f"not a page id: {urn[:80]!r}")
    return None if m[1] == "null" else int(m[1])


def parse(raw: bytes) -> dict:
    """Check one record's version, headers, lengths and payload digest; returns what it says."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise WarcError("not a WARC record")
    h = _headers(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not h.get(name):
            raise WarcError(f"{name} is missing")
    if not h["content-length"].isdigit():
        raise WarcError("Content-Length is not a number")
    size = int(h["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(rest) - 4} bytes, its header says {size}")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise WarcError("the block is no HTTP message")
    length = _headers(http.partition(b"\r\n")[2]).get("content-length", "")
    if not length.isdigit():
        raise WarcError("the HTTP message has no length")
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
    kind, refers = h["warc-type"], None
    if kind == "response":
        if len(payload) != int(length):
            raise WarcError(f"the payload has {len(payload)} bytes, its header says {length}")
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise WarcError("the payload differs from its digest")
    elif kind == "revisit":
        if payload or not h.get("warc-refers-to"):
            raise WarcError("a revisit record needs WARC-Refers-To and no payload")
        refers = _page(h["warc-refers-to"])
    else:
        raise WarcError(f"unknown record type {kind[:40]!r}")
    return {"page_id": _page(h["warc-record-id"]), "url": h.get("warc-target-uri"), "payload_bytes": int(length), "payload_digest": digest,
            "record_type": kind, "refers_to": refers, "payload": payload if kind == "response" else None}


RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def records(table: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record of the archives in ``table`` (path, content); a faulty archive raises WarcError.

    Without ``payloads`` they are checked in the task but not returned."""
    schema = RECORD if payloads else pa.schema(list(RECORD)[:-1])
    spark_type = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows, size = [], 0
                try:
                    for raw in frames(content.as_py()):
                        rows.append(parse(raw))
                        size += len(raw) if payloads else 0
                        if size > PAYLOAD_AT_ONCE:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                except WarcError as e:
                    raise WarcError(f"{path}: {e}") from e
                yield pa.RecordBatch.from_pylist(rows, schema)
    return table.select("path", "content").mapInArrow(read, spark_type + (", payload binary" if payloads else ""))
