"""WARC archives with a Zstandard dictionary: written from rows, read back from the files alone.

An archive (.warc.zst) begins with a skippable frame that holds its dictionary, built from its own records and itself compressed.
Every record is a Zstandard frame of its own, so a reader can start at any record once it has the dictionary. Of pages
with equal payloads one is stored as response and the others are revisit records (identical-payload-digest).

Each task packs the rows it has into archives of about `archive_bytes`, held in memory one at a time. Files are written
under a name of the attempt and moved into place; the manifest, a Spark output, lists those of the attempt that counted.
"""
from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookdq.llm.common import Shelf, get, map_arrow, put, slices

ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 100 * DICTIONARY_BYTES  # of an archive's records, evenly spread: what its dictionary is built from, at most
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the format.
SKIPPABLE, COMPRESSED = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTROL = re.compile(r"[\x00-\x20\x7f]")


def urn(page_id: int | None) -> str:
    """A version 8 UUID with the 64-bit id in it (bit 60 of the last part tells that there is none)."""
    n = (page_id or 0) & (1 << 64) - 1
    return f"urn:uuid:{uuid.UUID(int=(n >> 16) << 80 | 8 << 76 | (n >> 4 & 0xFFF) << 64 | 2 << 62 | (page_id is None) << 60 | n & 0xF)}"


def page_of(name: str) -> int | None:
    v = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).int
    if v >> 60 & 1:
        return None
    n = (v >> 80) << 16 | (v >> 64 & 0xFFF) << 4 | v & 0xF
    return n - (1 << 64) if n >> 63 else n


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None] | None, date: str = DATE) -> bytes:
    """A response, or a revisit if refers_to holds the id of a response. Control characters of a URL are percent-encoded;
    a missing URL becomes about:blank."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{urn(page_id)}>", f"WARC-Date: {date}",
            f"WARC-Target-URI: {CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url or 'about:blank')}", f"WARC-Payload-Digest: sha1:{sha}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to:
        head[2:2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{urn(refers_to[0])}>"]
    return "\r\n".join(head).encode(errors="surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload); names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict((k.lower(), v) for k, _, v in (line.partition(": ") for line in head.decode(errors="surrogatepass").split("\r\n")[1:]))
    block = rest[:int(fields["content-length"])]
    if not head.startswith(b"WARC/") or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict((k.lower(), v) for k, _, v in (line.partition(": ") for line in http.decode().split("\r\n")[1:])), payload


def archive(records: list[bytes]) -> bytes:
    """Too few or too uniform records for a dictionary: the frame is left out."""
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    samples = [r[:128 << 10] for r in records[::step]]  # zstd looks at no more of a sample
    try:
        made = zstd.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstd.ZstdError:
        made = None
    out = io.BytesIO()
    if made is not None:
        packed = zstd.ZstdCompressor(level=19).compress(made.as_bytes())
        out.write(SKIPPABLE + struct.pack("<I", len(packed)) + packed)
        made.precompute_compress(level=LEVEL)
    tool = zstd.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True) if made is not None else zstd.ZstdCompressor(level=LEVEL, write_checksum=True)
    for r in records:
        out.write(tool.compress(r))
    return out.getvalue()


def records_of(raw: bytes, step: int = 64 << 10) -> Iterator[bytes]:
    """The records of an archive, each from its own frame."""
    at, tool = 0, zstd.ZstdDecompressor()
    if raw[:4] == SKIPPABLE:
        size = struct.unpack("<I", raw[4:8])[0]
        content, at = raw[8:8 + size], 8 + size
        tool = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(tool.decompress(content) if content[:4] == COMPRESSED else content))
    while at < len(raw):
        frame, parts = tool.decompressobj(), []
        while not frame.eof:
            if at >= len(raw):
                raise ValueError("the archive is cut")
            parts.append(frame.decompress(raw[at:at + step]))
            at = min(at + step, len(raw)) - len(frame.unused_data)
        yield b"".join(parts)


def choose(pages: DataFrame, least: int, key: str, url: str, html: str) -> DataFrame:
    """(id, url, html, top): top names the response that a row revisits, null if the row is one itself. Of rows with one
    payload of at least `least` bytes, that with the largest key is the response (nulls are least; of repeated keys, one)."""
    shelf = Shelf(pages.sparkSession, "warc-choice")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"),
                        F.unhex(F.sha1(payload)).alias("sha"), F.octet_length(payload).cast("long").alias("bytes"))
    rows = shelf.save(rows, "rows")  # so a row's number stays as it is
    light = rows.where(F.col("bytes") >= least).select("sha", "bytes", "id", "row")
    copies = light.groupBy("sha", "bytes").agg(F.max(F.struct("id", "row")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = light.join(copies.select("sha", "bytes", "top"), ["sha", "bytes"]).where("row <> top.row").select("row", F.struct(F.col("top.id").alias("id")).alias("top"))
    return rows.join(revisits, "row", "left").select("id", "url", "html", "top")


def write(chosen: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of the rows of `choose`; returns the manifest: file, records, bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size, number = TaskContext.get(), [], 0, 0

        def close() -> pa.RecordBatch:
            raw = archive(held)
            file = put(folder, f"{task.partitionId():06d}-{number:05d}-{task.taskAttemptId()}.warc.zst", raw)
            return pa.RecordBatch.from_pydict({"file": [file], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([len(raw)], pa.int64())})

        for batch in slices(batches, "html"):
            for row in batch.to_pylist():
                held.append(record(row["id"], row["url"], (row["html"] or "").encode(errors="surrogatepass"), (row["top"]["id"],) if row["top"] else None))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return map_arrow(chosen, run, "file string, records long, bytes long")


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of every record of the archives. The
    figures of a response are those of the payload read; a revisit states them. payloads=False leaves them out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows, size = [], 0
                for raw in records_of(get(file)):
                    fields, http, payload = parse(raw)
                    response, stated = fields["warc-type"] == "response", fields["warc-payload-digest"].removeprefix("sha1:")
                    if response and digest(payload) != stated:
                        raise ValueError(f"{file}: a payload does not have its digest")
                    rows.append((page_of(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], None if response else page_of(fields["warc-refers-to"]),
                                 len(payload) if response else int(http["content-length"]), stated, payload if response and payloads else None))
                    size += len(payload) if payloads else 200
                    if size > 4 << 20:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    files = manifest.select("file").repartition(manifest.sparkSession.sparkContext.defaultParallelism)
    return map_arrow(files, run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def write_and_read(pages: DataFrame, least: int = 0, payloads: bool = False, key: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives and manifest in the shared folder, read back. A null html is an empty payload; a null id, or a null url,
    is a record like others. Repeated rows are records of their own. An empty table gives no archive and no row."""
    shelf = Shelf(pages.sparkSession, "warc")
    return read(shelf.save(write(choose(pages, least, key, url, html), f"{shelf.path}/archives", archive_bytes), "manifest"), payloads)


ORACLE = """
WITH rows AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
fives AS (SELECT *, list_transform(generate_series(0, 7), lambda i: ('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT) AS words FROM rows)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(words, lambda w: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + w // 32768, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + w // 1024 % 32, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + w // 32 % 32, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + w % 32, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM fives
"""
