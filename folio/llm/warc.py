"""Compressed WARC archives written with an index first, and read back by coalesced byte ranges.

Writing: each task appends its records to archives of its own in the shared
folder, each a gzip member of its own, and returns one index row per record
(archive, offset, length, url, payload digest). Only archives that the committed index names are ever read, so a
repeated task does no harm. Reading: index rows of the selected records are
dealt by archive and stretch, sorted by offset, and neighbouring ranges are
fetched by one read.

Among records with equal payloads of at least `least` bytes the one with the
greatest page_id is the response, the others revisit it. Null html is an
empty payload; null page ids are written, but never referred to. If rows repeat a page_id
that is the response, each of them is a response. Extra columns are
ignored; an empty table gives no rows and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import only, shared_dir, staged, tidy

#: Payloads shorter than this are always stored.
LEAST = 1000
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Stretch of an archive that one reader takes, gap that a read may bridge, and bytes of one read.
STRETCH, GAP, READ = 1 << 20, 64 << 10, 8 << 20
#: Bytes of archives that a task reads, and repeated digests that are sent to all tasks.
SHARE, SENT = 16 << 20, 500_000
#: Effort of compression.
LEVEL = 1
#: All records carry this date, so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"

INDEX = "archive string, offset long, length long, url string, digest string, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def clean_url(url: str | None) -> str:
    """The url with what would end a header line percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page/{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """A response or, if it refers to a page, revisit record."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean_url(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    pack = zlib.compressobj(LEVEL, wbits=31)
    return pack.compress(b"%b\r\n\r\n%b\r\n\r\n" % ("\r\n".join(head).encode(), block)) + pack.flush()


def parse(raw: bytes | memoryview) -> dict:
    """The fields of RECORD out of one compressed record; the payload of a revisit is empty."""
    raw = zlib.decompress(raw, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(field["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = field["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {field['WARC-Record-ID']} does not match its digest")
    page, refers = field.get("X-Page-ID"), field.get("X-Refers-To-Page-ID")
    return {
        "page_id": page and int(page),
        "url": field["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": field["WARC-Type"],
        "refers_to": refers and int(refers),
        "payload": payload,
    }


def write_archives(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes all pages as WARC archives to the shared folder; returns the stored index."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = only(pages, "page_id", "url", "html").withColumn("payload", F.coalesce(F.col("html").cast("binary"), F.lit(b""))).drop("html")
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    large = rows.where(F.octet_length("payload") >= least)
    kept = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    kept = staged(kept, "repeated")
    refers = (F.octet_length("payload") >= least) & F.col("keeper").isNotNull() & ~F.coalesce(F.col("keeper") == F.col("page_id"), F.lit(False))
    # payloads stay where they are as long as the repeated digests are few enough to go to them
    rows = rows.join(F.broadcast(kept) if kept.count() <= SENT else kept, "digest", "left").select("page_id", "url", "payload", "digest", F.when(refers, F.col("keeper")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        out = name = None
        at = 0
        for batch in batches:
            found = []
            for page, url, payload, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None or at > ARCHIVE_BYTES:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                raw = record(page, url, payload, digest, refers_to)
                out.write(raw)
                found.append((f"{folder}/{name}", at, len(raw), clean_url(url), digest.hex(), "response" if refers_to is None else "revisit"))
                at += len(raw)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["archive", "offset", "length", "url", "digest", "record_type"])
        if out:
            out.close()

    return staged(rows.mapInArrow(tidy(write), INDEX), "warc-index")


def ranges(entries: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Reads (start, end, entries) that cover sorted (offset, length) entries."""
    run: list[tuple[int, int]] = []
    start = end = 0
    for offset, length in entries:
        if run and (offset > end + GAP or offset + length - start > READ):
            yield start, end, run
            run = []
        if not run:
            start = offset
        run.append((offset, length))
        end = max(end, offset + length) if len(run) > 1 else offset + length
    if run:
        yield start, end, run


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records that the given index rows name, read back from their archives."""
    # by the bytes of the archives, which the few bytes of an index row say nothing of
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // SHARE))
    dealt = index.select("archive", "offset", "length").repartition(tasks, "archive", F.floor(F.col("offset") / F.lit(STRETCH))).sortWithinPartitions("archive", "offset")
    columns = RECORD if payloads else RECORD.removesuffix(", payload binary")
    names = [x.split()[0] for x in columns.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kind[x.split()[1]]) for x in columns.split(", ")])
        name = file = None
        for batch in batches:
            by: dict[str, list[tuple[int, int]]] = {}
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                by.setdefault(archive, []).append((offset, length))
            for archive, entries in by.items():
                if archive != name:
                    if file:
                        file.close()
                    store, path = pafs.FileSystem.from_uri(archive)
                    name, file = archive, store.open_input_file(path)
                for start, end, run in ranges(entries):
                    raw = memoryview(file.read_at(end - start, start))
                    found = [parse(raw[o - start : o - start + n]) for o, n in run]
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in found], schema=schema)
        if file:
            file.close()

    return dealt.mapInArrow(tidy(read), columns)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes the archives and reads every record back."""
    return read_records(write_archives(pages, least)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
