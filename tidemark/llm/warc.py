"""WARC archives: writing pages as gzip members, and a reader that splits archives by byte ranges.

Writing: pages with equal payloads (by SHA-1, as in the record header) are one response and revisits of
it. Each task writes one archive, which has its name only once it is whole; the manifest lists the
archives that finished tasks reported. Reading: tasks get byte ranges. A task scans its range for the gzip
magic, takes the first place from which a WARC header decodes, and from there on owns the records that
start inside its range, reading beyond its end for the last one. After a damaged record, or one that was cut
off, it scans on from that record's own start, so no whole record after it is lost.

Scale: only payloads whose digest may repeat take part in a join (see ``exact_dedup.sieved``), and groups
with a large share of the rows are broadcast by digest. A task holds one record and one buffer.

Defined results: a null payload is empty. Of pages with equal payloads of ``least_bytes`` or more that with
the largest id is the response; rows that repeat its id and payload are responses too. A null id is the
smallest. A null URL has no header. Empty tables give no archive and no record. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, bounded_batches, new_path, quoted, spread_out, written
from tidemark.llm.exact_dedup import sieved
from tidemark.llm.files import located, write_once

SPLIT_BYTES = 4 << 20
BUFFER = 1 << 20
#: Compressed bytes handed to zlib at a time.
FEED = 1 << 14
MAGIC = b"\x1f\x8b\x08"
LEVEL = 4
_NAME = "urn:tidemark:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A record as a gzip member; a revisit has the response's HTTP header only."""

    def name(i: int | None) -> str:
        return f"<{_NAME}{'none' if i is None else i}>"

    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    text = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(text) + packer.flush()


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record per page; returns the manifest: path and size of each archive."""
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or new_path(spark, "warc")
    rows = pages.select(quoted(id_col).cast("long").alias("__id"), quoted(url_col).alias("__url"), F.coalesce(quoted(payload_col), F.lit("")).alias("__text"))
    rows = rows.withColumn("__hash", F.unhex(F.sha1(F.encode("__text", "UTF-8"))))
    groups = rows.filter(F.octet_length("__text") >= least_bytes).groupBy("__hash").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__size"))
    groups = written(groups.filter("__size > 1"), "warc-groups")
    spread = F.encode(F.concat(F.lit("row "), F.sha2(F.concat_ws(" ", "__id", "__url"), 256)), "UTF-8")
    alone = sieved(rows, groups, inside=False).withColumns({"__keep": F.lit(None).cast("long"), "__size": F.lit(None).cast("long")})
    among = attach(sieved(rows, groups), groups, "__hash", "__size", spread)
    revisit = F.col("__size").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__keep"))
    columns = ["__id", "__url", "__text", "__hash", "__keep", revisit.alias("__revisit")]
    rows = among.select(*columns).unionByName(alone.select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for page_id, url, text, digest, keep, again in zip(*batch.columns, strict=True):
                    yield record(page_id.as_py(), url.as_py(), text.as_py().encode(), digest.as_py(), keep.as_py(), again.as_py())

        path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        parts = records()
        if (first := next(parts, None)) is not None:
            size = write_once(path, (x for some in ([first], parts) for x in some))
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size]})

    return written(rows.mapInArrow(run, "path string, size long"), "warc-manifest")


class _Window:
    """A file's bytes from some place on, read a buffer at a time; those before ``place`` are done with."""

    def __init__(self, source, size: int, at: int):
        self.source, self.size, self.read, self.data, self.place = source, size, at, b"", 0

    @property
    def at(self) -> int:
        """Where in the file the window's place is."""
        return self.read - self.left

    @property
    def left(self) -> int:
        return len(self.data) - self.place

    def more(self) -> bool:
        """Reads on; False at the end of the file."""
        new = self.source.read_at(min(BUFFER, self.size - self.read), self.read)
        self.data, self.place, self.read = self.data[self.place :] + new, 0, self.read + len(new)
        return bool(new)


def _opens_record(window: _Window) -> bool:
    """Whether a gzip member at the window's place decodes to a WARC header."""
    while window.left < 512 and window.more():
        pass
    try:
        return zlib.decompressobj(31).decompress(window.data[window.place : window.place + 512], 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def members(source, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records that start in [start, end), decompressed. What a damaged one seemed to hold is scanned as well."""
    window = _Window(source, size, start)
    while window.at < end:
        found = window.data.find(MAGIC, window.place)
        if found < 0:
            window.place = max(window.place, len(window.data) - len(MAGIC) + 1)
            if not window.more():
                return
            continue
        window.place = found
        if window.at >= end:
            return
        if not _opens_record(window):
            window.place += 1
            continue
        begun, unpacker, out = window.at, zlib.decompressobj(31), []
        try:
            while not unpacker.eof and (window.left or window.more()):
                piece = window.data[window.place : window.place + FEED]  # its unused rest is copied at a record's end
                out.append(unpacker.decompress(piece))
                window.place += len(piece)
        except zlib.error:
            pass
        if unpacker.eof:
            window.place -= len(unpacker.unused_data)
            yield b"".join(out)
        else:
            window = _Window(source, size, begun + len(MAGIC))


def parse(data: bytes) -> dict | None:
    """A record's fields; None for records of other kinds or that are damaged."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    length = fields.get("content-length", "")
    if fields.get("warc-type") not in ("response", "revisit") or not length.isdigit() or len(block) < int(length):
        return None
    http, _, payload = block[: int(length)].partition(b"\r\n\r\n")

    def page(name: str) -> int | None:
        number = fields.get(name, "").strip("<>").removeprefix(_NAME)
        return int(number) if number.lstrip("-").isdigit() else None

    digest, revisit = fields.get("warc-payload-digest", "").removeprefix("sha1:"), fields["warc-type"] == "revisit"
    if revisit:
        stated = re.search(rb"(?mi)^content-length:\s*(\d+)", http)
        n, payload = int(stated[1]) if stated else None, None
    else:
        n = len(payload)
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            return None
    return {"page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload_bytes": n, "payload_digest": digest, "refers_to": page("warc-refers-to"), "payload": payload}


def read(manifest: DataFrame, with_payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record: page_id, url, record_type, payload_bytes, payload_digest, refers_to and, if asked for, payload (null for revisits)."""
    splits = manifest.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                system, path = located(split["path"])
                rows, held = [], 0
                with system.open_input_file(path) as source:
                    for data in members(source, split["size"], split["start"], min(split["start"] + split_bytes, split["size"])):
                        if (row := parse(data)) is None:
                            continue
                        if not with_payload:
                            del row["payload"]
                        rows.append(row)
                        held += len(data) if with_payload else 256
                        if held >= 1 << 23:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kind = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload
    return spread_out(splits, "path", "start").mapInArrow(run, kind)
