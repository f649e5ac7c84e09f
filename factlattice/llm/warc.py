"""WARC archives: writing, normalising monolithic gzip files, reading back by a sidecar index (operator 1)."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.llm.common import Work, salted_join

CHUNK = 1 << 20
#: Uncompressed bytes after which a writer begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Bytes of a record's head at most.
HEAD_BYTES = 1 << 20
#: zlib's level for archives; inflating costs the same at any level.
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


class Inflated:
    """A gzip file, of one member or many, as one stream of bytes that is inflated once, in chunks."""

    def __init__(self, source):
        self.source, self.held, self.at, self.inflater, self.ended = source, b"", 0, zlib.decompressobj(31), False
        self.fed, self.broken = False, False

    def _more(self) -> bool:
        while not self.ended:
            raw = self.inflater.unconsumed_tail or self.inflater.unused_data or self.source.read(CHUNK)
            if self.inflater.eof:
                if not raw:
                    self.ended = True
                    break
                self.inflater = zlib.decompressobj(31)
            if not raw:
                self.ended, self.broken = True, self.fed  # the file breaks off inside a member
                break
            self.fed = True
            new = self.inflater.decompress(raw, CHUNK)
            if new:
                self.held, self.at = self.held[self.at :] + new, 0
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to and with the mark; None if HEAD_BYTES or the rest of the stream are without it."""
        seek = self.at
        while (found := self.held.find(mark, seek)) < 0:
            kept = len(self.held) - self.at
            if kept > HEAD_BYTES or not self._more():
                return None
            seek = self.at + max(0, kept - len(mark))
        out, self.at = self.held[self.at : found + len(mark)], found + len(mark)
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces; fewer at the end of the stream."""
        while n > 0:
            if self.at == len(self.held) and not self._more():
                return
            piece = self.held[self.at : self.at + n]
            self.at += len(piece)
            n -= len(piece)
            yield piece


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def record_head(page_id: int | None, url: str | None, kind: str, digest: str, payload_bytes: int, refers_to: int | None) -> bytes:
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "text/html")]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to)), ("X-Payload-Length", str(payload_bytes))]
    fields.append(("Content-Length", str(0 if kind == "revisit" else payload_bytes)))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _writer(folder: str, archive_bytes: int, level: int):
    """Writes a task's rows to archives of one gzip member each; gives their names once they are whole."""

    def run(batches):
        files, base = pafs.FileSystem.from_uri(folder)
        out = None

        def close():
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_pylist([{"archive": name, "records": records}], pa.schema([("archive", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for page_id, url, payload, kind, refers_to in zip(*(batch.column(k) for k in range(5))):
                if out is None:
                    files.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"  # each attempt of a task has names of its own
                    out, packer, written, records = files.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, wbits=31), 0, 0
                body = payload.as_buffer().to_pybytes()
                kind = kind.as_py()
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                head = record_head(page_id.as_py(), url.as_py(), kind, digest, len(body), refers_to.as_py())
                out.write(packer.compress(head + (body if kind != "revisit" else b"") + b"\r\n\r\n"))
                written, records = written + len(head) + len(body), records + 1
                if written >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, min_payload_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Writes (page_id, url, html) as WARC archives of one gzip stream each; gives archive, records.

    Of records with equal payloads of at least min_payload_bytes that with the largest page_id is the response
    and the others revisit it; rows that repeat that id are responses too, and so are equal payloads without any
    id. A null html is an empty payload, a null url gives no target.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    groups = rows.filter(F.col("bytes") >= min_payload_bytes).groupBy("sha1", "bytes").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = salted_join(rows, groups, ["sha1", "bytes"], "left", F.col("page_id"))
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    rows = rows.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("keeper")).alias("refers_to"))
    return rows.mapInArrow(_writer(folder, archive_bytes, level), "archive string, records long")


def normalise_stream(source, sink, level: int = LEVEL) -> tuple[list[tuple], int]:
    """Inflates source once and writes each record to sink as its own gzip member.

    Gives (offset, length, type, record id) for each record, and the number of bytes-level faults: a record
    that breaks off, or bytes that begin no record, end the file there and count as one; so do bytes that zlib
    cannot inflate.
    """
    stream, index, offset = Inflated(source), [], 0
    while True:
        try:
            head = stream.until(b"\r\n\r\n")
            if head is None:
                return index, int(stream.broken or stream.at < len(stream.held))
            fields = header_fields(head.lstrip(b"\r\n"))
            n = int(fields["content-length"])
            packer = zlib.compressobj(level, wbits=31)
            parts, left, length = [packer.compress(head.lstrip(b"\r\n"))], n + 4, 0
            for piece in stream.pieces(n + 4):
                left -= len(piece)
                parts.append(packer.compress(piece))
                if sum(map(len, parts)) >= CHUNK:
                    length += sink.write(b"".join(parts)) or sum(map(len, parts))
                    parts = []
        except (ValueError, KeyError, zlib.error):
            return index, 1
        parts.append(packer.flush())
        sink.write(b"".join(parts))
        length += sum(map(len, parts))
        if left:
            return index, 1
        index.append((offset, length, fields.get("warc-type", ""), fields.get("warc-record-id", "")))
        offset += length


def _normaliser(source: str, target: str, level: int):
    def run(batches):
        files, base = pafs.FileSystem.from_uri(source)
        to, there = pafs.FileSystem.from_uri(target)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                to.create_dir(there, recursive=True)
                made = f"{name.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}"
                with files.open_input_stream(f"{base}/{name}", compression=None) as raw, to.open_output_stream(f"{there}/{made}.warc.gz", compression=None) as sink:
                    index, faults = normalise_stream(raw, sink, level)
                with to.open_output_stream(f"{there}/{made}.idx") as side:
                    for row in index:
                        side.write((json.dumps(row) + "\n").encode())
                yield pa.RecordBatch.from_pylist([{"archive": f"{made}.warc.gz", "index": f"{made}.idx", "records": len(index), "faults": faults}], pa.schema([("archive", pa.string()), ("index", pa.string()), ("records", pa.int64()), ("faults", pa.int64())]))

    return run


def normalise_archives(archives: DataFrame, source: str, target: str, level: int = LEVEL) -> DataFrame:
    """Rewrites each archive of folder source into target, one gzip member a record, with a sidecar index.

    An index line is a JSON list: offset, length, type, record id. Gives archive, index, records, faults.
    """
    return archives.select("archive").mapInArrow(_normaliser(source, target, level), "archive string, index string, records long, faults long")


def _reader(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload", pa.binary())])
    number = lambda x: int(s) if (s := x.removeprefix("<urn:page:").removesuffix(">")) else None

    def run(batches):
        files, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, side in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist()):
                rows, held = [], 0
                with files.open_input_file(f"{base}/{name}") as data, files.open_input_stream(f"{base}/{side}") as lines:
                    for line in lines.read().decode().splitlines():
                        offset, length, kind, record_id = json.loads(line)
                        raw = zlib.decompress(data.read_at(length, offset), 31)
                        cut = raw.index(b"\r\n\r\n") + 4
                        fields = header_fields(raw[:cut])
                        payload = raw[cut : cut + int(fields["content-length"])]
                        revisit = kind == "revisit"
                        rows.append({
                            "page_id": number(record_id), "payload_bytes": int(fields["x-payload-length"]) if revisit else len(payload),
                            "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                            "record_type": kind, "refers_to": number(fields["warc-refers-to"]) if revisit else None, "url": fields.get("warc-target-uri"),
                            "archive": name, "offset": offset, "length": length, "payload": None if revisit else payload,
                        })
                        held += len(raw)
                        if held >= 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The records of normalised archives, each read at its indexed offset; payload is null for revisits."""
    return archives.select("archive", "index").mapInArrow(_reader(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, offset long, length long, payload binary")


def check_whole(written: DataFrame, normalised: DataFrame) -> None:
    """Raises unless the normalised archives hold every record that was written, without a fault."""
    records = written.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    found, faults = normalised.agg(F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("faults"), F.lit(0))).first()
    if found != records or faults:
        raise ValueError(f"{records} records were written, {found} were found, and {faults} archives break off")


def round_trip(pages: DataFrame, min_payload_bytes: int = 0) -> DataFrame:
    """Writes pages to monolithic archives, normalises them and reads them back; raises if records were lost on the way."""
    spark = pages.sparkSession
    work = Work(spark, "warc")
    whole = work.table(write_archives(pages, f"{work.path}/monolithic", min_payload_bytes), "whole")
    n = max(1, whole.count())
    split = work.table(normalise_archives(whole.repartition(n), f"{work.path}/monolithic", f"{work.path}/records"), "split")
    check_whole(whole, split)
    return read_archives(split.repartition(n), f"{work.path}/records")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, b, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY sha1(b), octet_length(b)) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (k // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (k % 4))::INTEGER) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM d
"""
