"""Files to documents: one bad file is one failed document, never a failed job."""

from __future__ import annotations

import hashlib
import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.operators import facts
from factlattice.operators.facts import Rows, sliced
from factlattice.sources import markdown, pdf, spreadsheet, word
from factlattice.sources.ir import Limits, SourceError, failed_document, to_json

EXTENSIONS = {"docx": "docx", "xlsx": "xlsx", "pdf": "pdf", "md": "markdown", "markdown": "markdown"}
ADAPTERS = {"docx": word.convert, "xlsx": spreadsheet.convert, "pdf": pdf.convert, "markdown": markdown.convert}
SCHEMA = "path string, format string, input_sha256 string, input_bytes long, outcome string, error string, elapsed_ms double, document_id string, ir_json string"


def detect_format(path: Column, explicit: str | None = None) -> Column:
    """The format by extension, or the one given; null for a file of none of them."""
    if explicit is not None:
        if explicit not in ADAPTERS:
            raise ValueError(f"unknown format: {explicit}")
        return F.lit(explicit)
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return table[F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))]


def convert_bytes(raw: bytes, source: str, limits: Limits, profile: str | None = None) -> tuple[dict, str, str | None]:
    """(document, outcome, error) of one file."""
    digest = hashlib.sha256(raw).hexdigest()
    try:
        if len(raw) > limits.input_bytes:
            raise SourceError(f"longer than {limits.input_bytes} bytes")
        document = ADAPTERS[source](raw, limits, profile) if profile else ADAPTERS[source](raw, limits)
        return document, document["conversion"]["status"], None
    except Exception as error:  # a source may break a decoder in any way
        return failed_document(source, "unknown", f"{type(error).__name__}: {error}", digest), "failed", f"{type(error).__name__}: {error}"[:300]


def convert_files(files: DataFrame, limits: Limits | None = None, explicit: str | None = None, profile: str | None = None) -> DataFrame:
    """(path, format, input_sha256, input_bytes, outcome, error, elapsed_ms, document_id, ir_json) of (path, content)."""
    limits = limits or Limits()

    def run(batches):
        out = Rows(SCHEMA, 8)
        for batch in sliced(batches):
            for path, source, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                began = time.perf_counter()
                document, outcome, error = convert_bytes(content, source, limits, profile)
                out.add((path, source, hashlib.sha256(content).hexdigest(), len(content), outcome, error, 1000 * (time.perf_counter() - began), document["documentId"], to_json(document)))
                yield from out.batches()
        yield from out.batches(last=True)

    return files.select("path", detect_format(F.col("path"), explicit).alias("format"), "content").filter("format IS NOT NULL").mapInArrow(run, SCHEMA)


ENTITY_SCHEMA = f"path string, outcome string, {facts.ENTITY_SCHEMA}"


def convert_entities(files: DataFrame, collections: list[str] | None = None, limits: Limits | None = None, explicit: str | None = None, profile: str | None = None) -> DataFrame:
    """(path, outcome) and the entities of each file of (path, content), of some collections if they are named.

    The same rows as `facts.entities` of the converted documents, without writing and parsing each document between the two.
    """
    limits, wanted = limits or Limits(), None if collections is None else frozenset(collections)

    def run(batches):
        out = Rows(ENTITY_SCHEMA, 8)
        for batch in sliced(batches):
            for path, source, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                document, outcome, _ = convert_bytes(content, source, limits, profile)
                for collection, entity_id, kind, status, ordinal, entity in facts.split_document(document, wanted):
                    out.add((path, outcome, document["documentId"], collection, entity_id, kind, status, ordinal, facts.canonical_json(entity)))
                yield from out.batches()
        yield from out.batches(last=True)

    return files.select("path", detect_format(F.col("path"), explicit).alias("format"), "content").filter("format IS NOT NULL").mapInArrow(run, ENTITY_SCHEMA)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files of a folder that have a known extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(detect_format(F.col("path")).isNotNull()).select("path", "content")


def rejected(files: DataFrame) -> DataFrame:
    """Files of no known format."""
    return files.filter(detect_format(F.col("path")).isNull()).select("path")


def inspect_files(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(path, format, bytes, units, readable): parts of packages, pages of PDFs, lines of Markdown."""
    limits = limits or Limits()

    def units(raw: bytes, source: str) -> int:
        from factlattice.sources.containers import Package

        return len(pdf.File(raw, limits).pages()) if source == "pdf" else len(Package(raw, limits).names) if source in ("docx", "xlsx") else len(markdown.split_lines(raw.decode()))

    def run(batches):
        for batch in batches:
            rows = []
            for path, source, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                try:
                    found, fine = units(content, source), len(content) <= limits.input_bytes
                except Exception:
                    found, fine = 0, False
                rows.append({"path": path, "format": source, "bytes": len(content), "units": found, "readable": fine})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("format", pa.string()), ("bytes", pa.int64()), ("units", pa.int64()), ("readable", pa.bool_())]))

    return files.select("path", detect_format(F.col("path")).alias("format"), "content").filter("format IS NOT NULL").mapInArrow(run, "path string, format string, bytes long, units long, readable boolean")


def check_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, fault) of files against a manifest (path, sha256): missing, unlisted or changed."""
    have = files.select("path", F.sha2("content", 256).alias("have"))
    both = have.join(manifest.select("path", F.col("sha256").alias("stated")), "path", "full")
    fault = F.when(F.col("have").isNull(), "missing").when(F.col("stated").isNull(), "unlisted").when(F.col("have") != F.col("stated"), "changed")
    return both.select("path", fault.alias("fault")).filter("fault IS NOT NULL")
