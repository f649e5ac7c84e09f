"""Canonical JSON, content digests and migrations of whole documents."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlattice.operators.facts import COLLECTIONS, Rows, canonical_json, sliced, strict_json, walk

# fixed values: what the content projection leaves out, and keys that no document may hold
LEFT_OUT = ("documentId", "sourceMaps", "diagnostics", "conversion", "observations")
FORBIDDEN = ("sourceBytes", "sourceByteStore", "contentAddressedSource", "semanticEquivalence", "EquivalenceCertificate", "LineageCertificate", "AccountingItem", "predicate")
_FORBIDDEN = frozenset(FORBIDDEN)
PROJECTIONS = ("full", "content", "source-map-excluded")
ID_LIMIT = 96


def project(document: dict, projection: str = "full") -> dict:
    if projection not in PROJECTIONS:
        raise ValueError(f"unknown projection: {projection}")
    gone = {"full": (), "content": LEFT_OUT, "source-map-excluded": ("sourceMaps",)}[projection]
    return {k: v for k, v in document.items() if k not in gone}


def normalise(value, key: str | None = None):
    """Entity collections sorted by id and `items` by ordinal; other lists keep their order. A fractional number or a forbidden key is an error."""
    if isinstance(value, dict):
        if not _FORBIDDEN.isdisjoint(value):
            raise ValueError("a forbidden key")
        return {k: v if type(v) is str else normalise(v, k) for k, v in value.items()}
    if isinstance(value, list):
        items = [v if type(v) is str else normalise(v) for v in value]
        if key in COLLECTIONS and all(isinstance(v, dict) for v in items):
            return sorted(items, key=lambda v: v[COLLECTIONS[key]])
        if key == "items" and all(isinstance(v, dict) and "ordinal" in v for v in items):
            return sorted(items, key=lambda v: v["ordinal"])
        return items
    if isinstance(value, float):
        raise ValueError("a fractional number")
    return value


def canonical_text(document: dict, projection: str = "full") -> str:
    kept = project(document, projection)
    try:
        made = normalise(kept)
        for key in document.keys() - kept.keys():
            normalise({key: document[key]})
    except (ValueError, KeyError, TypeError):
        _faultless(document)
        raise
    return canonical_json(made)


def _faultless(document: dict) -> None:
    """The first fractional number or forbidden key is an error that tells its place."""
    for pointer, _, value in walk(document):
        if isinstance(value, float):
            raise ValueError(f"{pointer}: a fractional number, which documents hold as decimal strings")
        if isinstance(value, dict) and (bad := [k for k in value if k in FORBIDDEN]):
            raise ValueError(f"{pointer}: forbidden key {bad[0]}")


def canonical_documents(documents: DataFrame, projection: str = "full") -> DataFrame:
    """document_id, canonical, digest, error of (document_id, ir_json)."""

    schema = "document_id string, canonical string, digest string, error string"

    def run(batches):
        out = Rows(schema, 1)
        for batch in sliced(batches):
            for document_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    made, error = canonical_text(strict_json(text), projection), None
                except (ValueError, KeyError, TypeError) as why:
                    made, error = None, str(why)[:200]
                out.add((document_id, made, hashlib.sha256(made.encode()).hexdigest() if made is not None else None, error))
                yield from out.batches()
        yield from out.batches(last=True)

    return documents.select("document_id", "ir_json").mapInArrow(run, schema)


def value_digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def content_id(digest: Column) -> Column:
    return F.substring(F.concat(F.lit("doc-"), digest), 1, ID_LIMIT)


def canonical_row(columns: dict[str, tuple[str, str]]) -> Column:
    """A table row as a canonical JSON object in the JVM: key -> (lane, column)."""
    parts = []
    for k, key in enumerate(sorted(columns, key=lambda k: k.encode("utf-16-be"))):
        kind, column = columns[key]
        text = F.col(column).cast("string")
        body = F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1) if kind == "string" else text
        parts += [F.lit(("," if k else "") + canonical_json(key) + ":"), F.when(F.col(column).isNull(), "null").otherwise(body)]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def records_digest(rows: DataFrame, row_digest: str, widths: tuple[int, ...] = (5, 2, 0)) -> DataFrame:
    """(records, records_digest): one digest over the ordered digests of all rows, whatever the partitioning.

    Digests are hashed in order within each prefix of widths[0] digits, then those hashes within each shorter prefix,
    until one is left. A task holds the digests of one prefix: a millionth of all at first, a few thousand later.
    """
    now = rows.select(F.col(row_digest).alias("key"), F.col(row_digest).alias("d"), F.lit(1).cast("long").alias("n"))
    for width in widths:
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("key", "d"))), lambda x: x["d"])
        now = now.groupBy(F.substring("key", 1, width).alias("prefix")).agg(F.sha2(F.concat_ws("\n", ordered), 256).alias("d"), F.sum("n").alias("n")).withColumnRenamed("prefix", "key")
    return now.select(F.col("n").alias("records"), F.col("d").alias("records_digest"))


def migrate_documents(documents: DataFrame, target: str = "1.0.0") -> DataFrame:
    """document_id, ir_json, status, dropped: the identity, or 0.9.0 to 1.0.0 without /legacyField; else failed."""

    def run(batches):
        for batch in batches:
            rows = ([], [], [])
            for text in batch.column(1).to_pylist():
                document = strict_json(text)
                version, dropped = (document.get("schema") or {}).get("version"), None
                if version == target:
                    status = "identity"
                elif (version, target) == ("0.9.0", "1.0.0"):
                    status = "migrated"
                    if "legacyField" in document:
                        del document["legacyField"]
                        dropped = "/legacyField"
                    document["schema"] = {**document["schema"], "version": target}
                else:
                    status = "failed"
                for column, value in zip(rows, (canonical_json(document), status, dropped)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in rows)], ["document_id", "ir_json", "status", "dropped"])

    return documents.select("document_id", "ir_json").mapInArrow(run, "document_id string, ir_json string, status string, dropped string")


def migrate_extensions(extensions: DataFrame, target: str, known: Column | None = None) -> DataFrame:
    """Adds migration, new_version and loss to (schema_version, has_legacy_range).

    1.0.0 to 1.1.0 is a new label; to 2.0.0 a legacyRange is dropped as a declared loss; 2.0.0 to 1.0.0 keeps what is
    there and fails; other steps are not registered. The same version is preserved, as opaque if the type is unknown.
    """
    own, goal = F.col("schema_version"), F.lit(target)
    keeps = F.when(known if known is not None else F.lit(True), "preserved").otherwise("opaque-preserved")
    lossy = (own == "1.0.0") & (goal == "2.0.0") & F.col("has_legacy_range")
    status = (
        F.when(lossy, "loss-declared")
        .when((own == goal) | ((own == "1.0.0") & goal.isin("1.1.0", "2.0.0")), keeps)
        .when((own == "2.0.0") & (goal == "1.0.0"), "failed")
        .otherwise("not-registered")
    )
    stays = F.col("migration").isin("failed", "not-registered")
    out = extensions.withColumn("migration", status).withColumn("new_version", F.when(stays, own).otherwise(goal))
    return out.withColumn("loss", F.when(lossy, "/payload/legacyRange").when(F.col("migration") == "failed", "unsupported-downgrade"))
