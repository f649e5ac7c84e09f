"""Extensions: a registry of payload types by namespace, type and version, and what it says of each extension."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.operators.facts import canonical_json
from factlattice.plans import schema as schemas

LANES = ("exact", "patch", "minor", "major")


class RegistryError(ValueError):
    """A registry that contradicts itself."""


@dataclass(frozen=True)
class Entry:
    """A payload type; `accepts` are the lanes of other versions that it can read, `required` keys that mean something."""

    namespace: str
    type: str
    version: str
    schema: dict = field(default_factory=dict, hash=False)
    accepts: tuple[str, ...] = ("exact", "patch")
    required: tuple[str, ...] = ()
    digest: str | None = None


def schema_digest(entry: Entry) -> str:
    return hashlib.sha256(canonical_json(entry.schema).encode()).hexdigest()


class Registry:
    def __init__(self, entries: list[Entry]):
        keys = [(e.namespace, e.type, e.version) for e in entries]
        if len(set(keys)) != len(keys):
            raise RegistryError("two entries of one namespace, type and version")
        for e in entries:
            if not re.fullmatch(r"\d+\.\d+\.\d+", e.version) or not e.namespace or not e.type:
                raise RegistryError(f"{e.namespace}:{e.type} lacks an identity or a version of three numbers")
            if e.digest is not None and e.digest != schema_digest(e):
                raise RegistryError(f"{e.namespace}:{e.type} is not the schema that was registered")
            if not set(e.required) <= set(e.schema.get("required", ())) or not set(e.accepts) <= set(LANES):
                raise RegistryError(f"{e.namespace}:{e.type} needs keys that its schema does not, or accepts unknown lanes")
        self.entries = entries

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(e.namespace, e.type, e.version, list(e.accepts)) for e in self.entries]
        return spark.createDataFrame(rows, "namespace string, type string, known_version string, accepts array<string>")

    def build(self, extension_id: str, target_id: str, namespace: str, kind: str, payload: dict) -> dict:
        """An extension of the latest registered version, if its payload fits."""
        own = [e for e in self.entries if (e.namespace, e.type) == (namespace, kind)]
        if not own:
            raise RegistryError(f"{namespace}:{kind} is not registered")
        entry = max(own, key=lambda e: tuple(map(int, e.version.split("."))))
        wrong = next(schemas.violations(payload, entry.schema), None)
        if wrong:
            raise RegistryError(f"payload{wrong[0]}: {wrong[1]}")
        return {"extensionId": extension_id, "targetId": target_id, "namespace": namespace, "type": kind, "schemaVersion": entry.version, "criticality": "non-critical", "payload": payload}


def classify(extensions: DataFrame, registry: Registry) -> DataFrame:
    """Adds known_version, lane and verdict to (namespace, type, schema_version, criticality).

    lane compares with the latest registered version: exact, patch, minor, major or unknown. verdict is known,
    compatible (a lane that the entry accepts), opaque, or rejected where an extension is critical and not readable.
    """
    parts = lambda c: F.transform(F.split(c, r"\."), lambda x: x.try_cast("int"))
    latest = F.max_by(F.struct("known_version", "accepts"), parts(F.col("known_version")))
    table = registry.table(extensions.sparkSession)
    exact = table.select("namespace", "type", F.col("known_version").alias("schema_version"), F.lit(True).alias("is_exact"))
    best = table.groupBy("namespace", "type").agg(latest.alias("best"))
    rows = extensions.join(F.broadcast(exact), ["namespace", "type", "schema_version"], "left").join(F.broadcast(best), ["namespace", "type"], "left")  # a registry is written by hand
    own, known = parts(F.col("schema_version")), parts(F.col("best.known_version"))
    lane = (
        F.when(F.col("is_exact"), "exact").when(F.col("best").isNull() | ~F.col("schema_version").rlike(r"^\d+\.\d+\.\d+$"), "unknown")
        .when(own[0] != known[0], "major").when(own[1] != known[1], "minor").otherwise("patch")
    )
    rows = rows.withColumn("lane", lane)
    readable = F.coalesce(F.array_contains("best.accepts", F.col("lane")), F.lit(False))
    verdict = F.when(F.col("lane") == "exact", "known").when(readable, "compatible").when(F.coalesce(F.col("criticality"), F.lit("")) == "critical", "rejected").otherwise("opaque")
    return rows.withColumn("verdict", verdict).withColumn("known_version", F.when(F.col("is_exact"), F.col("schema_version")).otherwise(F.col("best.known_version"))).drop("is_exact", "best")


def payload_violations(extensions: DataFrame, registry: Registry) -> DataFrame:
    """(extension_id, pointer, keyword) of known extensions (extension_id, namespace, type, schema_version, payload) that do not fit their schema."""
    out = None
    for e in registry.entries:
        own = extensions.filter((F.col("namespace") == e.namespace) & (F.col("type") == e.type) & (F.col("schema_version") == e.version))
        found = schemas.check(own, e.schema, key="extension_id", text="payload")
        out = found if out is None else out.unionByName(found)
    return out


def payload_references(fields: DataFrame, entities: DataFrame, rules: list[tuple[str, str, str, tuple[str, ...], tuple[str, ...]]]) -> DataFrame:
    """(document_id, entity_id, pointer, fault) of payload pointers that must name entities.

    A rule is (namespace, type, pointer below /payload, collections, kinds); empty collections or kinds allow any.
    """
    extensions = entities.filter("collection = 'extensions'").select("document_id", "entity_id", F.get_json_object("payload", "$.namespace").alias("namespace"), F.get_json_object("payload", "$.type").alias("type"))
    spec = fields.sparkSession.createDataFrame([(n, t, f"/payload{p}", list(c), list(k)) for n, t, p, c, k in rules], "namespace string, type string, pointer string, collections array<string>, kinds array<string>")
    values = fields.filter("collection = 'extensions' AND value_type = 'string'").select("document_id", "entity_id", "pointer", F.col("value_string").alias("target_id"))
    owners = entities.select("document_id", F.col("entity_id").alias("target_id"), F.col("collection").alias("owner"), F.col("kind").alias("owner_kind"))
    # rules are written by hand; nothing tells how many entities come of a document, so no other join is broadcast
    rows = extensions.join(F.broadcast(spec), ["namespace", "type"]).hint("merge").join(values.hint("merge"), ["document_id", "entity_id", "pointer"]).join(owners.hint("merge"), ["document_id", "target_id"], "left")
    fault = (
        F.when(F.col("owner").isNull(), "dangling").when((F.size("collections") > 0) & ~F.array_contains("collections", F.col("owner")), "collection")
        .when((F.size("kinds") > 0) & ~F.coalesce(F.array_contains("kinds", F.col("owner_kind")), F.lit(False)), "kind")
    )
    return rows.withColumn("fault", fault).filter("fault IS NOT NULL").select("document_id", "entity_id", "pointer", "fault")


def profile_violations(fields: DataFrame, profiles: DataFrame) -> DataFrame:
    """(document_id, fault) of documents whose capability profile is not in (profile, format, version), or is for another format or version."""
    value = lambda p: F.max(F.when(F.col("pointer") == p, F.col("value_string")))
    stated = fields.filter("collection = '__document__'").groupBy("document_id").agg(value("/conversion/capabilityProfile").alias("profile"), value("/sourceFormat/name").alias("own_format"), value("/sourceFormat/version").alias("own_version"))
    rows = stated.join(F.broadcast(profiles), "profile", "left")  # profiles are written by hand
    fault = F.when(F.col("format").isNull(), "unknown profile").when(F.col("format") != F.col("own_format"), "another format").when(F.col("version").isNotNull() & (F.col("version") != F.col("own_version")), "another version")
    return rows.select("document_id", fault.alias("fault")).filter("fault IS NOT NULL")
