"""The document format as a JSON schema, and the query contract that follows from it."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlattice.operators.facts import COLLECTIONS, DOCUMENT
from factlattice.operators.index import unregistered
from factlattice.plans.contract import Contract
from factlattice.plans.schema import check

VERSION = "1"
#: Profiles that a document may state: (profile, format, version; null for any).
PROFILES = (("docx-1", "docx", None), ("xlsx-1", "xlsx", None), ("pdf-1", "pdf", None), ("markdown-1", "markdown", None))

STRING, INTEGER, BOOLEAN, OPEN = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}, {"type": "object", "additionalProperties": True}


def ref(name: str) -> dict:
    return {"$ref": f"#/definitions/{name}"}


def listed(items: dict) -> dict:
    return {"type": "array", "items": items}


def closed(required: str = "", **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": required.split(), "additionalProperties": False}


def any_of(*values: str) -> dict:
    return {"type": "string", "enum": list(values)}


def nullable(kind: str) -> dict:
    return {"type": [kind, "null"]}


ID, IDS, STATUS, DECIMAL, LENGTH = ref("id"), listed(ref("id")), ref("status"), ref("decimal"), ref("length")
#: Values whose lane their `type` decides; that the two agree is a rule of its own.
TYPED = closed("type status", type=STRING, value={"type": ["string", "boolean", "null"]}, status=STATUS, unit=STRING)
POINT = closed("x y", x=DECIMAL, y=DECIMAL)
SEGMENT = {"type": "object", "properties": {"kind": any_of("move", "line", "bezier", "close"), "to": POINT, "points": listed(POINT)}, "required": ["kind"]}
ANCHOR = closed("kind", kind=STRING, nodeId=ID, surfaceId=ID, gridId=ID, offset=STRING)
TRACE, PROVENANCE = listed(closed("property source action", property=STRING, source=ID, action=STRING)), listed(closed("property source status", property=STRING, source=ID, status=STATUS))

DEFINITIONS = {
    "id": {"type": "string", "pattern": r"^[A-Za-z][A-Za-z0-9_.:/-]*$", "maxLength": 96},
    "status": any_of("preserved", "normalized", "approximated", "ambiguous", "unsupported", "omitted-by-policy", "unavailable", "failed"),
    "decimal": {"type": "string", "pattern": r"^-?(0|[1-9][0-9]*)(\.[0-9]*[1-9])?$"},
    "length": closed("value unit", value=DECIMAL, unit=any_of("emu", "pt", "percent", "deg")),
    "typedValue": TYPED,
}

#: Properties of the entities of each collection beside their id.
ENTITIES: dict[str, tuple[str, dict[str, dict]]] = {
    "parts": ("kind rootNodeIds", {"kind": STRING, "name": STRING, "parentPartId": ID, "rootNodeIds": IDS, "relationshipIds": IDS, "surfaceIds": IDS, "status": STATUS}),
    "surfaces": ("partId kind ordinal", {"partId": ID, "kind": any_of("page", "sheet", "story"), "ordinal": INTEGER, "coordinateSpaceId": ID, "gridId": ID, "box": listed(DECIMAL), "sectionBoundary": STRING, "layoutIds": IDS, "status": STATUS}),
    "nodes": (
        "kind partId childIds status",
        {
            "kind": STRING, "partId": ID, "parentId": ID, "childIds": IDS, "status": STATUS, "textIds": IDS, "styleIds": IDS, "layoutIds": IDS, "annotationIds": IDS, "resourceIds": IDS, "directStyleId": ID, "resolvedStyleId": ID, "geometryId": ID,
            "formulaId": ID, "fieldId": ID, "address": closed("row column", row=INTEGER, column=INTEGER), "value": ref("typedValue"), "visibility": any_of("visible", "hidden", "veryHidden"), "title": STRING, "gridSpan": INTEGER,
            "mergeRole": any_of("master", "follower"), "mergeId": STRING,
        },
    ),
    "texts": ("representation value status", {"representation": any_of("source", "normalized", "displayed", "stored", "cached", "computed", "observed"), "provenance": any_of("authored", "derived"), "value": STRING, "sourceTextId": ID, "status": STATUS}),
    "tables": ("nodeId rowIds columnIds cellIds status", {"nodeId": ID, "rowIds": IDS, "columnIds": IDS, "cellIds": IDS, "mergedRanges": listed(STRING), "gridColumns": listed(INTEGER), "alignment": listed(STRING), "status": STATUS}),
    "styles": (
        "role origin status",
        {
            "role": any_of("paragraph", "run", "cell"), "origin": any_of("named", "resolved", "direct", "component", "conditional"), "name": STRING, "basedOn": ID, "declaration": OPEN, "direct": OPEN, "resolved": OPEN, "resolvedFrom": IDS,
            "cascadeTrace": TRACE, "propertyProvenance": PROVENANCE, "conditional": listed(closed("ruleId priority", ruleId=ID, condition=STRING, style=OPEN, priority=INTEGER)), "status": STATUS,
        },
    ),
    "layouts": (
        "targetId placement anchor status",
        {"targetId": ID, "placement": any_of("inline", "floating"), "anchor": ANCHOR, "declaredGeometryId": ID, "clipGeometryIds": IDS, "wrap": STRING, "zIndex": INTEGER, "transform": closed("a b c d e f", **dict.fromkeys("abcdef", DECIMAL)), "status": STATUS},
    ),
    "coordinateSpaces": ("unit", {"unit": any_of("emu", "pt"), "origin": POINT, "parentSpaceId": ID}),
    "geometries": (
        "spaceId kind primitives status",
        {"spaceId": ID, "kind": STRING, "primitives": listed(closed("kind", kind=STRING, x=DECIMAL, y=DECIMAL, width=LENGTH, height=LENGTH, rotation=LENGTH, segments=listed(SEGMENT))), "status": STATUS},
    ),
    "resources": (
        "kind availability",
        {
            "kind": STRING, "mediaType": STRING, "availability": any_of("available", "missing", "unavailable"), "name": STRING, "subtype": STRING, "encoding": STRING, "unicodeMap": BOOLEAN, "embeddedOrExternal": any_of("external", "linked", "embedded"),
            "decodability": STRING, "packagePresence": BOOLEAN, "networkAvailability": STRING, "derivedHandle": STRING, "externalTarget": STRING,
        },
    ),
    "formulas": (
        "ownerCellId kind expression values status",
        {
            "ownerCellId": ID, "kind": STRING, "expression": closed("source language", source=STRING, language=STRING), "numberFormat": closed("code", code=STRING), "status": STATUS,
            "values": closed("raw stored cached computed displayed", **dict.fromkeys(("raw", "stored", "cached", "computed"), ref("typedValue")), displayed=closed("text status", text=nullable("string"), status=STATUS)),
            "calculationContext": closed("dateSystem", dateSystem=any_of("1900", "1904"), mode=STRING, referenceStyle=STRING),
        },
    ),
    "fields": ("ownerNodeId instructionTextId resultTextId status", {"ownerNodeId": ID, "instructionTextId": ID, "resultTextId": ID, "status": STATUS}),
    "annotations": (
        "kind targetIds status",
        {
            "kind": STRING, "targetIds": IDS, "body": STRING, "bodyNodeId": ID, "bodyTextId": ID, "referenceId": STRING, "displayText": STRING, "sourceSubtype": STRING, "quadPoints": listed(DECIMAL), "status": STATUS,
            "place": closed("address resolved", address=STRING, resolved=BOOLEAN), "destination": closed("", name=STRING, surfaceId=ID, view=STRING, position=listed(nullable("string"))),
        },
    ),
    "relations": ("kind fromId toId status", {"kind": STRING, "fromId": ID, "toId": ID, "type": STRING, "target": STRING, "targetMode": any_of("internal", "external"), "endpoint": any_of("start", "to"), "sourceOccurrenceId": STRING, "status": STATUS}),
    "orders": ("kind ownerId items status", {"kind": STRING, "ownerId": ID, "items": listed(closed("id ordinal", id=ID, ordinal=INTEGER)), "status": STATUS}),
    "observations": ("kind targetId status", {"kind": STRING, "targetId": ID, "engine": STRING, "method": STRING, "status": STATUS}),
    "extensions": ("targetId namespace type schemaVersion payload", {"targetId": ID, "namespace": STRING, "type": STRING, "schemaVersion": STRING, "criticality": any_of("critical", "non-critical"), "payload": OPEN}),
    "sourceMaps": ("targetId format locator", {"targetId": ID, "format": closed("name", name=STRING), "locator": OPEN}),
    "diagnostics": ("code severity message", {"code": STRING, "severity": any_of("info", "warning", "error", "fatal"), "phase": STRING, "message": STRING, "targetId": ID}),
}
FEATURE = {"feature": STRING, "status": STATUS, "diagnosticIds": IDS}
SURFACE = {
    "schema": closed("name version", name=STRING, version=STRING), "documentId": ID, "sourceFormat": closed("namespace name version", namespace=STRING, name=STRING, version=STRING), "rootNodeId": ID,
    "conversion": closed(
        "status capabilityProfile features featureInventory", status=any_of("complete", "complete-with-warnings", "partial", "failed"), capabilityProfile=STRING, features=listed(closed("feature status", **FEATURE, targetId=ID)),
        featureInventory=listed(closed("feature status occurrences disposition", **FEATURE, occurrences=INTEGER, disposition=STRING)), warnings=IDS, diagnostics=IDS,
    ),
}


def entity_schema(collection: str) -> dict:
    required, properties = ENTITIES[collection]
    key = COLLECTIONS[collection]
    return closed(f"{key} {required}", **{key: ID, **properties})


@cache
def document_schema() -> dict:
    """The whole document; collections without entities may be absent."""
    return closed(" ".join(SURFACE), **SURFACE, **{c: listed(entity_schema(c)) for c in COLLECTIONS})


@cache
def document_contract() -> Contract:
    """All fields of the format: those of the document itself and of the entities of each collection."""
    schemas = {c: entity_schema(c) for c in COLLECTIONS} | {DOCUMENT: closed("", **SURFACE)}
    return Contract.from_schemas(schemas, DEFINITIONS, version=VERSION, profiles=tuple(p for p, _, _ in PROFILES))


def schema_violations(documents: DataFrame) -> DataFrame:
    """(document_id, pointer, keyword) of documents (document_id, ir_json) that do not have the format."""
    return check(documents, document_schema(), DEFINITIONS)


def document_profiles(fields: DataFrame) -> DataFrame:
    """(document_id, profile) that documents state."""
    stated = fields.filter((F.col("collection") == DOCUMENT) & (F.col("pointer") == "/conversion/capabilityProfile"))
    return stated.select("document_id", F.col("value_string").alias("profile"))


def known_profiles(fields: DataFrame) -> DataFrame:
    return fields.sparkSession.createDataFrame(list(PROFILES), "profile string, format string, version string")


def coverage(fields: DataFrame, contract: Contract) -> DataFrame:
    """(collection, template, registered, n) of observed pointers, list positions as *."""
    seen = fields.filter("pointer != ''").groupBy("collection", F.regexp_replace("pointer", "/[0-9]+(?=/|$)", "/*").alias("template")).agg(F.count(F.lit(1)).alias("n"))
    missing = unregistered(fields, contract).withColumn("registered", F.lit(False))
    return seen.join(missing, ["collection", "template"], "left").select("collection", "template", F.coalesce("registered", F.lit(True)).alias("registered"), "n")
