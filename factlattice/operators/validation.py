"""Violations of the document rules, one row each: document_id, rule, code, entity_id, detail.

Rules run over all documents at once on the tables of `facts`; the first error of a document is that with the least
rule number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlattice.functions.pointers import template_condition
from factlattice.operators.canonical import FORBIDDEN
from factlattice.operators.extensions import profile_violations
from factlattice.operators.facts import COLLECTIONS, DOCUMENT
from factlattice.operators.trees import cyclic, node_edges, reachability
from factlattice.plans.document import known_profiles, schema_violations

# fixed values of the document format
STATUSES = ("preserved", "normalized", "approximated", "ambiguous", "unsupported", "omitted-by-policy", "unavailable", "failed")
PARTIAL = ("approximated", "ambiguous", "unsupported", "omitted-by-policy", "failed")
CONVERSIONS = ("complete", "complete-with-warnings", "partial", "failed")
NODE_KINDS = (
    "document", "section", "story", "footnote", "endnote", "comment", "paragraph", "run", "heading", "thematicBreak", "list", "table", "row",
    "column", "cell", "shape", "textBox", "connector", "image", "chart", "glyph", "path", "field", "annotation", "resource",
)
VISUAL_KINDS = ("shape", "textBox", "connector", "image", "chart", "glyph", "path")
#: Keys that a node of a kind must not have. Fixed values of the document format.
NODE_FORBIDDEN = {
    "document": ("address", "geometryId", "formulaId", "fieldId", "directStyleId", "resolvedStyleId"),
    "paragraph": ("address", "geometryId", "formulaId"), "heading": ("address", "geometryId", "formulaId"),
    "run": ("address", "geometryId", "formulaId", "fieldId"), "row": ("address", "geometryId", "formulaId"),
    "column": ("address", "geometryId", "formulaId", "fieldId"), "table": ("address", "geometryId", "formulaId"),
}
#: (collection, pointer template, collections that the value may name, node kinds it may name). Fixed values of the document format.
REFERENCE_RULES = (
    ("nodes", "/parentId", ("nodes",), ()), ("nodes", "/childIds/*", ("nodes",), ()), ("nodes", "/partId", ("parts",), ()),
    ("nodes", "/geometryId", ("geometries",), ()), ("nodes", "/formulaId", ("formulas",), ()), ("nodes", "/fieldId", ("fields",), ()),
    ("nodes", "/directStyleId", ("styles",), ()), ("nodes", "/resolvedStyleId", ("styles",), ()), ("nodes", "/textIds/*", ("texts",), ()),
    ("nodes", "/styleIds/*", ("styles",), ()), ("nodes", "/layoutIds/*", ("layouts",), ()), ("nodes", "/annotationIds/*", ("annotations",), ()),
    ("nodes", "/resourceIds/*", ("resources",), ()), ("parts", "/rootNodeIds/*", ("nodes",), ()), ("parts", "/surfaceIds/*", ("surfaces",), ()),
    ("parts", "/relationshipIds/*", ("relations",), ()), ("parts", "/parentPartId", ("parts",), ()), ("surfaces", "/partId", ("parts",), ()),
    ("surfaces", "/coordinateSpaceId", ("coordinateSpaces",), ()), ("surfaces", "/gridId", ("nodes",), ()), ("surfaces", "/layoutIds/*", ("layouts",), ()),
    ("tables", "/nodeId", ("nodes",), ("table", "section")), ("tables", "/rowIds/*", ("nodes",), ("row",)), ("tables", "/columnIds/*", ("nodes",), ("column",)),
    ("tables", "/cellIds/*", ("nodes",), ("cell",)), ("styles", "/basedOn", ("styles",), ()), ("styles", "/resolvedFrom/*", ("styles",), ()),
    ("styles", "/cascadeTrace/*/source", ("styles",), ()), ("styles", "/propertyProvenance/*/source", ("styles",), ()), ("layouts", "/targetId", ("nodes",), ()),
    ("layouts", "/surfaceId", ("surfaces",), ()), ("layouts", "/declaredGeometryId", ("geometries",), ()), ("layouts", "/resolvedGeometryId", ("geometries",), ()),
    ("layouts", "/clipGeometryIds/*", ("geometries",), ()), ("layouts", "/anchor/surfaceId", ("surfaces",), ()), ("layouts", "/anchor/nodeId", ("nodes",), ()),
    ("layouts", "/anchor/gridId", ("nodes",), ()), ("coordinateSpaces", "/parentSpaceId", ("coordinateSpaces",), ()), ("geometries", "/spaceId", ("coordinateSpaces",), ()),
    ("resources", "/sourceRelationshipId", ("relations",), ()), ("formulas", "/ownerCellId", ("nodes",), ("cell",)), ("fields", "/ownerNodeId", ("nodes",), ()),
    ("fields", "/instructionTextId", ("texts",), ()), ("fields", "/resultTextId", ("texts",), ()), ("annotations", "/targetIds/*", ("nodes", "resources"), ()),
    ("annotations", "/bodyNodeId", ("nodes",), ()), ("annotations", "/bodyTextId", ("texts",), ()), ("relations", "/fromId", (), ()), ("relations", "/toId", (), ()),
    ("orders", "/ownerId", ("parts", "surfaces", "nodes"), ()), ("orders", "/items/*/id", (), ()), ("observations", "/targetId", ("nodes", "texts", "geometries", "resources"), ()),
    ("observations", "/textId", ("texts",), ()), ("observations", "/geometryId", ("geometries",), ()), ("sourceMaps", "/targetId", (), ()),
    ("diagnostics", "/targetId", (), ()), ("diagnostics", "/sourceMapId", ("sourceMaps",), ()), ("diagnostics", "/relatedIds/*", (), ()),
    (DOCUMENT, "/conversion/diagnostics/*", ("diagnostics",), ()), (DOCUMENT, "/conversion/warnings/*", ("diagnostics",), ()),
    (DOCUMENT, "/conversion/features/*/diagnosticIds/*", ("diagnostics",), ()), (DOCUMENT, "/conversion/featureInventory/*/diagnosticIds/*", ("diagnostics",), ()),
)
#: Keys of colours, geometry primitives, path segments and anchors by their kind: those that must be there, and those
#: that may be there beside them and `kind`. Fixed values of the document format.
VARIANTS = {
    "color": {
        "rgb": {"required": ["r", "g", "b"], "optional": ["a"]},
        "gray": {"required": ["gray"], "optional": ["a"]},
        "cmyk": {"required": ["c", "m", "y", "k"], "optional": ["a"]},
        "theme": {"required": ["slot"], "optional": ["themeId", "a"]},
    },
    "primitive": {
        "point": {"required": ["x", "y"], "optional": []},
        "line": {"required": ["x", "y", "points"], "optional": []},
        "polyline": {"required": ["points"], "optional": []},
        "polygon": {"required": ["points"], "optional": []},
        "rectangle": {"required": ["x", "y", "width", "height"], "optional": []},
        "rotatedRectangle": {"required": ["x", "y", "width", "height", "rotation"], "optional": []},
        "bezier": {"required": ["segments"], "optional": ["arrowhead"]},
        "clip": {"required": ["segments"], "optional": []},
        "arrowhead": {"required": ["arrowhead"], "optional": []},
    },
    "segment": {
        "move": {"required": ["to"], "optional": []},
        "line": {"required": ["to"], "optional": []},
        "bezier": {"required": ["points"], "optional": []},
        "close": {"required": [], "optional": []},
    },
    "anchor": {
        "inline": {"required": ["nodeId"], "optional": []},
        "page": {"required": ["surfaceId"], "optional": []},
        "paragraph": {"required": ["nodeId"], "optional": []},
        "cell-range": {"required": ["gridId", "from", "to"], "optional": ["moveWithCells", "sizeWithCells"]},
        "floating": {"required": ["surfaceId"], "optional": ["offset"]},
        "endpoint-pair": {"required": ["nodeId"], "optional": []},
    },
}

RULES = (
    "SCHEMA", "PROFILE", "ID-DUPLICATE", "STATUS-INVALID", "FORBIDDEN-KEY", "FRACTIONAL-NUMBER", "DISCRIMINATOR-REQUIRED", "DISCRIMINATOR-FORBIDDEN", "ROOT-MISSING", "ROOT-KIND",
    "ROOT-PARENT", "NODE-KIND", "DUPLICATE-MEMBER", "REFERENCE-DANGLING", "REFERENCE-COLLECTION", "REFERENCE-KIND", "MULTIPLE-PARENT", "RECIPROCITY", "ORPHAN",
    "UNREACHABLE", "RUN-TEXT-MISSING", "CELL-ADDRESS-MISSING", "GEOMETRY-MISSING", "NODE-VARIANT", "TYPED-VALUE", "PART-CYCLE", "STYLE-CYCLE", "SPACE-CYCLE",
    "TABLE-CONTAINMENT", "ORDER-DUPLICATE", "CONNECTOR-ENDPOINT", "CONVERSION-STATUS", "COMPLETE-CLAIM", "WARNING-STATUS", "FAILED-NO-ERROR", "PARTIAL-NO-EVIDENCE", "INVENTORY-MISMATCH",
)


def _violation(rows: DataFrame, code: str, detail: Column | None = None) -> DataFrame:
    return rows.select("document_id", F.lit(RULES.index(code)).alias("rule"), F.lit(code).alias("code"), "entity_id", (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def _violations(rows: DataFrame, *faults: tuple[str, Column, Column | None]) -> DataFrame:
    """_violation() for each (code, condition, detail) that holds, reading the rows once."""
    told = [F.when(condition, F.struct(F.lit(RULES.index(code)).alias("rule"), F.lit(code).alias("code"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))) for code, condition, detail in faults]
    found = rows.select("document_id", "entity_id", F.inline(F.array_compact(F.array(*told))))
    return found.select("document_id", "rule", "code", "entity_id", "detail")


def duplicate_ids(entities: DataFrame) -> DataFrame:
    ids = entities.filter(F.col("collection") != DOCUMENT).groupBy("document_id", "entity_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _violation(ids, "ID-DUPLICATE", F.col("n"))


def reference_values(fields: DataFrame) -> DataFrame:
    """Values that must name an entity, with the collections and kinds they may name (empty: any)."""
    rules = fields.sparkSession.createDataFrame([(c, p, list(t), list(k)) for c, p, t, k in REFERENCE_RULES], "collection string, template string, targets array<string>, kinds array<string>")
    strings = fields.filter(F.col("value_type") == "string").withColumn("template", F.regexp_replace("pointer", "/[0-9]+(?=/|$)", "/*"))
    found = strings.join(F.broadcast(rules), ["collection", "template"])  # a table of some sixty rules
    return found.select("document_id", "entity_id", "pointer", F.col("value_string").alias("target_id"), "targets", "kinds")


#: The pointers that `reference_values` reads, as a regular expression.
REFERENCE_POINTERS = "^(" + "|".join(sorted({p.replace("*", "[0-9]+") for _, p, _, _ in REFERENCE_RULES})) + ")$"


def broken_references(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """Dangling references, and those to another collection or kind of node than they may name."""
    values = reference_values(fields)
    owners = entities.filter(F.col("collection") != DOCUMENT).select("document_id", F.col("entity_id").alias("target_id"), F.col("collection").alias("owner"), F.col("kind").alias("owner_kind"))
    joined = values.hint("merge").join(owners.hint("merge"), ["document_id", "target_id"], "left")  # nothing tells how many entities come of a document
    wrong = (F.size("targets") > 0) & ~F.array_contains("targets", F.col("owner"))
    code = F.when(F.col("owner").isNull(), "REFERENCE-DANGLING").when(wrong, "REFERENCE-COLLECTION").when((F.size("kinds") > 0) & ~F.coalesce(F.array_contains("kinds", F.col("owner_kind")), F.lit(False)), "REFERENCE-KIND")
    found = joined.withColumn("code", code).filter("code IS NOT NULL")
    number = F.create_map(*[x for k, c in enumerate(RULES) for x in (F.lit(c), F.lit(k))])
    return found.select("document_id", number[F.col("code")].alias("rule"), "code", "entity_id", F.concat_ws(" ", "pointer", "target_id").alias("detail"))


def reciprocity(fields: DataFrame) -> DataFrame:
    """Parent edges without the child edge, and child edges without the parent edge."""
    down, up = template_condition(F.col("pointer"), "/childIds/*"), F.col("pointer") == "/parentId"
    edges = fields.filter((F.col("collection") == "nodes") & (F.col("value_type") == "string") & (down | up))
    edge = lambda whole, part: F.when(up, F.col(whole)).otherwise(F.col(part))
    both = edges.groupBy("document_id", edge("entity_id", "value_string").alias("child"), edge("value_string", "entity_id").alias("parent")).agg(F.count_if(up).alias("up"), F.count_if(down).alias("down"))
    alone = both.filter("up = 0 OR down = 0").withColumn("entity_id", F.explode(F.array_repeat("child", (F.col("up") + F.col("down")).cast("int"))))  # an edge stated twice is two faults
    return _violation(alone, "RECIPROCITY", F.concat(F.col("parent"), F.when(F.col("up") == 0, " has no parentId back").otherwise(" does not list it")))


def variants(fields: DataFrame) -> DataFrame:
    """Colours, primitives, segments and anchors with keys that their kind lacks or does not allow."""
    kinds = fields.filter("value_type = 'string' AND pointer LIKE '%/kind'").select("document_id", "collection", "entity_id", F.regexp_replace("pointer", "/kind$", "").alias("at"), F.col("value_string").alias("kind"))
    place = (
        F.when(F.col("at").rlike("/segments/[0-9]+$"), "segment").when(F.col("at").rlike("/primitives/[0-9]+$"), "primitive").when(F.col("at").endswith("/anchor"), "anchor")
        .when(F.col("kind").isin(*VARIANTS["color"]), "color")
    )
    rows = [(place, kind, ["kind", *keys["required"], *keys["optional"]], keys["required"]) for place, own in VARIANTS.items() for kind, keys in own.items()]
    spec = fields.sparkSession.createDataFrame(rows, "place string, kind string, allowed array<string>, required array<string>")
    kinds = kinds.withColumn("place", place).filter("at != ''").join(F.broadcast(spec), ["place", "kind"])
    keys = fields.filter("depth > 0").select("document_id", "collection", "entity_id", F.regexp_replace("pointer", "/[^/]*$", "").alias("at"), F.element_at(F.split("pointer", "/"), -1).alias("key"))
    own = kinds.join(keys, ["document_id", "collection", "entity_id", "at"]).groupBy("document_id", "collection", "entity_id", "at", "kind").agg(F.collect_set("key").alias("keys"), F.first("allowed").alias("allowed"), F.first("required").alias("required"))
    missing, extra = F.array_except("required", "keys"), F.array_except("keys", "allowed")
    say = lambda x: F.concat_ws(" ", "at", "kind", F.array_join(F.sort_array(x), ","))
    return _violation(own.filter(F.size(missing) > 0), "DISCRIMINATOR-REQUIRED", say(missing)).unionByName(_violation(own.filter(F.size(extra) > 0), "DISCRIMINATOR-FORBIDDEN", say(extra)))


def canonical_decimal(text: Column) -> Column:
    """Whether a string is a decimal in its one canonical spelling: no exponent, plus, leading or trailing zero, or -0."""
    return text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]*[1-9])?$") & (text != "-0")


def typed_values(fields: DataFrame) -> DataFrame:
    """Typed values (type beside value) whose lane or spelling does not fit their type."""
    at = F.regexp_replace("pointer", "/(type|value)$", "")
    inside = (F.col("collection") == "nodes") & F.col("pointer").isin("/value/type", "/value/value") | (F.col("collection") == "formulas") & F.col("pointer").rlike("^/values/(raw|stored|cached|computed)/(type|value)$")
    rows = fields.filter(inside).withColumn("at", at)
    is_type = F.col("pointer").endswith("/type")
    pairs = rows.groupBy("document_id", "collection", "entity_id", "at").agg(
        F.collect_list(F.when(is_type, F.struct(F.col("value_string").alias("type")))).alias("types"), F.collect_list(F.when(~is_type, F.struct("value_type", "value_string"))).alias("values")
    )
    pairs = pairs.select("document_id", "collection", "entity_id", "at", "values", F.inline("types"))
    found = pairs.select("document_id", "collection", "entity_id", "at", "type", F.inline_outer("values"))
    lane, text = F.coalesce("value_type", F.lit("null")), F.col("value_string")
    fault = (
        F.when((F.col("type") == "blank") & (lane != "null"), "blank value is not null")
        .when((F.col("type") == "boolean") & (lane != "boolean"), "boolean value is not boolean")
        .when(F.col("type").isin("integer", "number", "decimal") & ~lane.isin("integer", "number", "string"), "numeric value of another lane")
        .when((F.col("type") == "integer") & (lane == "number"), "integer value is fractional")
        .when((F.col("type") == "integer") & (lane == "string") & ~text.rlike(r"^(0|-?[1-9][0-9]*)$"), "integer is not exact")
        .when(F.col("type").isin("number", "decimal") & (lane == "string") & ~canonical_decimal(text), "decimal is not canonical")
        .when(F.col("type").isin("string", "date", "datetime", "error") & ~lane.isin("null", "string"), "textual value is not a string")
    )
    return _violation(found.withColumn("fault", fault).filter("fault IS NOT NULL"), "TYPED-VALUE", F.concat_ws(" ", "at", "fault"))


def _has(pointer: str) -> Column:
    return F.get_json_object("payload", "$." + pointer.strip("/").replace("/", ".")).isNotNull()


def node_rules(entities: DataFrame, fields: DataFrame) -> DataFrame:
    nodes = entities.filter("collection = 'nodes'")
    texts = F.coalesce(F.get_json_object("payload", "$.textIds"), F.lit("[]"))
    status = F.coalesce("status", F.lit(""))
    banned = F.create_map(*[x for k, v in NODE_FORBIDDEN.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    bad = F.array_intersect(F.json_object_keys("payload"), F.coalesce(banned[F.col("kind")], F.array().cast("array<string>")))
    out = _violations(
        nodes.withColumn("bad", bad),
        ("NODE-KIND", F.col("kind").isNull() | ~F.col("kind").isin(*NODE_KINDS), F.col("kind")),
        ("RUN-TEXT-MISSING", (F.col("kind") == "run") & (texts == "[]") & ~status.isin("unsupported", "omitted-by-policy"), None),
        ("CELL-ADDRESS-MISSING", (F.col("kind") == "cell") & ~_has("/address"), None),
        ("GEOMETRY-MISSING", F.col("kind").isin(*VISUAL_KINDS) & ~_has("/geometryId"), None),
        ("NODE-VARIANT", F.size("bad") > 0, F.array_join("bad", ",")),
    )
    lists = fields.filter((F.col("collection") == "nodes") & F.col("pointer").rlike("^/(childIds|textIds|styleIds|layoutIds|annotationIds|resourceIds)/[0-9]+$"))
    twice = lists.groupBy("document_id", "entity_id", F.regexp_replace("pointer", "/[0-9]+$", "").alias("list"), "value_json").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return out.unionByName(_violation(twice, "DUPLICATE-MEMBER", F.col("list")))


def order_rules(fields: DataFrame) -> DataFrame:
    items = fields.filter((F.col("collection") == "orders") & F.col("pointer").rlike("^/items/[0-9]+/(id|ordinal)$"))
    twice = items.groupBy("document_id", "entity_id", F.element_at(F.split("pointer", "/"), -1).alias("key"), "value_json").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _violation(twice, "ORDER-DUPLICATE", F.concat_ws(" ", "key", "value_json"))


def table_containment(entities: DataFrame, fields: DataFrame) -> DataFrame:
    """Rows and columns that are not children of their table's node, cells that are not children of its rows."""
    member = fields.filter((F.col("collection") == "tables") & F.col("pointer").rlike("^/(rowIds|columnIds|cellIds)/[0-9]+$")).select("document_id", "entity_id", F.element_at(F.split("pointer", "/"), 2).alias("role"), F.col("value_string").alias("node_id"))
    owner = fields.filter("collection = 'tables' AND pointer = '/nodeId'").select("document_id", "entity_id", F.col("value_string").alias("table_node"))
    parent = fields.filter("collection = 'nodes' AND pointer = '/parentId'").select("document_id", F.col("entity_id").alias("node_id"), F.col("value_string").alias("parent_id"))
    # nothing tells how many fields come of a document, so no join is broadcast
    placed = member.hint("merge").join(owner.hint("merge"), ["document_id", "entity_id"]).join(parent.hint("merge"), ["document_id", "node_id"], "left")
    rows = member.filter("role = 'rowIds'").select("document_id", "entity_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("in_row"))
    placed = placed.join(rows.hint("merge"), ["document_id", "entity_id", "parent_id"], "left")
    bad = F.when(F.col("role") == "cellIds", F.col("in_row").isNull()).otherwise(~F.col("parent_id").eqNullSafe(F.col("table_node")))
    return _violation(placed.filter(bad), "TABLE-CONTAINMENT", F.concat_ws(" ", "role", "node_id"))


def conversion_claims(entities: DataFrame, fields: DataFrame) -> DataFrame:
    """Conversion statuses that the recorded statuses and diagnostics contradict."""
    no = F.lit(False)
    owned = entities.groupBy("document_id").agg(
        F.collect_list(F.when(F.col("collection") == DOCUMENT, F.col("entity_id"))).alias("ids"),
        F.bool_or(F.coalesce((F.col("collection") != DOCUMENT) & F.col("status").isin(*PARTIAL), no)).alias("lost"),
        F.bool_or(F.coalesce((F.col("collection") == "diagnostics") & F.get_json_object("payload", "$.severity").isin("error", "fatal"), no)).alias("error"),
    ).select("document_id", "lost", "error", F.explode("ids").alias("entity_id"))
    listed = fields.filter(F.col("collection") == DOCUMENT).groupBy("document_id").agg(
        F.collect_list(F.when(F.col("pointer") == "/conversion/status", F.struct(F.col("value_string").alias("claim")))).alias("claims"),
        F.bool_or(F.col("pointer").rlike("^/conversion/features/[0-9]+/status$") & F.col("value_string").isin(*PARTIAL)).alias("feature_lost"),
        F.count_if(F.col("pointer").rlike("^/conversion/diagnostics/[0-9]+$")).alias("diagnostics"), F.count_if(F.col("pointer").rlike("^/conversion/warnings/[0-9]+$")).alias("warnings"),
    ).select("*", F.inline_outer("claims"))
    rows = owned.hint("merge").join(listed.hint("merge"), "document_id", "left").withColumn("lost", F.col("lost") | F.coalesce("feature_lost", no))
    is_complete = F.col("claim").isin("complete", "complete-with-warnings")
    return _violations(
        rows,
        ("CONVERSION-STATUS", F.col("claim").isNull() | ~F.col("claim").isin(*CONVERSIONS), F.col("claim")),
        ("COMPLETE-CLAIM", is_complete & (F.col("lost") | F.col("error")), None),
        ("WARNING-STATUS", F.expr("(claim = 'complete' AND warnings > 0) OR (claim = 'complete-with-warnings' AND warnings = 0)"), None),
        ("FAILED-NO-ERROR", F.expr("claim = 'failed' AND (diagnostics = 0 OR NOT error)"), None),
        ("PARTIAL-NO-EVIDENCE", F.expr("claim = 'partial' AND diagnostics = 0 AND NOT lost"), None),
    )


def inventory_mismatch(fields: DataFrame) -> DataFrame:
    """Documents whose feature inventory is not the multiset of their features by name and status."""
    surface = fields.filter(F.col("collection") == DOCUMENT)

    def part(array: str, keys: tuple[str, ...]) -> DataFrame:
        rows = surface.filter(F.col("pointer").rlike(f"^/conversion/{array}/[0-9]+/({'|'.join(keys)})$"))
        at = F.element_at(F.split("pointer", "/"), 4)
        return rows.withColumn("_key", F.element_at(F.split("pointer", "/"), -1)).groupBy("document_id", at.alias("k")).pivot("_key", list(keys)).agg(F.first("value_json"))

    features = part("features", ("feature", "status")).groupBy("document_id", "feature", "status").agg(F.count(F.lit(1)).alias("have"))
    stated = part("featureInventory", ("feature", "status", "occurrences")).groupBy("document_id", "feature", "status").agg(F.sum(F.col("occurrences").cast("long")).alias("stated"))
    off = features.hint("merge").join(stated.hint("merge"), ["document_id", "feature", "status"], "full").filter(~F.col("have").eqNullSafe(F.col("stated")))
    return _violation(off.withColumn("entity_id", F.col("document_id")), "INVENTORY-MISMATCH", F.concat_ws(" ", "feature", "status"))


def violations(entities: DataFrame, fields: DataFrame, references: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """All violations of all documents; those of the schema too if the documents (document_id, ir_json) are given."""
    whole = documents
    nodes = entities.filter("collection = 'nodes'")
    surface = fields.filter((F.col("collection") == DOCUMENT) & (F.col("pointer") == "/rootNodeId")).select("document_id", F.col("value_string").alias("root_id"))
    documents = entities.filter(F.col("collection") == DOCUMENT).select("document_id", "entity_id")
    root = documents.join(surface, "document_id", "left").join(nodes.select("document_id", F.col("entity_id").alias("root_id"), F.col("kind"), F.col("payload")), ["document_id", "root_id"], "left")
    edges = node_edges(references)
    graph = reachability(edges, nodes.select("document_id", F.col("entity_id").alias("node_id")), surface).withColumnRenamed("node_id", "entity_id")
    parent = lambda collection, key: fields.filter((F.col("collection") == collection) & (F.col("pointer") == f"/{key}") & (F.col("value_type") == "string")).select("document_id", F.col("entity_id").alias("node_id"), F.col("value_string").alias("parent_id"))
    cycle = lambda collection, key, code: _violation(cyclic(parent(collection, key)).withColumnRenamed("node_id", "entity_id"), code)
    ends = references.filter("source_collection = 'relations' AND source_pointer = '/fromId'").select("document_id", F.col("source_id").alias("entity_id"), F.col("target_id").alias("node_id"))
    connectors = entities.filter("collection = 'relations' AND kind = 'connectorTarget'").select("document_id", "entity_id")
    ends = connectors.join(ends, ["document_id", "entity_id"]).join(nodes.select("document_id", F.col("entity_id").alias("node_id"), F.col("kind").alias("end_kind")), ["document_id", "node_id"], "left")
    last = F.element_at(F.split("pointer", "/"), -1)
    found = [
        duplicate_ids(entities),
        _violation(entities.filter(F.col("status").isNotNull() & ~F.col("status").isin(*STATUSES)), "STATUS-INVALID", F.col("status")),
        _violation(fields.filter(last.isin(*FORBIDDEN)), "FORBIDDEN-KEY", F.col("pointer")),
        _violation(fields.filter("value_type = 'number'"), "FRACTIONAL-NUMBER", F.col("pointer")),
        variants(fields),
        _violation(root.filter("payload IS NULL"), "ROOT-MISSING", F.col("root_id")),
        _violation(root.filter("payload IS NOT NULL AND NOT kind <=> 'document'"), "ROOT-KIND", F.col("kind")),
        _violation(root.filter(F.get_json_object("payload", "$.parentId").isNotNull()), "ROOT-PARENT"),
        broken_references(fields, entities),
        reciprocity(fields),
        *(_violation(graph.filter(F.col("code") == was), code) for was, code in (("several-parents", "MULTIPLE-PARENT"), ("orphan", "ORPHAN"), ("unreachable", "UNREACHABLE"))),
        node_rules(entities, fields),
        typed_values(fields),
        cycle("parts", "parentPartId", "PART-CYCLE"), cycle("styles", "basedOn", "STYLE-CYCLE"), cycle("coordinateSpaces", "parentSpaceId", "SPACE-CYCLE"),
        table_containment(entities, fields),
        order_rules(fields),
        _violation(ends.filter("NOT end_kind <=> 'connector'"), "CONNECTOR-ENDPOINT", F.col("end_kind")),
        conversion_claims(entities, fields),
        inventory_mismatch(fields),
    ]
    found.append(_violation(profile_violations(fields, known_profiles(fields)).withColumn("entity_id", F.col("document_id")), "PROFILE", F.col("fault")))
    if whole is not None:
        found.append(_violation(schema_violations(whole).withColumn("entity_id", F.col("document_id")), "SCHEMA", F.concat_ws(" ", "pointer", "keyword")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def first_violation(found: DataFrame) -> DataFrame:
    """Of each document the violation with the least rule number, then entity and detail."""
    first = F.min(F.struct("rule", "code", "entity_id", "detail")).alias("v")
    return found.groupBy("document_id").agg(first).select("document_id", "v.rule", "v.code", "v.entity_id", "v.detail")


assert set(COLLECTIONS) >= {r[0] for r in REFERENCE_RULES} - {DOCUMENT}
