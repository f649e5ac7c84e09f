"""Documents as tables: entities, field facts and references.

A document is one JSON object with scalars and 19 entity collections. Every entity, and the document without its
collections, is a row of `entities`; every value inside it, interior ones too, is a row of `fields`, addressed by a
JSON pointer and typed by its JSON lane. A missing value has no row; a null has one.
"""

from __future__ import annotations

import collections
import gc
import json
import re
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlattice.functions.pointers import escape, segments, unescape

# fixed values of the document format: collections with their id keys, in the format's order
COLLECTIONS = {
    "parts": "partId", "surfaces": "surfaceId", "nodes": "nodeId", "texts": "textId", "tables": "tableId",
    "styles": "styleId", "layouts": "layoutId", "coordinateSpaces": "coordinateSpaceId", "geometries": "geometryId",
    "resources": "resourceId", "formulas": "formulaId", "fields": "fieldId", "annotations": "annotationId",
    "relations": "relationId", "orders": "orderId", "observations": "observationId", "extensions": "extensionId",
    "sourceMaps": "sourceMapId", "diagnostics": "diagnosticId",
}
DOCUMENT = "__document__"
LANES = ("null", "boolean", "integer", "number", "string", "list", "object")

ENTITY_SCHEMA = "document_id string, collection string, entity_id string, kind string, status string, ordinal int, payload string"
#: Lists and objects inside one another that a document may have; a deeper one is quarantined.
MAX_NESTING = 200
FIELD_SCHEMA = "document_id string, collection string, entity_id string, pointer string, depth int, value_type string, value_json string, value_string string, value_number double"


_ENCODE = json.JSONEncoder(ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":")).encode
_POSITION = re.compile("/[0-9]+(?=/|$)")
_CONSTANTS = {None: "null", True: "true", False: "false"}


def canonical_json(value) -> str:
    """Compact JSON; keys in the order of their UTF-16 code units."""
    if isinstance(value, str):
        return encode_basestring(value)
    if value is None or isinstance(value, bool):
        return _CONSTANTS[value]
    text = _ENCODE(value)
    # the encoder orders keys by code points, which is the order of code units where all are below the surrogates
    return text if text.isascii() or max(text) < "\ud800" else _json_by_units(value)


def _json_by_units(value) -> str:
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + _json_by_units(value[k]) for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_json_by_units, value)) + "]"
    return json.dumps(value, ensure_ascii=False, allow_nan=False)


def strict_json(text: str):
    """Parses JSON; repeated keys and NaN or infinite numbers are errors."""

    def once(pairs):
        found = dict(pairs)
        if len(found) != len(pairs):
            raise ValueError("an object repeats a key")
        return found

    def never(word):
        raise ValueError(f"{word} is not a JSON number")

    return json.loads(text, object_pairs_hook=once, parse_constant=never)


_LANES = {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string", list: "list", dict: "object"}


def lane(value) -> str:
    found = _LANES.get(type(value))
    if found is not None:
        return found
    for kind, name in ((bool, "boolean"), (int, "integer"), (float, "number"), (str, "string"), (list, "list"), (dict, "object")):
        if isinstance(value, kind):
            return name
    raise TypeError(type(value))


def as_double(value: int | float) -> float:
    """The nearest double; integers beyond all doubles are infinite."""
    try:
        return float(value)
    except OverflowError:
        return float("inf") if value > 0 else float("-inf")


def nesting(value) -> int:
    """How deep lists and objects lie inside one another."""
    deepest, stack = 0, [(value, 0)]
    while stack:
        now, level = stack.pop()
        if isinstance(now, (dict, list)):
            deepest = max(deepest, level + 1)
            stack += [(v, level + 1) for v in (now.values() if isinstance(now, dict) else now)]
    return deepest


def walk(value, pointer: str = "", depth: int = 0):
    """(pointer, depth, value) of a value and all inside it, keys in code-point order."""
    stack = [(pointer, depth, value)]
    while stack:
        at, level, now = stack.pop()
        yield at, level, now
        if isinstance(now, dict):
            stack += [(f"{at}/{escape(k)}", level + 1, now[k]) for k in sorted(now, reverse=True)]
        elif isinstance(now, list):
            stack += [(f"{at}/{k}", level + 1, now[k]) for k in range(len(now) - 1, -1, -1)]


def walk_template(value, parts: list[str], pointer: str = "", depth: int = 0):
    """(pointer, depth, value) of what a template's segments name inside a value, in the order of walk(), without visiting the rest."""
    if not parts:
        yield pointer, depth, value
        return
    part, rest = parts[0], parts[1:]
    if part == "**":
        yield from walk(value, pointer, depth)
    elif isinstance(value, dict):
        if part == "*":
            for key in sorted(value):
                yield from walk_template(value[key], rest, f"{pointer}/{escape(key)}", depth + 1)
        elif (key := unescape(part)) in value and escape(key) == part:
            yield from walk_template(value[key], rest, f"{pointer}/{part}", depth + 1)
    elif isinstance(value, list):
        if part == "*":
            for k, inner in enumerate(value):
                yield from walk_template(inner, rest, f"{pointer}/{k}", depth + 1)
        elif part.isascii() and part.isdigit() and str(int(part)) == part and int(part) < len(value):
            yield from walk_template(value[int(part)], rest, f"{pointer}/{part}", depth + 1)


def entity_status(collection: str, entity: dict) -> str | None:
    status = entity.get("status")
    return status if isinstance(status, str) else None


def split_document(document: dict, collections: frozenset | None = None):
    """(collection, id, kind, status, ordinal, entity) of a document's surface and of each of its entities, or of those of some collections."""
    if collections is None or DOCUMENT in collections:
        surface = {k: v for k, v in document.items() if k not in COLLECTIONS}
        yield DOCUMENT, document["documentId"], None, None, 0, surface
    for collection, key in COLLECTIONS.items():
        if collections is not None and collection not in collections:
            continue
        for ordinal, entity in enumerate(document.get(collection) or []):
            kind = entity.get("kind")
            yield collection, entity[key], kind if isinstance(kind, str) else None, entity_status(collection, entity), ordinal, entity


class Rows:
    """Rows on their way out, in batches of bounded rows and characters, so that memory does not depend on how many come in."""

    def __init__(self, schema: str, sized: int):
        kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
        named = [x.split() for x in schema.split(", ")]
        self.names, self.types, self.sized = [n for n, _ in named], [kinds[k] for _, k in named], sized
        self.rows, self.characters = [], 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.characters += len(row[self.sized] or "")

    def batches(self, last: bool = False):
        """What is there as a batch, if it is enough for one or the last."""
        if self.rows and (last or len(self.rows) >= 10_000 or self.characters >= 4_000_000):
            columns = [pa.array(c, t) for c, t in zip(zip(*self.rows), self.types)]
            self.rows, self.characters = [], 0
            yield pa.RecordBatch.from_arrays(columns, self.names)


def sliced(batches, rows: int = 64):
    """Batches in short pieces, as a batch that comes in may hold 10,000 documents.

    Documents are trees, which reference counts free; the collector of cycles would walk each of them many times.
    """
    gc.set_threshold(200_000, 20, 20)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _entities(collections: frozenset | None, payloads: bool = True):
    def run(batches):
        out = Rows(ENTITY_SCHEMA, 6)
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                document = strict_json(text)
                for collection, entity_id, kind, status, ordinal, entity in split_document(document, collections):
                    out.add((document["documentId"], collection, entity_id, kind, status, ordinal, canonical_json(entity) if payloads else None))
                yield from out.batches()
        yield from out.batches(last=True)

    return run


def load_documents(raw: DataFrame, text_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Strictly parsed documents and the quarantined rest: (document_id, ir_json) and (value, error)."""
    checked = raw.select(F.col(text_col).alias("value")).mapInArrow(_check_json, "value string, document_id string, error string")
    return checked.filter("error IS NULL").select("document_id", F.col("value").alias("ir_json")), checked.filter("error IS NOT NULL").select("value", "error")


def _check_json(batches):
    for batch in batches:
        ids, errors = [], []
        for text in batch.column(0).to_pylist():
            try:
                document = strict_json(text)
                if not isinstance(document, dict) or not isinstance(document.get("documentId"), str):
                    raise ValueError("no documentId")
                if nesting(document) > MAX_NESTING:
                    raise ValueError(f"nested more than {MAX_NESTING} deep")
                ids.append(document["documentId"])
                errors.append(None)
            except (ValueError, TypeError, RecursionError) as error:
                ids.append(None)
                errors.append(str(error)[:200])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.string()), pa.array(errors, pa.string())], ["value", "document_id", "error"])


def entities(documents: DataFrame, collections: list[str] | None = None, payloads: bool = True) -> DataFrame:
    """The entities of (document_id, ir_json), each with its payload as canonical JSON; of some collections if they are named.

    Without payloads that column is null, for those who need only what there is.
    """
    return documents.select("ir_json").mapInArrow(_entities(None if collections is None else frozenset(collections), payloads), ENTITY_SCHEMA)


def templates(entity_rows: DataFrame) -> DataFrame:
    """(collection, template, n) of the pointers of entities, list positions as *, counted before they leave the pass."""

    def run(batches):
        for batch in batches:
            seen = collections.Counter()
            for piece in sliced([batch]):
                for collection, payload in zip(*(piece.column(k).to_pylist() for k in range(2))):
                    if payload is not None:
                        seen.update((collection, pointer) for pointer, _, _ in walk(strict_json(payload)) if pointer)
            merged = collections.Counter()
            for (collection, pointer), n in seen.items():
                merged[collection, _POSITION.sub("/*", pointer)] += n
            rows = [(c, p, n) for (c, p), n in merged.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.string(), pa.int64()))], ["collection", "template", "n"])

    counted = entity_rows.select("collection", "payload").mapInArrow(run, "collection string, template string, n long")
    return counted.groupBy("collection", "template").agg(F.sum("n").alias("n"))


def _add_fields(out: Rows, document_id, collection, entity_id, entity, asked: re.Pattern | None, parts: list[str] | None = None) -> None:
    for pointer, depth, value in walk(entity) if parts is None else walk_template(entity, parts):
        if asked is None or asked.search(pointer):
            kind = lane(value)
            number = as_double(value) if kind in ("integer", "number") else None
            out.add((document_id, collection, entity_id, pointer, depth, kind, canonical_json(value), value if kind == "string" else None, number))


def _flatten(pointers: str | None, template: str | None = None):
    def run(batches):
        parts = None if template is None else segments(template)
        out, asked = Rows(FIELD_SCHEMA, 6), re.compile(pointers) if pointers is not None else None
        for batch in sliced(batches):
            for document_id, collection, entity_id, payload in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if payload is not None:
                    _add_fields(out, document_id, collection, entity_id, strict_json(payload), asked, parts)
                yield from out.batches()
        yield from out.batches(last=True)

    return run


def _document_fields(collections: frozenset | None, pointers: str | None):
    def run(batches):
        out, asked = Rows(FIELD_SCHEMA, 6), re.compile(pointers) if pointers is not None else None
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                document = strict_json(text)
                for collection, entity_id, _, _, _, entity in split_document(document, collections):
                    _add_fields(out, document["documentId"], collection, entity_id, entity, asked)
                yield from out.batches()
        yield from out.batches(last=True)

    return run


def flatten(entity_rows: DataFrame, with_root: bool = True, pointers: str | None = None, template: str | None = None) -> DataFrame:
    """The field facts of entities: each value with its pointer, lane, canonical JSON and typed value columns.

    One pass over each payload and no shuffle; the root of an entity has the pointer "". With `pointers` only the facts
    whose pointer this regular expression finds leave the pass, with `template` only those that it names, and only these
    are visited.
    """
    out = entity_rows.select("document_id", "collection", "entity_id", "payload").mapInArrow(_flatten(pointers, template), FIELD_SCHEMA)
    return out if with_root else out.filter("pointer != ''")


def document_fields(documents: DataFrame, collections: list[str] | None = None, pointers: str | None = None) -> DataFrame:
    """flatten(entities(documents, collections), pointers=pointers), in one pass over the documents."""
    return documents.select("ir_json").mapInArrow(_document_fields(None if collections is None else frozenset(collections), pointers), FIELD_SCHEMA)


def typed_field(pointer: str, kind: str, value: Column) -> Column:
    """A field fact from a column; kind is the lane of its values, a null makes the lane null."""
    text = value.cast("string")
    # a list of one string is its JSON in brackets
    body = F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1) if kind == "string" else text
    return F.struct(
        F.lit(pointer).alias("pointer"), F.lit(pointer.count("/")).cast("int").alias("depth"),
        F.when(value.isNull(), "null").otherwise(kind).alias("value_type"),
        F.when(value.isNull(), "null").otherwise(body).alias("value_json"),
        (text if kind == "string" else F.lit(None).cast("string")).alias("value_string"),
        (value.cast("double") if kind in ("integer", "number") else F.lit(None).cast("double")).alias("value_number"),
    )


def fields_of_columns(rows: DataFrame, collection: str, id_col: str, columns: dict[str, tuple[str, Column]], document_id: Column | None = None) -> DataFrame:
    """Field facts from the columns of a table, in the JVM alone: pointer -> (lane, column)."""
    facts = [typed_field(pointer, kind, value) for pointer, (kind, value) in columns.items()]
    return rows.select(
        (document_id if document_id is not None else F.lit("tables")).alias("document_id"), F.lit(collection).alias("collection"),
        F.col(id_col).cast("string").alias("entity_id"), F.inline(F.array(*facts)),
    )


#: The pointers that `references` reads, as a regular expression.
REFERENCE_POINTERS = r"Id$|Ids/[0-9]+$|/id$|/type$"


def references(fields: DataFrame, entity_rows: DataFrame) -> DataFrame:
    """Edges between entities, with reference_kind id-field, id-list or typed-object.

    A string under a key that ends in Id, each string of a list under a key that ends in Ids, and an `id` beside a
    `type` refer to an entity of the same document that exists. An entity's own id does not, nor do schemaId and
    documentId at its root. The pointer of a list's member ends in its position, which is the ordinal too.

    Fields are read twice, once for an `id` beside a `type`, and no join is broadcast, as nothing tells how many rows
    come of a document.
    """
    last = F.element_at(F.split("pointer", "/"), -1)
    parent = F.try_element_at(F.split("pointer", "/"), F.lit(-2))
    own = F.create_map(*[F.lit(x) for pair in COLLECTIONS.items() for x in pair])
    own_key = F.coalesce(own[F.col("collection")], F.lit("documentId"))
    by_field = last.endswith("Id") & (last != own_key) & ~((F.col("depth") == 1) & last.isin("schemaId", "documentId"))
    by_list = parent.endswith("Ids") & last.rlike("^[0-9]+$")
    plain = fields.filter("value_type = 'string'").withColumn("last", last).withColumn("reference_kind", F.when(by_field, "id-field").when(by_list, "id-list")).filter("reference_kind IS NOT NULL")
    kind = F.when(last == "type", "type").when(F.col("value_type") == "string", "typed-object")
    beside = Window.partitionBy("document_id", "collection", "entity_id", F.regexp_replace("pointer", r"/[^/]*$", ""))
    objects = fields.filter(F.col("pointer").endswith("/type") | F.col("pointer").endswith("/id")).withColumn("last", last).withColumn("reference_kind", kind)
    typed = objects.withColumn("typed", F.bool_or(F.col("reference_kind") == "type").over(beside)).filter("typed AND reference_kind = 'typed-object'")
    columns = ["document_id", "collection", "entity_id", "pointer", "last", "value_string", "reference_kind"]
    single = plain.select(columns).unionByName(typed.select(columns))
    ordinal = F.when(F.col("reference_kind") == "id-list", F.col("last")).cast("int")
    edges = single.select("document_id", F.col("collection").alias("source_collection"), F.col("entity_id").alias("source_id"), F.col("pointer").alias("source_pointer"), ordinal.alias("ordinal"), F.col("value_string").alias("target_id"), "reference_kind")
    owners = entity_rows.filter(F.col("collection") != DOCUMENT).select("document_id", F.col("entity_id").alias("target_id"), F.col("collection").alias("target_collection")).distinct()
    return edges.hint("merge").join(owners.hint("merge"), ["document_id", "target_id"])
