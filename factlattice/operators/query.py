"""Lookups over entities, fields and references: fail-closed, typed, with null apart from missing."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlattice.functions.pointers import template_condition
from factlattice.operators.facts import DOCUMENT, canonical_json, lane
from factlattice.plans.contract import DEFAULT_PAGE, MAX_PAGE, Contract, QueryError

KEYS = ["document_id", "collection", "entity_id"]
REPRESENTATIONS = ("source", "normalized", "displayed", "stored", "cached", "computed", "observed")
_NO_VALUE = object()


def _equalities(rows: DataFrame, **wanted) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def exactly_one(rows: DataFrame) -> DataFrame:
    """The row, if there is one; an error for none or several."""
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise QueryError("no such row" if not found else "several rows")
    return rows


def get_entity(entities: DataFrame, collection: str, entity_id: str, document_id: str | None = None) -> DataFrame:
    return exactly_one(_equalities(entities, collection=collection, entity_id=entity_id, document_id=document_id))


def get_field(fields: DataFrame, contract: Contract, collection: str, entity_id: str, pointer: str, document_id: str | None = None) -> DataFrame:
    """One value of one entity; a missing value and an unregistered or root pointer are errors, null is a value."""
    if not pointer:
        raise QueryError("the root is not a field")
    if not contract.matching(collection, pointer):
        raise QueryError(f"pointer is not registered: {collection}{pointer}")
    return exactly_one(_equalities(fields, collection=collection, entity_id=entity_id, pointer=pointer, document_id=document_id))


def get_document_field(fields: DataFrame, contract: Contract, document_id: str, pointer: str) -> DataFrame:
    return get_field(fields, contract, DOCUMENT, document_id, pointer, document_id)


def list_nodes(entities: DataFrame, kind: str | None = None, status: str | None = None, part_id: str | None = None) -> DataFrame:
    """Nodes by optional equalities, in the documents' order."""
    rows = _equalities(entities.filter("collection = 'nodes'"), kind=kind, status=status)
    if part_id is not None:
        rows = rows.filter(F.get_json_object("payload", "$.partId") == part_id)
    return rows.orderBy("document_id", "ordinal")


def in_profile(rows: DataFrame, profiles: DataFrame, contract: Contract, profile: str | None) -> DataFrame:
    """Rows of the documents (document_id, profile) that have a profile: an unknown one is an error, another gives none."""
    if profile is None:
        return rows
    if profile not in contract.profiles:
        raise QueryError(f"unknown profile: {profile}")
    return rows.join(profiles.filter(F.col("profile") == profile).hint("merge"), "document_id", "left_semi")  # a row for each document is too much to broadcast


def _profiled(rows: DataFrame, profiles: DataFrame | None, contract: Contract | None, profile: str | None) -> DataFrame:
    if profile is not None and (profiles is None or contract is None):
        raise QueryError("a profile needs the contract and the profiles of the documents")
    return rows if profile is None else in_profile(rows, profiles, contract, profile)


def list_entities(entities: DataFrame, collection: str | None = None, kind: str | None = None, status: str | None = None, identifier: str | None = None, offset: int = 0, limit: int | None = None, profile: str | None = None, profiles: DataFrame | None = None, contract: Contract | None = None) -> DataFrame:
    """Entities by optional equalities and the profile of their documents, ordered by id, then offset and limit."""
    if offset < 0 or (limit is not None and limit < 0):
        raise QueryError("offset and limit are not negative")
    rows = _profiled(_equalities(entities, collection=collection, kind=kind, status=status, entity_id=identifier), profiles, contract, profile)
    rows = rows.orderBy("entity_id", "document_id", "collection")
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def encode_cursor(binding: dict) -> str:
    return base64.urlsafe_b64encode(canonical_json(binding).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> dict:
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as error:
        raise QueryError("the cursor cannot be read") from error
    if not isinstance(found, dict):
        raise QueryError("the cursor cannot be read")
    return found


def list_entities_page(entities: DataFrame, contract: Contract, digest: str, collection: str, kind: str | None = None, status: str | None = None, profile: str | None = None, limit: int = DEFAULT_PAGE, cursor: str | None = None, profiles: DataFrame | None = None):
    """A page of entities after the cursor's entity, in the order of entity and document id, and the next page's cursor (None at the end).

    With a profile only documents (document_id, profile) of `profiles` that have it are listed. A cursor is bound to the contract's version, the content digest and all filters; any other use is an error.
    """
    if not 1 <= limit <= MAX_PAGE:
        raise QueryError(f"a page has 1 to {MAX_PAGE} entities")
    binding = {"version": contract.version, "digest": digest, "collection": collection, "kind": kind, "status": status, "profile": profile}
    rows = _equalities(entities, collection=collection, kind=kind, status=status)
    rows = _profiled(rows, profiles, contract, profile)
    if cursor is not None:
        bound = decode_cursor(cursor)
        last, document = bound.pop("lastId", None), bound.pop("lastDocument", None)
        if bound != binding or not isinstance(last, str) or not isinstance(document, str):
            raise QueryError("the cursor belongs to another query")
        rows = rows.filter((F.col("entity_id") > last) | ((F.col("entity_id") == last) & (F.col("document_id") > document)))
    page = rows.orderBy("entity_id", "document_id").limit(limit + 1).collect()
    more = len(page) > limit
    page = page[:limit]
    return page, encode_cursor({**binding, "lastId": page[-1]["entity_id"], "lastDocument": page[-1]["document_id"]}) if more else None


def integer_order(text: Column) -> Column:
    """A value that orders JSON integers of any length as numbers: sign, number of digits, digits (mirrored below zero)."""
    negative = text.startswith("-")
    digits = F.ltrim(text, F.lit("-"))
    return F.struct(F.when(negative, -F.length(digits)).otherwise(F.length(digits)).alias("size"), F.when(negative, F.translate(digits, "0123456789", "9876543210")).otherwise(digits).alias("digits"))


def compare(operator: str, value) -> Column:
    """Whether a field fact meets an operator with a value; lanes never mix, and ordering other lanes is an error of the whole query."""
    kind, text = lane(value), canonical_json(value)
    same = F.col("value_type") == kind
    if operator == "eq":
        return same & (F.col("value_json") == text)
    if operator == "neq":
        return ~(same & (F.col("value_json") == text))
    if operator in ("lt", "lte", "gt", "gte"):
        if kind not in ("integer", "number", "string"):
            raise QueryError(f"{kind} values have no order")
        if kind == "integer":
            column, against = integer_order(F.col("value_json")), integer_order(F.lit(text))
        else:
            column, against = (F.col("value_string"), F.lit(value)) if kind == "string" else (F.col("value_number"), F.lit(float(value)))
        result = {"lt": column < against, "lte": column <= against, "gt": column > against, "gte": column >= against}[operator]
        return F.when(same, result).otherwise(F.raise_error(F.concat(F.lit(f"cannot order {kind} and "), F.col("value_type"))).cast("boolean"))
    if operator == "prefix":
        return F.coalesce(F.col("value_string").startswith(value), F.lit(False)) if kind == "string" else F.lit(False)
    raise QueryError(f"unknown operator: {operator}")


def compare_decimal(operator: str, value: str) -> Column:
    """Orders decimal strings as numbers, which `compare` deliberately does not; strings that are none never match."""
    column, against = F.expr("try_cast(value_string AS DECIMAL(38, 18))"), F.lit(value).cast("decimal(38,18)")
    result = {"lt": column < against, "lte": column <= against, "gt": column > against, "gte": column >= against, "eq": column == against}[operator]
    return F.coalesce(result, F.lit(False))


def query_fields(fields: DataFrame, entities: DataFrame, contract: Contract, pointer: str, value=_NO_VALUE, operator: str = "eq", collection: str | None = None, kind: str | None = None, status: str | None = None, namespace: str | None = None, extension_type: str | None = None, schema_version: str | None = None, profile: str | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """Fields that a pointer or template names and that meet an operator, of documents that have the profile if one is given.

    Gives document_id, collection, entity_id, pointer, presence (value, null or missing), value_json, status. The
    contract decides before any job whether the pointer is registered and allows the operator. `exists` counts null;
    `is-missing` gives a row for each entity without a matching pointer.
    """
    if not pointer.startswith("/"):
        raise QueryError("a field pointer begins with '/'")
    needs_value = operator not in ("exists", "is-null", "is-missing")
    if needs_value and value is _NO_VALUE:
        raise QueryError(f"{operator} needs a value")
    identity = {"namespace": namespace, "extension_type": extension_type, "schema_version": schema_version}
    if collection is not None:
        targets = [collection]
        contract.admit(collection, pointer, operator, **identity)
    else:
        targets = [c for c in contract.collections() if contract.matching(c, pointer, **identity)]
        if not targets:
            raise QueryError(f"pointer is not registered: {pointer}")
        for target in targets:
            contract.admit(target, pointer, operator, **identity)
    asked = _profiled(_equalities(entities.filter(F.col("collection").isin(targets)), kind=kind, status=status), profiles, contract, profile)
    for key, wanted in (("namespace", namespace), ("type", extension_type), ("schemaVersion", schema_version)):
        if wanted is not None:
            asked = asked.filter((F.col("collection") != "extensions") | (F.get_json_object("payload", f"$.{key}") == wanted))
    asked = asked.select(*KEYS, "status")
    near = fields.filter(F.col("collection").isin(targets) & (F.col("pointer") != "") & template_condition(F.col("pointer"), pointer))
    if operator == "is-missing":
        return asked.join(near, KEYS, "left_anti").select(*KEYS, F.lit(pointer).alias("pointer"), F.lit("missing").alias("presence"), F.lit(None).cast("string").alias("value_json"), "status")
    if operator == "exists":
        hit = near
    elif operator == "is-null":
        hit = near.filter("value_type = 'null'")
    elif operator == "contains":
        hit = near.filter(F.col("value_string").contains(value)) if lane(value) == "string" else near.limit(0)
        parent = F.regexp_replace("pointer", r"/[0-9]+$", "")
        members = fields.filter(F.col("collection").isin(targets) & F.col("pointer").rlike(r"/[0-9]+$") & compare("eq", value)).select(*KEYS, parent.alias("pointer"))
        hit = hit.unionByName(near.filter("value_type = 'list'").join(members, [*KEYS, "pointer"], "left_semi"))
    else:
        hit = near.filter(compare(operator, value))
    presence = F.when(F.col("value_type") == "null", "null").otherwise("value")
    return hit.join(asked, KEYS).select(*KEYS, "pointer", presence.alias("presence"), "value_json", "status")


def find_field_equals(fields: DataFrame, entities: DataFrame, contract: Contract, pointer: str, value, **filters) -> DataFrame:
    return query_fields(fields, entities, contract, pointer, value, "eq", **filters).select("document_id", "collection", "entity_id")


def find_relations(entities: DataFrame, kind: str | None = None, from_id: str | None = None, to_id: str | None = None) -> DataFrame:
    rows = entities.filter("collection = 'relations'").withColumn("from_id", F.get_json_object("payload", "$.fromId")).withColumn("to_id", F.get_json_object("payload", "$.toId"))
    return _equalities(rows, kind=kind, from_id=from_id, to_id=to_id)


def find_extensions(entities: DataFrame, namespace: str | None = None, extension_type: str | None = None, target_id: str | None = None, schema_version: str | None = None) -> DataFrame:
    rows = entities.filter("collection = 'extensions'")
    for name, key in (("namespace", "namespace"), ("extension_type", "type"), ("target_id", "targetId"), ("schema_version", "schemaVersion")):
        rows = rows.withColumn(name, F.get_json_object("payload", f"$.{key}"))
    return _equalities(rows, namespace=namespace, extension_type=extension_type, target_id=target_id, schema_version=schema_version)


def find_observations(entities: DataFrame, target_id: str | None = None, kind: str | None = None) -> DataFrame:
    rows = entities.filter("collection = 'observations'").withColumn("target_id", F.get_json_object("payload", "$.targetId"))
    return _equalities(rows, target_id=target_id, kind=kind)


def find_references(edges: DataFrame, target_id: str | None = None, source_id: str | None = None, source_collection: str | None = None, pointer: str | None = None) -> DataFrame:
    """Edges by optional equalities; an edge without an ordinal sorts as -1."""
    rows = _equalities(edges, target_id=target_id, source_id=source_id, source_collection=source_collection, source_pointer=pointer)
    return rows.orderBy("document_id", "source_collection", "source_id", "source_pointer", F.coalesce("ordinal", F.lit(-1)), "target_id")


def reverse_references(edges: DataFrame, target_id: str) -> DataFrame:
    return find_references(edges, target_id=target_id)


def get_text(entities: DataFrame, node_texts: DataFrame, nodes: DataFrame, representation: str = "source") -> DataFrame:
    """Texts of the given nodes (document_id, node_id), which a traversal has gathered, in the order of the texts themselves."""
    if representation not in REPRESENTATIONS:
        raise QueryError(f"unknown representation: {representation}")
    wanted = node_texts.join(nodes.select("document_id", "node_id"), ["document_id", "node_id"], "left_semi").select("document_id", F.col("text_id").alias("entity_id")).distinct()
    texts = entities.filter("collection = 'texts'").filter(F.get_json_object("payload", "$.representation") == representation)
    return texts.join(wanted, ["document_id", "entity_id"], "left_semi").select("document_id", "entity_id", "ordinal", F.get_json_object("payload", "$.value").alias("value")).orderBy("document_id", "ordinal")


def node_texts(edges: DataFrame) -> DataFrame:
    """node -> text edges from references."""
    return edges.filter("source_collection = 'nodes' AND target_collection = 'texts'").select("document_id", F.col("source_id").alias("node_id"), F.col("target_id").alias("text_id"))
