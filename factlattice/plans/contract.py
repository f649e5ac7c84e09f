"""The query contract: which pointers of which collection may be queried, as what type, with which operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from factlattice.functions.pointers import escape, segments, template_matches

BASE = ("eq", "neq", "exists", "is-null", "is-missing")
ORDERED = ("lt", "lte", "gt", "gte")
TEXTUAL = ("prefix", "contains")
OPERATORS = (*BASE, *ORDERED, *TEXTUAL)
MAX_PAGE, DEFAULT_PAGE = 1000, 100


class QueryError(ValueError):
    """A query that the contract or the data refuses."""


@dataclass(frozen=True)
class Field:
    collection: str
    pointer: str
    query_type: str
    operators: tuple[str, ...]
    namespace: str | None = None
    extension_type: str | None = None
    schema_version: str | None = None


def operators_of(query_type: str) -> tuple[str, ...]:
    extra = ORDERED if query_type in ("integer", "number", "decimal-string") else ()
    return (*BASE, *extra, *(TEXTUAL if query_type in ("string", "id-string", "status", "list") else ()))


#: Definitions that name a query type of their own, whatever their JSON type.
NAMED_TYPES = {"decimal": "decimal-string", "id": "id-string", "status": "status", "typedValue": "typed-value", "formulaValue": "typed-value"}


def query_type(node: dict, definitions: dict) -> str:
    """The query type of a schema node: by the definition it refers to, else by its JSON type."""
    name = node.get("$ref", "").rpartition("/")[2]
    if name in NAMED_TYPES:
        return NAMED_TYPES[name]
    if name:
        return query_type(definitions[name], definitions)
    kind = node.get("type")
    if isinstance(kind, list):
        kind = next((k for k in kind if k != "null"), "null")
    if kind == "object" or (kind is None and ("properties" in node or "additionalProperties" in node)):
        return "map" if "additionalProperties" in node and node["additionalProperties"] and "properties" not in node else "object"
    if kind is None:
        for key in ("const", "enum"):
            if key in node:
                value = node[key] if key == "const" else node[key][0]
                return "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "string"
        for key in ("oneOf", "anyOf", "allOf"):
            if node.get(key):
                return query_type(node[key][0], definitions)
    return {"array": "list"}.get(kind, kind or "any")


def expand(node: dict, definitions: dict, pointer: str = "", seen: tuple[str, ...] = ()):
    """(pointer template, query type) of everything below a schema node.

    Properties become /name, items of arrays and values of maps /*, the rest of open objects /**; each branch of a
    union is expanded; a definition inside itself is cut at its second visit.
    """
    if "$ref" in node:
        name = node["$ref"].rpartition("/")[2]
        if name in seen:
            return
        yield from expand(definitions[name], definitions, pointer, (*seen, name))
        return
    for union in ("oneOf", "anyOf", "allOf"):
        for branch in node.get(union, ()):
            yield from expand(branch, definitions, pointer, seen)
    for key, child in node.get("properties", {}).items():
        at = f"{pointer}/{escape(key)}"
        yield at, query_type(child, definitions)
        yield from expand(child, definitions, at, seen)
    if isinstance(node.get("items"), dict):
        yield f"{pointer}/*", query_type(node["items"], definitions)
        yield from expand(node["items"], definitions, f"{pointer}/*", seen)
    rest = node.get("additionalProperties")
    if isinstance(rest, dict):
        yield f"{pointer}/*", query_type(rest, definitions)
        yield from expand(rest, definitions, f"{pointer}/*", seen)
    elif rest is True:
        yield f"{pointer}/**", "any"


class Contract:
    """Registered fields; of several that match a pointer the first registered is the field's type."""

    def __init__(self, fields: list[Field], version: str = "1", profiles: tuple[str, ...] = ()):
        self.fields, self.version, self.profiles = list(dict.fromkeys(fields)), version, profiles
        self._exact: dict[tuple[str, str], list[Field]] = {}
        self._wild: dict[str, list[tuple[list[str], Field]]] = {}
        for f in self.fields:
            if "*" in f.pointer:
                self._wild.setdefault(f.collection, []).append((segments(f.pointer), f))
            else:
                self._exact.setdefault((f.collection, f.pointer), []).append(f)

    @classmethod
    def from_schemas(cls, schemas: dict[str, dict], definitions: dict | None = None, **more) -> Contract:
        """From a JSON schema for each collection."""
        found = [Field(c, p, t, operators_of(t)) for c, schema in schemas.items() for p, t in expand(schema, definitions or {})]
        return cls(found, **more)

    @classmethod
    def from_types(cls, types: dict[str, dict[str, str]], **more) -> Contract:
        """From {collection: {pointer template: query type}}."""
        return cls([Field(c, p, t, operators_of(t)) for c, fields in types.items() for p, t in fields.items()], **more)

    def collections(self) -> list[str]:
        return list(dict.fromkeys(f.collection for f in self.fields))

    def matching(self, collection: str, pointer: str, namespace: str | None = None, extension_type: str | None = None, schema_version: str | None = None) -> list[Field]:
        """The fields that a pointer, or a template as written, names; an extension identity that is None fits any."""
        parts = segments(pointer)
        found = [*self._exact.get((collection, pointer), ()), *(f for t, f in self._wild.get(collection, ()) if template_matches(t, parts))]
        if "*" in pointer:
            found += [f for f in self.fields if f.collection == collection and f not in found and template_matches(parts, segments(f.pointer))]
        fits = lambda own, asked: own is None or asked is None or own == asked
        return [f for f in found if fits(f.namespace, namespace) and fits(f.extension_type, extension_type) and fits(f.schema_version, schema_version)]

    def admit(self, collection: str, pointer: str, operator: str, **identity) -> list[Field]:
        """The matching fields; an error if none is registered or none allows the operator."""
        if operator not in OPERATORS:
            raise QueryError(f"unknown operator: {operator}")
        found = self.matching(collection, pointer, **identity)
        if not found:
            raise QueryError(f"pointer is not registered: {collection}{pointer}")
        if not any(operator in f.operators for f in found):
            raise QueryError(f"operator {operator} is not registered for {collection}{pointer}")
        return found

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f.collection, f.pointer, f.query_type, list(f.operators), k) for k, f in enumerate(self.fields)], "collection string, pointer string, query_type string, filter_operators array<string>, ordinal int")
