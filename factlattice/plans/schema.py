"""A subset of JSON Schema, enough for closed document formats, over documents in batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from factlattice.functions.pointers import escape
from factlattice.operators.facts import lane, strict_json

_LANES = {"null": "null", "boolean": "boolean", "integer": "integer", "string": "string", "array": "list", "object": "object"}


def _is(kind: str, value) -> bool:
    return lane(value) in ("integer", "number") if kind == "number" else lane(value) == _LANES[kind]


def _same(a, b) -> bool:
    return lane(a) == lane(b) and a == b


def violations(value, schema: dict, definitions: dict | None = None, at: str = ""):
    """(pointer, keyword) of everything in a value that a schema forbids; equality keeps lanes apart."""
    definitions = definitions or {}
    fits = lambda part: next(violations(value, part, definitions, at), None) is None
    if "$ref" in schema:
        yield from violations(value, definitions[schema["$ref"].rpartition("/")[2]], definitions, at)
    kinds = schema.get("type")
    if kinds is not None and not any(_is(k, value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        yield at, "type"
        return
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        yield at, "enum"
    if "const" in schema and not _same(value, schema["const"]):
        yield at, "const"
    kind = lane(value)
    if kind in ("integer", "number"):
        for word, wrong in (("minimum", lambda x: value < x), ("maximum", lambda x: value > x), ("exclusiveMinimum", lambda x: value <= x), ("exclusiveMaximum", lambda x: value >= x)):
            if word in schema and wrong(schema[word]):
                yield at, word
    if kind == "string":
        if len(value) < schema.get("minLength", 0):
            yield at, "minLength"
        if len(value) > schema.get("maxLength", len(value)):
            yield at, "maxLength"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield at, "pattern"
    if kind == "list":
        if len(value) < schema.get("minItems", 0):
            yield at, "minItems"
        if len(value) > schema.get("maxItems", len(value)):
            yield at, "maxItems"
        if schema.get("uniqueItems") and any(_same(a, b) for k, a in enumerate(value) for b in value[:k]):
            yield at, "uniqueItems"
        if "contains" in schema and all(next(violations(x, schema["contains"], definitions), None) for x in value):
            yield at, "contains"
        for k, x in enumerate(value):
            if isinstance(schema.get("items"), dict):
                yield from violations(x, schema["items"], definitions, f"{at}/{k}")
    if kind == "object":
        if len(value) < schema.get("minProperties", 0):
            yield at, "minProperties"
        yield from ((at, "required") for k in schema.get("required", ()) if k not in value)
        yield from ((at, "dependentRequired") for k, needs in schema.get("dependentRequired", {}).items() if k in value and not set(needs) <= set(value))
        known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        for k, x in value.items():
            own = f"{at}/{escape(k)}"
            parts = [known[k]] if k in known else []
            parts += [s for p, s in patterns.items() if re.search(p, k)]
            if not parts:
                rest = schema.get("additionalProperties", True)
                if rest is False:
                    yield own, "additionalProperties"
                parts = [rest] if isinstance(rest, dict) else []
            for part in parts:
                yield from violations(x, part, definitions, own)
    for part in schema.get("allOf", ()):
        yield from violations(value, part, definitions, at)
    if "anyOf" in schema and not any(map(fits, schema["anyOf"])):
        yield at, "anyOf"
    if "oneOf" in schema and sum(map(fits, schema["oneOf"])) != 1:
        yield at, "oneOf"
    if "not" in schema and fits(schema["not"]):
        yield at, "not"
    if "if" in schema:
        yield from violations(value, schema.get("then" if fits(schema["if"]) else "else", {}), definitions, at)


def check(rows: DataFrame, schema: dict, definitions: dict | None = None, key: str = "document_id", text: str = "ir_json") -> DataFrame:
    """(key, pointer, keyword) of the violations in a column of JSON."""

    def run(batches):
        for batch in batches:
            found = [(k, p, w) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t is not None for p, w in violations(strict_json(t), schema, definitions)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], pa.string()) for n in range(3)], [key, "pointer", "keyword"])

    return rows.selectExpr(f"CAST({key} AS STRING) AS {key}", text).mapInArrow(run, f"{key} string, pointer string, keyword string")
