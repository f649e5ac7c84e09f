"""Building one document: entities with ids, texts in lanes, features, diagnostics, and the status they add up to."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from factlattice.operators.canonical import canonical_text
from factlattice.operators.facts import COLLECTIONS, canonical_json
from factlattice.operators.validation import PARTIAL

MB = 1 << 20


class SourceError(ValueError):
    """A source that cannot be decoded within its limits."""


@dataclass(frozen=True)
class Limits:
    """Bounds on one source; a source beyond any of them fails as a whole."""

    input_bytes: int = 16 * MB
    nodes: int = 50_000
    text_characters: int = 2_000_000
    xml_parts: int = 500
    xml_bytes: int = 16 * MB
    xml_nodes: int = 100_000
    xml_depth: int = 256
    zip_entries: int = 500
    zip_total: int = 64 * MB
    zip_entry: int = 16 * MB
    pdf_objects: int = 100_000
    pdf_stream: int = 8 * MB
    cmap_bytes: int = 2 * MB
    cmap_entries: int = 100_000


def safe_id(prefix: str, value: str, limit: int = 96) -> str:
    """An id of letters, digits and _.:/- that is never longer than the limit; longer ones end in a hash."""
    body = re.sub(r"[^A-Za-z0-9_.:/-]+", "-", value).strip("-") or "item"
    made = f"{prefix}-{body if body[0].isascii() and body[0].isalpha() else 'x-' + body}"
    return made if len(made) <= limit else f"{made[: limit - 17].rstrip('-')}-{hashlib.sha256(made.encode()).hexdigest()[:16]}"


def plain_decimal(value) -> str:
    """The one spelling of a decimal: fixed point, no plus, no trailing zeros, no negative zero."""
    token = str(int(value) if isinstance(value, bool) else value).strip()
    if not re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", token):
        raise SourceError(f"not a decimal: {token!r}")
    try:
        number = Decimal(token)
    except InvalidOperation as error:
        raise SourceError(f"not a decimal: {token!r}") from error
    text = f"{number:f}"
    return "0" if not number else text.rstrip("0").rstrip(".") if "." in text else text


class Builder:
    """Collects a document's entities; ids are made from a prefix and a running number, so equal sources give equal ids."""

    def __init__(self, source: str, version: str, limits: Limits):
        self.source, self.version, self.limits = source, version, limits
        self.collections: dict[str, list[dict]] = {c: [] for c in COLLECTIONS}
        self.by_id: dict[str, dict] = {}
        self.features: list[dict] = []
        self.characters = 0
        self.part = self.add("parts", kind=f"{source}-document", rootNodeIds=[])["partId"]
        self.root = self.node("document")
        self.by_id[self.part]["rootNodeIds"].append(self.root)

    def add(self, collection: str, **values) -> dict:
        rows, key = self.collections[collection], COLLECTIONS[collection]
        entity = {key: values.pop(key, f"{key.removesuffix('Id')}-{len(rows) + 1:05d}"), **{k: v for k, v in values.items() if v is not None}}
        if entity[key] in self.by_id:
            raise SourceError(f"id {entity[key]} twice")
        rows.append(entity)
        self.by_id[entity[key]] = entity
        return entity

    def node(self, kind: str, parent: str | None = None, status: str = "preserved", **values) -> str:
        if len(self.collections["nodes"]) >= self.limits.nodes:
            raise SourceError(f"more than {self.limits.nodes} nodes")
        if parent is None and self.collections["nodes"]:
            parent = self.root
        made = self.add("nodes", kind=kind, partId=self.part, parentId=parent, childIds=[], status=status, **values)["nodeId"]
        if parent is not None:
            self.by_id[parent]["childIds"].append(made)
        return made

    def text(self, node: str, value: str, representation: str = "source", source: str | None = None, **values) -> str:
        self.characters += len(value)
        if self.characters > self.limits.text_characters:
            raise SourceError(f"more than {self.limits.text_characters} characters of text")
        made = self.add("texts", representation=representation, provenance="authored" if representation == "source" else "derived", value=value, sourceTextId=source, status="preserved" if representation == "source" else "normalized", **values)["textId"]
        self.by_id[node].setdefault("textIds", []).append(made)
        return made

    def texts(self, node: str, source: str, normalized: str | None = None) -> str:
        """The source text, and a normalised one (NFC unless given) only where it differs."""
        made = self.text(node, source)
        other = unicodedata.normalize("NFC", source) if normalized is None else normalized
        if other != source:
            self.text(node, other, "normalized", made)
        return made

    def diagnostic(self, code: str, message: str, severity: str = "warning", target: str | None = None) -> str:
        return self.add("diagnostics", code=code, severity=severity, phase="convert", message=message[:500], targetId=target)["diagnosticId"]

    def feature(self, name: str, status: str = "preserved", target: str | None = None, diagnostic: str | None = None) -> None:
        self.features.append({k: v for k, v in {"feature": name, "targetId": target, "status": status, "diagnosticIds": [diagnostic] if diagnostic else []}.items() if v is not None})

    def unsupported(self, name: str, message: str, target: str | None = None, status: str = "unsupported") -> None:
        self.feature(name, status, target, self.diagnostic(f"{self.source}-{name}".upper(), message, target=target))

    def geometry(self, space: str, kind: str, primitives: list[dict], status: str = "preserved") -> str:
        return self.add("geometries", spaceId=space, kind=kind, primitives=primitives, status=status)["geometryId"]

    def finish(self) -> dict:
        told = self.collections["diagnostics"]
        severities = {d["severity"] for d in told}
        lost = any(f["status"] in PARTIAL for f in self.features) or any(e.get("status") in PARTIAL for rows in self.collections.values() for e in rows)
        status = "failed" if severities & {"error", "fatal"} else "partial" if lost else "complete-with-warnings" if severities else "complete"
        inventory: dict[tuple[str, str], dict] = {}
        for f in self.features:
            row = inventory.setdefault((f["feature"], f["status"]), {"feature": f["feature"], "status": f["status"], "occurrences": 0, "diagnosticIds": []})
            row["occurrences"] += 1
            row["diagnosticIds"] += [d for d in f["diagnosticIds"] if d not in row["diagnosticIds"]]
        for row in inventory.values():
            row["disposition"] = row["status"] if row["status"] in PARTIAL else "represented"
        document = {
            "schema": {"name": "document-facts", "version": "1.0.0"}, "documentId": "", "sourceFormat": {"namespace": "format", "name": self.source, "version": self.version}, "rootNodeId": self.root,
            **{c: rows for c, rows in self.collections.items() if rows},
            "conversion": {
                "status": status, "capabilityProfile": f"{self.source}-1", "features": self.features, "featureInventory": list(inventory.values()),
                "warnings": [d["diagnosticId"] for d in told if d["severity"] in ("info", "warning")], "diagnostics": [d["diagnosticId"] for d in told],
            },
        }
        document["documentId"] = safe_id("doc", hashlib.sha256(canonical_text(document, "content").encode()).hexdigest())
        return document


def failed_document(source: str, version: str, message: str, digest: str) -> dict:
    """A valid document that says why there is nothing else in it."""
    made = Builder(source, version, Limits())
    made.feature("conversion", "failed", made.root, made.diagnostic("CONVERSION-FAILED", message, "error", made.root))
    document = made.finish()
    document["documentId"] = safe_id("doc", f"failed:{digest}")
    return document


def to_json(document: dict) -> str:
    return canonical_json(document)
