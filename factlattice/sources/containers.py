"""Bounded readers of ZIP packages and XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from factlattice.sources.ir import Limits, SourceError


def member_name(name: str) -> str:
    """A member's name; absolute, climbing, backslashed and NUL names are errors."""
    if not name or name.startswith("/") or "\\" in name or "\0" in name or re.match(r"^[A-Za-z]:", name) or any(p in ("..", ".") for p in name.split("/")):
        raise SourceError(f"unsafe member name {name!r}")
    return name


class Package:
    """A ZIP package whose listing and members stay within the limits."""

    def __init__(self, raw: bytes, limits: Limits):
        self.limits = limits
        try:
            self.archive = zipfile.ZipFile(io.BytesIO(raw))
        except (zipfile.BadZipFile, ValueError) as error:
            raise SourceError(f"not a ZIP package: {error}") from error
        entries = self.archive.infolist()
        if len(entries) > limits.zip_entries:
            raise SourceError(f"more than {limits.zip_entries} members")
        names = [member_name(e.filename.rstrip("/")) for e in entries]
        if len(set(names)) != len(names):
            raise SourceError("two members of one name")
        if any(e.file_size > limits.zip_entry for e in entries) or sum(e.file_size for e in entries) > limits.zip_total:
            raise SourceError("members expand beyond the limit")
        self.names = {n for n, e in zip(names, entries) if not e.is_dir()}
        self.parsed = 0

    def read(self, name: str) -> bytes:
        """A member, cut off as an error where it expands beyond the limit, whatever its header says."""
        try:
            with self.archive.open(name) as member:
                raw = member.read(self.limits.zip_entry + 1)
        except (KeyError, zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError) as error:
            raise SourceError(f"cannot read {name}: {error}") from error
        if len(raw) > self.limits.zip_entry:
            raise SourceError(f"{name} expands beyond the limit")
        return raw

    def xml(self, name: str) -> ElementTree.Element:
        self.parsed += 1
        if self.parsed > self.limits.xml_parts:
            raise SourceError(f"more than {self.limits.xml_parts} XML parts")
        return bounded_xml(self.read(name), self.limits)

    def optional_xml(self, name: str) -> ElementTree.Element | None:
        return self.xml(name) if name in self.names else None

    def relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """id -> (type, target, external) of a part; internal targets are resolved against the part's folder."""
        folder, _, base = part.rpartition("/")
        found = {}
        root = self.optional_xml(f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels")
        for r in root if root is not None else ():
            target, external = r.get("Target", ""), r.get("TargetMode") == "External"
            found[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], target if external else resolve(folder, target), external)
        return found


def resolve(folder: str, target: str) -> str:
    parts = [] if target.startswith("/") else [p for p in folder.split("/") if p]
    for piece in target.split("/"):
        if piece == "..":
            parts = parts[:-1]
        elif piece not in ("", "."):
            parts.append(piece)
    return "/".join(parts)


def bounded_xml(raw: bytes, limits: Limits) -> ElementTree.Element:
    """Parses a part without DTD or entities, up to the limits on size, nodes and depth."""
    if len(raw) > limits.xml_bytes:
        raise SourceError("an XML part is too long")
    head = raw.replace(b"\0", b"")[:4096].upper() if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else raw.upper()
    if b"<!DOCTYPE" in head or b"<!ENTITY" in head:
        raise SourceError("an XML part declares a DTD or an entity")
    depth = nodes = 0
    root = None
    try:
        for event, element in ElementTree.iterparse(io.BytesIO(raw), ("start", "end")):
            if event == "start":
                root = element if root is None else root
                depth, nodes = depth + 1, nodes + 1
                if depth > limits.xml_depth or nodes > limits.xml_nodes:
                    raise SourceError("an XML part is too deep or has too many nodes")
            else:
                depth -= 1
    except ElementTree.ParseError as error:
        raise SourceError(f"malformed XML: {error}") from error
    return root


def local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def attribute(element: ElementTree.Element, name: str, default: str | None = None) -> str | None:
    """An attribute by its local name, in any namespace."""
    if name in element.attrib:
        return element.attrib[name]
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), default)


def child(element: ElementTree.Element | None, name: str) -> ElementTree.Element | None:
    return next((c for c in element if local(c) == name), None) if element is not None else None


def children(element: ElementTree.Element | None, name: str) -> list[ElementTree.Element]:
    return [c for c in element if local(c) == name] if element is not None else []


def below(element: ElementTree.Element, *names: str) -> list[ElementTree.Element]:
    return [c for c in element.iter() if local(c) in names]
