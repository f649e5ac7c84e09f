"""PDF files: objects, streams, the page tree, content operators, text by character maps, paths and annotations."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from decimal import Decimal

from factlattice.sources.ir import Builder, Limits, SourceError, plain_decimal

_SKIPPED = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]*")
_PLAIN = re.compile(rb"\(([^()\\]*)\)")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_REFERENCE = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_HEAD = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj(?![A-Za-z])")
_START = re.compile(rb"startxref[\0\t\n\f\r ]+(\d{1,12})")
_SUBSECTION = re.compile(rb"[\0\t\n\f\r ]*(\d{1,10})[\0\t\n\f\r ]+(\d{1,10})(?=[\0\t\n\f\r ]+(?:\d{10}[ ]|trailer|\d+ \d+[\r\n]))")
_ENTRY = re.compile(rb"[\0\t\n\f\r ]*(\d{10})[ ]+(\d{5})[ ]+([nf])")
_ESCAPES = {ord(k): v for k, v in zip("nrtbf()\\", (b"\n", b"\r", b"\t", b"\b", b"\f", b"(", b")", b"\\"))}


class Name(str):
    """A name object, without its slash."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass(frozen=True)
class Operator:
    name: str
    offset: int


class _Astray(SourceError):
    """Cross-references that cannot be read."""


class Lexer:
    """Values and operators from bytes, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _SKIPPED.match(self.data, self.at).end()

    def next(self, depth: int = 0):
        """The next value; Operator for a bare word; None at the end."""
        if depth > 64:
            raise SourceError("values nested deeper than 64")
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            return None
        c = data[at : at + 1]
        if c == b"/":
            self.at = end = _REGULAR.match(data, at + 1).end()
            name = data[at + 1 : end]
            return Name((re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), name) if b"#" in name else name).decode("latin-1"))
        if c == b"(":
            return self.literal()
        if data[at : at + 2] == b"<<":
            self.at += 2
            out = {}
            while True:
                self.skip()
                if self.data[self.at : self.at + 2] == b">>":
                    self.at += 2
                    return out
                key = self.next(depth + 1)
                if not isinstance(key, Name):
                    raise SourceError("a dictionary without its end")
                out[key] = self.next(depth + 1)
        if c == b"<":
            end = data.find(b">", at)
            if end < 0:
                raise SourceError("a hexadecimal string without its end")
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at:end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.data[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                value = self.next(depth + 1)
                if value is None:
                    raise SourceError("an array without its end")
                out.append(value)
        if c.isdigit() and (m := _REFERENCE.match(data, at)):
            self.at = m.end()
            return Ref(int(m[1]))
        if c in b"0123456789+-." and (m := _NUMBER.match(data, at)):
            self.at = m.end()
            return Decimal(m[0].decode())
        self.at = end = _REGULAR.match(data, at + 1).end()
        word = data[at:end].decode("latin-1")
        return {"true": True, "false": False}.get(word, Operator(word, at))

    def literal(self) -> bytes:
        if m := _PLAIN.match(self.data, self.at):
            self.at = m.end()
            return m[1]
        out, depth, k, data = bytearray(), 0, self.at, self.data
        while k < len(data):
            c = data[k]
            if c == 92 and k + 1 < len(data):
                if m := re.compile(rb"[0-7]{1,3}").match(data, k + 1):
                    out.append(int(m[0], 8) & 255)
                    k = m.end()
                    continue
                if m := re.compile(rb"\r\n|\r|\n").match(data, k + 1):
                    k = m.end()
                    continue
                out += _ESCAPES.get(data[k + 1], data[k + 1 : k + 2])
                k += 2
                continue
            depth += {40: 1, 41: -1}.get(c, 0)
            if not depth:
                self.at = k + 1
                return bytes(out)
            if depth > 1 or c != 40:
                out.append(c)
            k += 1
        raise SourceError("a string without its end")


class File:
    """The objects of a file: by its cross-references, the newest revision first, as long as every one of them holds.

    Where they are missing or lead astray, objects are found by scanning (`authentic` is False then). Object streams are
    opened either way; a freed object is gone, an object that a later part of the file states anew has that value.
    """

    def __init__(self, data: bytes, limits: Limits):
        if not data.lstrip()[:5] == b"%PDF-":
            raise SourceError("no PDF header")
        self.data, self.limits, self.version = data, limits, data.lstrip()[5:8].decode("latin-1")
        self._forget()
        self.authentic = self._by_references()
        if not self.authentic:
            self._forget()
            self._scan()
        if "Encrypt" in self.trailer:
            raise SourceError("the file is encrypted")

    def _forget(self) -> None:
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        self.trailer: dict = {}
        self.lost: list[str] = []

    def _by_references(self) -> bool:
        """Reads all objects that the cross-references name; False as soon as one is not where it should be."""
        starts = list(_START.finditer(self.data))
        at, seen, entries = int(starts[-1][1]) if starts else None, set(), {}
        try:
            while at is not None:
                if at in seen or not 0 <= at < len(self.data):
                    return False
                seen.add(at)
                rows, head = self._section(at)
                self.trailer = {**head, **self.trailer}
                if isinstance(head.get("XRefStm"), Decimal):  # a table whose newer objects are in a stream beside it
                    rows = {**self._section(int(head["XRefStm"]))[0], **{k: r for k, r in rows.items() if r[0]}}
                entries = {**rows, **entries}
                if len(entries) > self.limits.pdf_objects:
                    raise SourceError(f"more than {self.limits.pdf_objects} objects")
                at = int(head["Prev"]) if isinstance(head.get("Prev"), Decimal) else None
        except (_Astray, ValueError, IndexError):
            return False
        inside: dict[int, set[int]] = {}
        for number, (kind, where, _) in entries.items():
            if kind == 1:
                head = _HEAD.match(self.data, where)
                if not head or int(head[1]) != number:
                    return False
                self._object(number, head.end())
            elif kind == 2:
                inside.setdefault(where, set()).add(number)
        for holder, wanted in inside.items():
            if self._open_objects(holder, lambda n, wanted=wanted: n in wanted) != wanted:
                return False
        return bool(entries)

    def _section(self, at: int) -> tuple[dict[int, tuple[int, int, int]], dict]:
        """Entries (kind 0 free, 1 at an offset, 2 in an object stream; offset or stream; generation or place) of one section and its trailer."""
        m = re.compile(rb"[\0\t\n\f\r ]*xref[\0\t\n\f\r ]*").match(self.data, at)
        return self._table(m.end()) if m else self._reference_stream(at)

    def _table(self, at: int) -> tuple[dict, dict]:
        rows = {}
        while m := _SUBSECTION.match(self.data, at):
            first, count, at = int(m[1]), int(m[2]), m.end()
            if count > self.limits.pdf_objects:
                raise _Astray
            for number in range(first, first + count):
                entry = _ENTRY.match(self.data, at)
                if not entry:
                    raise _Astray
                rows[number], at = (int(entry[3] == b"n"), int(entry[1]), int(entry[2])), entry.end()
        m = re.compile(rb"[\0\t\n\f\r ]*trailer").match(self.data, at)
        head = Lexer(self.data, m.end()).next() if m else None
        if not isinstance(head, dict):
            raise _Astray
        return rows, head

    def _reference_stream(self, at: int) -> tuple[dict, dict]:
        m = _HEAD.match(self.data, at)
        if not m:
            raise _Astray
        number = int(m[1])
        self._object(number, m.end())
        head, body = self.objects.pop(number, None), None
        if isinstance(head, dict) and head.get("Type") == "XRef":
            self.objects[number] = head
            body = self.stream(number)
        widths = [int(w) for w in head.get("W", [])] if body is not None else []
        if len(widths) != 3 or not 0 < sum(widths) <= 32:
            raise _Astray
        index = [int(x) for x in head.get("Index", [Decimal(0), head.get("Size", Decimal(0))])]
        rows, k = {}, 0
        for first, count in zip(index[::2], index[1::2]):
            for own in range(first, first + min(count, (len(body) - k) // sum(widths))):
                values = []
                for w in widths:
                    values.append(int.from_bytes(body[k : k + w]) if w else None)
                    k += w
                rows[own] = (1 if values[0] is None else values[0], values[1] or 0, values[2] or 0)
        return rows, head

    def _scan(self) -> None:
        """Objects by their heads, not looked for inside of streams; the last one of a number counts."""
        at, stated = 0, {}
        while m := _HEAD.search(self.data, at):
            if len(self.objects) >= self.limits.pdf_objects:
                raise SourceError(f"more than {self.limits.pdf_objects} objects")
            number = int(m[1])
            at = max(m.end(), self._object(number, m.end()))
            stated[number] = m.start()
        for m in re.finditer(rb"trailer", self.data):
            try:
                found = Lexer(self.data, m.end()).next()
            except SourceError:
                continue
            if isinstance(found, dict):
                self.trailer |= found
        for number, value in sorted(self.objects.items(), key=lambda x: stated[x[0]]):
            if isinstance(value, dict) and value.get("Type") == "XRef":
                self.trailer = {**value, **self.trailer}
            elif isinstance(value, dict) and value.get("Type") == "ObjStm":
                for own in self._open_objects(number, lambda n, p=stated[number]: stated.get(n, -1) < p):
                    stated[own] = stated[number]

    def _object(self, number: int, at: int) -> int:
        """Reads an object; gives where it ends, with its stream."""
        lexer = Lexer(self.data, at)
        self.streams.pop(number, None)
        try:
            value = lexer.next()
        except SourceError:
            self.objects.pop(number, None)
            self.lost.append(f"object {number}")
            return at
        self.objects[number] = value
        lexer.skip()
        if isinstance(value, dict) and self.data[lexer.at : lexer.at + 6] == b"stream":
            start = lexer.at + 6
            start += 2 if self.data[start : start + 2] == b"\r\n" else 1
            length = value.get("Length")
            end = start + int(length) if isinstance(length, Decimal) else -1
            if end < 0 or not re.match(rb"\s*endstream", self.data[end : end + 12]):
                end = self.data.find(b"endstream", start)
                end = len(self.data) if end < 0 else end
            self.streams[number] = self.data[start:end]
            return end
        return lexer.at

    def _open_objects(self, number: int, wanted) -> set[int]:
        """Reads the wanted objects of an object stream; gives their numbers."""
        head, body = self.objects.get(number), self.stream(number)
        if body is None:
            return set()
        lexer, count, first = Lexer(body), int(head.get("N", 0)), int(head.get("First", 0))
        pairs = [(lexer.next(), lexer.next()) for _ in range(min(count, self.limits.pdf_objects))]
        found = set()
        for own, offset in pairs:
            if isinstance(own, Decimal) and isinstance(offset, Decimal) and wanted(int(own)):
                self.objects[int(own)] = Lexer(body, first + int(offset)).next()
                self.streams.pop(int(own), None)
                found.add(int(own))
        return found

    def references(self, number: int) -> list[int]:
        """Numbers of the objects that an object refers to, in order."""
        found, stack = {}, [self.objects.get(number)]
        while stack:
            value = stack.pop()
            if isinstance(value, Ref):
                found[value.number] = None
            elif isinstance(value, dict):
                stack += reversed(value.values())
            elif isinstance(value, list):
                stack += reversed(value)
        return list(found)

    def get(self, value, depth: int = 0):
        while isinstance(value, Ref) and depth < 32:
            value, depth = self.objects.get(value.number), depth + 1
        return value

    def stream(self, number: int) -> bytes | None:
        """A stream after its filters, up to the limit; None if a filter is not known."""
        raw, head = self.streams.get(number), self.objects.get(number)
        if raw is None or not isinstance(head, dict):
            return None
        filters, given = self.get(head.get("Filter")), self.get(head.get("DecodeParms"))
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        given = given if isinstance(given, list) else [given]
        for k, f in enumerate(filters):
            parameters = self.get(given[k]) if k < len(given) else None
            if f in ("FlateDecode", "Fl"):
                try:
                    raw = zlib.decompressobj().decompress(raw, self.limits.pdf_stream + 1)
                except zlib.error:
                    self.lost.append(f"stream {number}")
                    return None
                if isinstance(parameters, dict) and parameters.get("Predictor", 1) != 1:
                    raw = unpredicted(raw, {k: int(v) for k, v in parameters.items() if isinstance(v, Decimal)})
                    if raw is None:
                        self.lost.append(f"predictor of stream {number}")
                        return None
            elif f in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw.partition(b">")[0])
                raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                self.lost.append(f"filter {f}")
                return None
            if len(raw) > self.limits.pdf_stream:
                raise SourceError("a stream expands beyond the limit")
        return raw

    def root(self) -> dict:
        found = self.get(self.trailer.get("Root"))
        return found if isinstance(found, dict) else next((v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), {})

    def destinations(self) -> dict[str, object]:
        """The named destinations of the catalogue, from its dictionary and its name tree."""
        root = self.root()
        old, names = self.get(root.get("Dests")), self.get(root.get("Names"))
        found = {str(k): self.get(v) for k, v in old.items()} if isinstance(old, dict) else {}
        stack, seen = [names.get("Dests")] if isinstance(names, dict) else [], set()
        while stack:
            at = stack.pop()
            if isinstance(at, Ref):
                if at.number in seen:
                    continue
                seen.add(at.number)
            node = self.get(at)
            if isinstance(node, dict):
                listed, kids = self.get(node.get("Names")) or [], self.get(node.get("Kids")) or []
                found |= {k.decode("latin-1"): self.get(v) for k, v in zip(listed[::2], listed[1::2]) if isinstance(k, bytes)}
                stack += kids
        return found

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they inherit and their object number; a tree that loops is cut where it does."""
        root = self.root()
        out, seen = [], set()
        stack = [(root.get("Pages"), {})]
        while stack:
            at, inherited = stack.pop()
            if isinstance(at, Ref):
                if at.number in seen:
                    continue
                seen.add(at.number)
            node = self.get(at)
            if not isinstance(node, dict):
                continue
            own = {**inherited, **{k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                stack += [(kid, own) for kid in reversed(kids)]
            else:
                out.append({**node, **own, "number": at.number if isinstance(at, Ref) else None})
        return out


def unpredicted(raw: bytes, parameters: dict[str, int]) -> bytes | None:
    """Undoes the row filters that a stream was compressed after; None for other predictors and incomplete rows."""
    if parameters["Predictor"] < 10:
        return None
    bits = parameters.get("Colors", 1) * parameters.get("BitsPerComponent", 8)
    size, near = -(-parameters.get("Columns", 1) * bits // 8), max(1, bits // 8)
    if size < 1 or len(raw) % (size + 1):
        return None
    out, above = bytearray(), bytes(size)
    for k in range(0, len(raw), size + 1):
        kind, row = raw[k], bytearray(raw[k + 1 : k + 1 + size])
        if kind > 4:
            return None
        for i in range(size) if kind else ():
            left, up, corner = row[i - near] if i >= near else 0, above[i], above[i - near] if i >= near else 0
            if kind == 4:
                guess = left + up - corner
                add = min((left, up, corner), key=lambda x: abs(guess - x))
            else:
                add = (left, up, (left + up) // 2)[kind - 1]
            row[i] = (row[i] + add) & 255
        out += row
        above = bytes(row)
    return bytes(out)


def operations(content: bytes):
    """(operator, operands, offset); the data of inline images is skipped."""
    lexer, operands = Lexer(content), []
    while (value := lexer.next()) is not None:
        if not isinstance(value, Operator):
            operands.append(value)
            continue
        if value.name == "ID":
            m = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|$)").search(content, lexer.at)
            lexer.at = m.end() if m else len(content)
        yield value.name, operands, value.offset
        operands = []


def character_map(raw: bytes, limits: Limits) -> dict[bytes, str]:
    """code -> Unicode from bfchar and bfrange sections."""
    if len(raw) > limits.cmap_bytes:
        raise SourceError("a character map is too long")
    out: dict[bytes, str] = {}
    words = lambda b: b.decode("utf-16-be", "replace")
    lexer, held = Lexer(raw), []
    while (value := lexer.next()) is not None:
        if not isinstance(value, Operator):
            held.append(value)
            continue
        if value.name == "endbfchar":
            out |= {a: words(b) for a, b in zip(held[::2], held[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
        elif value.name == "endbfrange":
            for a, b, target in zip(held[::3], held[1::3], held[2::3]):
                if not (isinstance(a, bytes) and isinstance(b, bytes)):
                    continue
                for k in range(min(int.from_bytes(b) - int.from_bytes(a) + 1, limits.cmap_entries)):
                    code = (int.from_bytes(a) + k).to_bytes(len(a))
                    if isinstance(target, list):
                        if k < len(target) and isinstance(target[k], bytes):
                            out[code] = words(target[k])
                    elif isinstance(target, bytes) and len(target) >= 2:
                        out[code] = words(target[:-2] + ((int.from_bytes(target[-2:]) + k) & 0xFFFF).to_bytes(2))
        if len(out) > limits.cmap_entries:
            raise SourceError("a character map has too many entries")
        held = []
    return out


def decode(code: bytes, mapping: dict[bytes, str] | None) -> str | None:
    """The text of a string if every code of it is mapped, longest codes first; else None, never a part of it."""
    if mapping is None:
        return code.decode("latin-1") if all(32 <= c < 127 for c in code) else None
    widths = sorted({len(k) for k in mapping}, reverse=True)
    out, k = "", 0
    while k < len(code):
        width = next((w for w in widths if code[k : k + w] in mapping), 0)
        if not width:
            return None
        out += mapping[code[k : k + width]]
        k += width
    return out


def apply(m: tuple, x: Decimal, y: Decimal) -> tuple[Decimal, Decimal]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def multiply(a: tuple, b: tuple) -> tuple:
    """First a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


IDENTITY = tuple(map(Decimal, (1, 0, 0, 1, 0, 0)))
#: What paths are painted with before anything is set.
INITIAL = {
    "fillColor": ["0"], "strokeColor": ["0"], "lineWidth": "1", "lineCap": 0, "lineJoin": 0, "miterLimit": "10", "dashPattern": {"array": [], "phase": "0"},
    "renderingIntent": None, "extGState": None, "shading": None,
}
#: Operators that set colours, with the number of their components.
COLOURS = {"g": 1, "rg": 3, "k": 4, "G": 1, "RG": 3, "K": 4}
#: Operators without a part in what is recorded.
SILENT = {"BT", "ET", "T*", "n", "BI", "ID", "EI", "BMC", "BDC", "EMC", "MP", "DP", "BX", "EX"}


class Interpreter:
    """Folds a page's operations into text fragments and painted paths, in drawing order."""

    def __init__(self):
        self.state = {"matrix": IDENTITY, "font": None, "size": Decimal(0), "leading": Decimal(0), "paint": INITIAL}
        self.stack: list[dict] = []
        self.origin = (Decimal(0), Decimal(0))
        self.path: list[dict] = []
        self.out: list[tuple] = []
        self.unknown: list[str] = []

    def run(self, content: bytes) -> Interpreter:
        for name, operands, offset in operations(content):
            numbers = [o for o in operands if isinstance(o, Decimal)]
            try:
                self.step(name, operands, numbers, offset)
            except (IndexError, ValueError, TypeError):
                self.unknown.append(f"{name} with wrong operands")
        return self

    def paint(self, name: str, value) -> None:
        self.state["paint"] = self.state["paint"] | {name: value}

    def point(self, x, y) -> dict:
        x, y = apply(self.state["matrix"], x, y)
        return {"x": plain_decimal(x), "y": plain_decimal(y)}

    def step(self, name: str, operands: list, n: list, offset: int) -> None:
        s = self.state
        if name == "q":
            self.stack.append(dict(s))
        elif name == "Q":
            self.state = self.stack.pop() if self.stack else s
        elif name == "cm":
            s["matrix"] = multiply(tuple(n[:6]), s["matrix"]) if len(n) == 6 else s["matrix"]
        elif name in COLOURS:
            self.paint("fillColor" if name.islower() else "strokeColor", [plain_decimal(n[k]) for k in range(-COLOURS[name], 0)])
        elif name in ("w", "M"):
            self.paint({"w": "lineWidth", "M": "miterLimit"}[name], plain_decimal(n[-1]))
        elif name in ("J", "j"):
            self.paint({"J": "lineCap", "j": "lineJoin"}[name], int(n[-1]))
        elif name == "d":
            self.paint("dashPattern", {"array": [plain_decimal(x) for x in operands[-2] if isinstance(x, Decimal)], "phase": plain_decimal(n[-1])})
        elif name in ("ri", "gs", "sh"):
            self.paint({"ri": "renderingIntent", "gs": "extGState", "sh": "shading"}[name], str(operands[-1]))
        elif name == "Tf":
            s["font"], s["size"] = operands[0], n[0]
        elif name == "TL":
            s["leading"] = n[0]
        elif name in ("Td", "TD"):
            self.origin = (self.origin[0] + n[0], self.origin[1] + n[1])
            if name == "TD":
                s["leading"] = -n[1]
        elif name == "Tm":
            self.origin = (n[4], n[5])
        elif name in ("Tj", "TJ", "'", '"'):
            parts = operands[0] if name == "TJ" else operands[-1:]
            self.out.append(("text", b"".join(p for p in parts if isinstance(p, bytes)), s["font"], s["size"], apply(s["matrix"], *self.origin), offset))
        elif name == "m":
            self.path.append({"kind": "move", "to": self.point(*n[:2])})
        elif name == "l":
            self.path.append({"kind": "line", "to": self.point(*n[:2])})
        elif name in ("c", "v", "y"):
            self.path.append({"kind": "bezier", "points": [self.point(n[k], n[k + 1]) for k in range(0, len(n) - 1, 2)]})
        elif name == "re":
            x, y, w, h = n[:4]
            self.path += [{"kind": "move", "to": self.point(x, y)}, *({"kind": "line", "to": self.point(*p)} for p in ((x + w, y), (x + w, y + h), (x, y + h))), {"kind": "close"}]
        elif name == "h":
            self.path.append({"kind": "close"})
        elif name in ("W", "W*"):
            self.out.append(("clip", list(self.path), offset, name, {}))
        elif name in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
            if name in ("s", "b", "b*"):
                self.path.append({"kind": "close"})
            if self.path and name != "n":
                self.out.append(("path", self.path, offset, name, s["paint"]))
            self.path = []
        elif name == "Do":
            self.out.append(("object", operands[0], offset))
        elif name not in SILENT:
            self.unknown.append(f"operator {name}")


def convert(raw: bytes, limits: Limits, profile: str | None = None) -> dict:
    file = File(raw, limits)
    builder = Builder("pdf", file.version, limits)
    pages = file.pages()
    if not pages:
        raise SourceError("no pages")
    drawn, surfaces, placed = [], [], []
    for ordinal, page in enumerate(pages):
        space = builder.add("coordinateSpaces", unit="pt", origin={"x": "0", "y": "0"})["coordinateSpaceId"]
        box = file.get(page.get("CropBox") or page.get("MediaBox")) or []
        surface = builder.add("surfaces", partId=builder.part, kind="page", ordinal=ordinal, coordinateSpaceId=space)
        surface["box"] = [plain_decimal(x) for x in map(file.get, box) if isinstance(x, Decimal)]
        surfaces.append(surface["surfaceId"])
        placed.append((page, space))
    context = _Context(builder, file, limits, {page["number"]: s for (page, _), s in zip(placed, surfaces) if page["number"] is not None})
    for page, space in placed:
        section = builder.node("section")
        drawn.append([])
        _page(context, page, section, space, drawn[-1])
    _object_graph(builder, file)
    builder.add("orders", kind="page-tree", ownerId=builder.part, items=[{"id": s, "ordinal": k} for k, s in enumerate(surfaces)], status="preserved")
    for surface, nodes in zip(surfaces, drawn):
        for kind in ("draw", "reading"):
            builder.add("orders", kind=kind, ownerId=surface, items=[{"id": x, "ordinal": k} for k, x in enumerate(nodes)], status="preserved" if kind == "draw" else "approximated")
    for what in file.lost:
        builder.unsupported("stream", f"{what} is not decoded", builder.root)
    return builder.finish()


class _Context:
    """What pages of a file share: its fonts as resources, and where its destinations lead."""

    def __init__(self, builder: Builder, file: File, limits: Limits, surfaces: dict[int, str]):
        self.builder, self.file, self.limits, self.surfaces = builder, file, limits, surfaces
        self.named = file.destinations()
        self.fonts: dict[int, str] = {}

    def font(self, value) -> str | None:
        """The resource of a font, one for each font object."""
        font = self.file.get(value)
        if not isinstance(font, dict):
            return None
        if not isinstance(value, Ref) or value.number not in self.fonts:
            inner = self.file.get((self.file.get(font.get("DescendantFonts")) or [None])[0]) or font
            description = self.file.get(inner.get("FontDescriptor")) or {}
            embedded, encoding = any(k in description for k in ("FontFile", "FontFile2", "FontFile3")), self.file.get(font.get("Encoding"))
            made = self.builder.add("resources", kind="font", mediaType="application/pdf-font", name=str(font.get("BaseFont", "")), subtype=str(font.get("Subtype", "")), encoding=str(encoding) if isinstance(encoding, Name) else "custom" if encoding else None, unicodeMap="ToUnicode" in font, availability="available" if embedded else "missing")["resourceId"]
            if not isinstance(value, Ref):
                return made
            self.fonts[value.number] = made
        return self.fonts[value.number]

    def destination(self, value) -> dict | None:
        """Where a destination leads: a page of the file with its view, or a name that the file does not define."""
        value = self.file.get(value)
        name = str(value) if isinstance(value, Name) else value.decode("latin-1") if isinstance(value, bytes) else None
        if name is not None:
            value = self.named.get(name)
            value = self.file.get(value.get("D")) if isinstance(value, dict) else value
        if isinstance(value, list) and value:
            page = self.surfaces.get(value[0].number) if isinstance(value[0], Ref) else None
            view = str(value[1]) if len(value) > 1 and isinstance(value[1], Name) else None
            numbers = [plain_decimal(x) if isinstance(x, Decimal) else None for x in map(self.file.get, value[2:])]
            return {k: v for k, v in {"name": name, "surfaceId": page, "view": view, "position": numbers}.items() if v is not None}
        return {"name": name} if name is not None else None


def _object_graph(builder: Builder, file: File) -> None:
    """Every object as a part, every reference from one to another as a relation; missing objects as resources."""
    parts = {n: builder.add("parts", kind="object", name=f"{n} 0 obj", parentPartId=builder.part, rootNodeIds=[], relationshipIds=[], status="preserved")["partId"] for n in sorted(file.objects)}
    absent: dict[int, str] = {}
    for number, part in parts.items():
        for target in file.references(number):
            if target not in parts and target not in absent:
                absent[target] = builder.add("resources", kind="embeddedObject", mediaType="application/pdf-object", availability="unavailable", derivedHandle=f"{target} 0 R")["resourceId"]
            made = builder.add("relations", kind="references", fromId=part, toId=parts.get(target) or absent[target], type="indirect-reference", targetMode="internal", status="preserved" if target in parts else "unavailable")
            builder.by_id[part]["relationshipIds"].append(made["relationId"])
    if file.authentic:
        builder.feature("cross-reference")
    else:
        builder.unsupported("cross-reference", "objects were found by scanning", builder.root, "ambiguous")


def _page(context: _Context, page: dict, section: str, space: str, drawn: list[str]) -> None:
    builder, file, limits = context.builder, context.file, context.limits
    resources = file.get(page.get("Resources")) or {}
    fonts, maps = file.get(resources.get("Font")) or {}, {}
    named = [{"name": str(name), "resourceId": found} for name, ref in fonts.items() if (found := context.font(ref))]
    listed = {str(k): sorted(map(str, v)) for k, value in resources.items() if isinstance(v := file.get(value), dict) and k != "Font"}
    if named or listed:
        builder.add("extensions", targetId=section, namespace="format:pdf", type="page-resources", schemaVersion="1.0.0", criticality="non-critical", payload={"fonts": named, "names": listed})
    for name, ref in fonts.items():
        font = file.get(ref)
        target = font.get("ToUnicode") if isinstance(font, dict) else None
        body = file.stream(target.number) if isinstance(target, Ref) else None
        maps[name] = character_map(body, limits) if body is not None else None
    contents = file.get(page.get("Contents")) if not isinstance(page.get("Contents"), Ref) or isinstance(file.get(page["Contents"]), list) else [page["Contents"]]
    streams = [file.stream(r.number) for r in contents or [] if isinstance(r, Ref)]
    interpreter = Interpreter().run(b"\n".join(s for s in streams if s is not None))
    box = lambda x, y, w, h: [{"kind": "rectangle", "x": plain_decimal(x), "y": plain_decimal(y), "width": {"value": plain_decimal(w), "unit": "pt"}, "height": {"value": plain_decimal(h), "unit": "pt"}}]
    for kind, *rest in interpreter.out:
        if kind == "text":
            code, font, size, (x, y), offset = rest
            value = decode(code, maps.get(font)) if font in maps else None
            status = "approximated" if value is not None else "unsupported" if font not in maps else "ambiguous"
            width = Decimal(max(1, len(value or ""))) * size / 2
            geometry = builder.geometry(space, "rectangle", box(x, y, width, size), "approximated")
            node = builder.node("glyph", section, status, geometryId=geometry)
            if value is not None:
                builder.texts(node, value)
                builder.feature("text", "approximated", node)
            else:
                builder.unsupported("text", f"codes at {offset} have no full mapping", node, status)
            observed = {"targetId": node, "engine": "none", "status": "unavailable"}
            builder.add("observations", kind="renderer", method="render", **observed)
            builder.add("observations", kind="ocr", method="recognise", **observed)
            drawn.append(node)
        elif kind in ("path", "clip"):
            segments, offset, operator, paint = rest
            node = builder.node("path", section, geometryId=builder.geometry(space, "clip" if kind == "clip" else "bezier", [{"kind": "clip" if kind == "clip" else "bezier", "segments": segments}]))
            builder.add("extensions", targetId=node, namespace="format:pdf", type="paint", schemaVersion="1.0.0", criticality="non-critical", payload={"operator": operator, "offset": offset, **({"state": paint} if paint else {})})
            builder.feature(kind, target=node)
            drawn.append(node)
        else:
            builder.unsupported("external-object", f"{rest[0]} is not decoded", section)
    for what in dict.fromkeys(interpreter.unknown):
        builder.unsupported("operator", what, section)
    for ref in file.get(page.get("Annots")) or []:
        note = file.get(ref)
        if not isinstance(note, dict):
            continue
        subtype = note.get("Subtype", "")
        kind = {"Link": "hyperlink", "Widget": "form"}.get(subtype, "comment")
        action = file.get(note.get("A")) or {}
        say = lambda v: v.decode("utf-16") if isinstance(v, bytes) and v[:2] in (b"\xfe\xff", b"\xff\xfe") else v.decode("latin-1") if isinstance(v, bytes) else None
        parent = file.get(note.get("Parent")) if subtype == "Popup" else None
        body = say(action.get("URI")) or say(note.get("Contents")) or (say(parent.get("Contents")) if isinstance(parent, dict) else None) or ""
        rect = [file.get(v) for v in file.get(note.get("Rect")) or []]
        node = builder.node("annotation", section)
        if len(rect) == 4 and all(isinstance(v, Decimal) for v in rect):
            builder.by_id[node]["geometryId"] = builder.geometry(space, "rectangle", box(min(rect[0], rect[2]), min(rect[1], rect[3]), abs(rect[2] - rect[0]), abs(rect[3] - rect[1])))
        quads = [file.get(v) for v in file.get(note.get("QuadPoints")) or []]
        quads = [plain_decimal(v) for v in quads] if quads and len(quads) % 8 == 0 and all(isinstance(v, Decimal) for v in quads) else None
        stated = note.get("Dest") if note.get("Dest") is not None else action.get("D") if action.get("S") == "GoTo" else None
        leads = context.destination(stated) if stated is not None else None
        lost = stated is not None and not (leads and leads.get("surfaceId"))
        builder.add("annotations", kind=kind, targetIds=[node], body=body[:4096], sourceSubtype=f"pdf:{subtype}", quadPoints=quads, destination=leads, status="ambiguous" if lost else "preserved")
        known = subtype in ("Link", "Text", "FreeText", "Popup") and action.get("S") in (None, "URI", "GoTo")
        if lost:
            builder.unsupported("annotation", "the destination is no page of the file", node, "ambiguous")
        else:
            builder.feature("annotation", target=node) if known else builder.unsupported("annotation", f"{subtype} with action {action.get('S')}", node)
