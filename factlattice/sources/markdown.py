"""Markdown: blocks by a line machine, inlines by a scanner."""

from __future__ import annotations

import html
import mimetypes
import re
from bisect import bisect_right
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

from factlattice.sources.ir import Builder, Limits, SourceError

NESTING = 32
#: What a dialect adds to the common core.
DIALECTS = {"commonmark": frozenset(), "gfm": frozenset({"table", "task", "strikethrough", "footnote", "autolink"})}

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^`]*)$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_ITEM = re.compile(r"([ \t]*)([-*+]|(\d{1,9})[.)])(?:[ \t]+(.*)|$)")
_QUOTE = re.compile(r" {0,3}> ?(.*)$")
_FOOTNOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$")
_DEFINITION = re.compile(r" {0,3}\[([^\]^][^\]]*)\]:[ \t]*<?([^\s>]+)>?(?:[ \t]+[\"'(](.*)[\"')])?[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:[A-Za-z][\w-]*[\s/>]|/[A-Za-z]|!--|\?|!\[CDATA\[)")
_RULE = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_TASK = re.compile(r"\[([ xX])\][ \t]+")


@dataclass
class Block:
    """kind, its lines from first to last (0-based, inclusive), its own text and blocks inside."""

    kind: str
    first: int
    last: int
    text: str = ""
    info: dict = field(default_factory=dict)
    inside: list[Block] = field(default_factory=list)
    status: str = "preserved"


def split_lines(text: str) -> list[str]:
    return re.split(r"\r\n|\n|\r", text)


def label(text: str) -> str:
    return re.sub(r"\s+", " ", text.strip()).casefold()


def split_cells(line: str) -> list[str]:
    """Cells of a table row; pipes that are escaped or inside code spans do not divide."""
    cells, now, k, ticks = [], "", 0, 0
    line = line.strip()
    while k < len(line):
        c = line[k]
        if c == "\\" and k + 1 < len(line):
            now, k = now + line[k : k + 2], k + 2
            continue
        if c == "`":
            run = len(line[k:]) - len(line[k:].lstrip("`"))
            ticks = run if not ticks and "`" * run in line[k + run :] else 0 if run == ticks else ticks
            now, k = now + "`" * run, k + run
            continue
        if c == "|" and not ticks:
            cells.append(now)
            now = ""
        else:
            now += c
        k += 1
    cells.append(now)
    if cells and not cells[0].strip() and line.startswith("|"):
        cells = cells[1:]
    if cells and not cells[-1].strip() and line.endswith("|") and not line.endswith("\\|"):
        cells = cells[:-1]
    return [c.strip().replace("\\|", "|") for c in cells]


class Blocks:
    """One pass over lines. Each step asks, in this order: directive, fence, break, heading, setext heading, indented
    code, HTML, footnote, definition, list, table, quote; what is left is a paragraph up to a blank line or a block."""

    def __init__(self, dialect: frozenset[str]):
        self.dialect = dialect

    def parse(self, lines: list[str], at: int = 0, depth: int = 0) -> list[Block]:
        if depth > NESTING:
            raise SourceError(f"nested deeper than {NESTING}")
        out, k = [], 0
        while k < len(lines):
            if not lines[k].strip():
                k += 1
                continue
            block, k = self.next(lines, k, at, depth)
            out.append(block)
        return out

    def starts(self, lines: list[str], k: int) -> bool:
        line = lines[k]
        return bool(not line.strip() or line.lstrip().startswith(":::") or _FENCE.match(line) or _BREAK.match(line) or _ATX.match(line) or _HTML.match(line) or _ITEM.match(line) or _QUOTE.match(line) or _FOOTNOTE.match(line) or self.is_table(lines, k))

    def is_table(self, lines: list[str], k: int) -> bool:
        return "table" in self.dialect and "|" in lines[k] and k + 1 < len(lines) and "-" in lines[k + 1] and bool(_RULE.match(lines[k + 1])) and len(split_cells(lines[k])) == len(split_cells(lines[k + 1]))

    def next(self, lines: list[str], k: int, at: int, depth: int) -> tuple[Block, int]:
        line = lines[k]
        block = lambda kind, end, text="", **more: (Block(kind, at + k, at + end - 1, text, **more), end)
        if line.lstrip().startswith(":::"):
            return block("directive", k + 1, line, status="unsupported")
        if m := _FENCE.match(line):
            mark, end = m[1], k + 1
            while end < len(lines) and not re.match(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[end]):
                end += 1
            closed = end < len(lines)
            return block("code", end + closed, "\n".join(lines[k + 1 : end]), info={"fence": mark, "language": m[2].strip()}, status="preserved" if closed else "unsupported")
        if _BREAK.match(line):
            return block("break", k + 1)
        if m := _ATX.match(line):
            return block("heading", k + 1, m[2] or "", info={"level": len(m[1]), "style": "atx"})
        if k + 1 < len(lines) and (m := _SETEXT.match(lines[k + 1])) and not self.starts(lines, k) and not line.startswith(("    ", "\t")):
            return block("heading", k + 2, line.strip(), info={"level": 1 if m[1][0] == "=" else 2, "style": "setext"})
        if line.startswith(("    ", "\t")):
            end = k
            while end < len(lines) and (lines[end].startswith(("    ", "\t")) or not lines[end].strip()):
                end += 1
            while not lines[end - 1].strip():
                end -= 1
            return block("code", end, "\n".join(re.sub(r"^(?: {4}|\t)", "", x) for x in lines[k:end]), info={"fence": ""}, status="unsupported")
        if _HTML.match(line):
            end = k
            while end < len(lines) and lines[end].strip():
                end += 1
            return block("html", end, "\n".join(lines[k:end]), status="unsupported")
        if m := _FOOTNOTE.match(line):
            end = k + 1
            while end < len(lines) and lines[end].startswith(("    ", "\t")):
                end += 1
            ok = "footnote" in self.dialect
            return block("footnote", end, "\n".join([m[2], *(x.strip() for x in lines[k + 1 : end])]), info={"label": label(m[1])}, status="preserved" if ok else "unsupported")
        if m := _DEFINITION.match(line):
            return block("definition", k + 1, line, info={"label": label(m[1]), "target": m[2], "title": m[3] or ""})
        if _ITEM.match(line):
            return self.list(lines, k, at, depth)
        if self.is_table(lines, k):
            end = k + 2
            while end < len(lines) and "|" in lines[end] and lines[end].strip():
                end += 1
            align = ["center" if c.startswith(":") and c.endswith(":") else "left" if c.startswith(":") else "right" if c.endswith(":") else "none" for c in split_cells(lines[k + 1])]
            return block("table", end, info={"alignment": align, "rows": [split_cells(lines[k]), *map(split_cells, lines[k + 2 : end])]})
        if _QUOTE.match(line):
            end = k
            while end < len(lines) and _QUOTE.match(lines[end]):
                end += 1
            inside = self.parse([_QUOTE.match(x)[1] for x in lines[k:end]], at + k, depth + 1)
            return block("quote", end, inside=inside)
        end = k + 1
        while end < len(lines) and not self.starts(lines, end):
            if _SETEXT.match(lines[end]):
                break
            end += 1
        return block("paragraph", end, "\n".join(x.lstrip(" \t") for x in lines[k:end]))

    def list(self, lines: list[str], k: int, at: int, depth: int) -> tuple[Block, int]:
        """Items by their indents: an item belongs to the last one before it that is less indented."""
        root, end = Block("list", at + k, at + k), k
        stack: list[tuple[int, Block]] = [(-1, root)]
        while end < len(lines) and (m := _ITEM.match(lines[end])) and not _BREAK.match(lines[end]):
            indent = len(m[1].expandtabs(4))
            while stack[-1][0] >= indent:
                stack.pop()
            if depth + len(stack) > NESTING:
                raise SourceError(f"nested deeper than {NESTING}")
            text, info, status = m[4] or "", {"marker": m[2], "level": len(stack)}, "preserved"
            if m[3]:
                info["number"] = int(m[3])
            if t := _TASK.match(text):
                info["checked"], text = t[1] != " ", text[t.end() :]
                status = "preserved" if "task" in self.dialect else "unsupported"
            item = Block("item", at + end, at + end, text, info, status=status)
            stack[-1][1].inside.append(item)
            stack.append((indent, item))
            end += 1
            while end < len(lines) and lines[end].strip() and not self.starts(lines, end):
                item.text += "\n" + lines[end].strip()
                item.last = at + end
                end += 1
        root.last = at + end - 1
        return root, end


@dataclass(frozen=True)
class Token:
    kind: str
    raw: str
    start: int
    end: int
    text: str = ""
    target: str = ""
    status: str = "preserved"


_INLINE = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<code>`+)|(?P<strike>~~(?=\S)(?P<struck>.+?)(?<=\S)~~)|(?P<foot>\[\^(?P<note>[^\]\s]+)\])"
    r"|(?P<link>!?\[)|(?P<auto><(?P<uri>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>)|(?P<bare>https?://[^\s<>]+)|(?P<tag></?[A-Za-z][^<>]*>|<!--.*?-->)"
    r"|(?P<emph>\*{1,3}(?=[^\s*])|(?<!\w)_{1,3}(?=[^\s_]))|(?P<hard>(?: {2,}|\\)\n)", re.S,
)


def _closing_bracket(text: str, k: int) -> int:
    """Where the bracket that opens at k closes; -1 if it does not."""
    depth = 0
    for m in re.compile(r"\\.|[\[\]]", re.S).finditer(text, k):
        depth += {"[": 1, "]": -1}.get(m[0], 0)
        if not depth and m[0] == "]":
            return m.start()
    return -1


def scan_inlines(text: str, labels: frozenset[str] | set[str] = frozenset(), dialect: frozenset[str] = DIALECTS["gfm"]) -> list[Token]:
    """The text as tokens that lie one after the other and cover all of it."""
    out, k, plain = [], 0, 0

    def put(token: Token) -> int:
        nonlocal plain
        if token.start > plain:
            out.append(Token("text", text[plain : token.start], plain, token.start, html.unescape(text[plain : token.start])))
        out.append(token)
        plain = token.end
        return token.end

    while m := _INLINE.search(text, k):
        a, b, kind = m.start(), m.end(), m.lastgroup
        kind = next(n for n in ("escape", "code", "strike", "foot", "link", "auto", "bare", "tag", "emph", "hard") if m[n] is not None)
        if kind == "escape":
            k = put(Token("escape", m[0], a, b, m[0][1:]))
        elif kind == "code":
            end = re.compile(rf"(?<!`){m[0]}(?!`)").search(text, b)
            k = put(Token("code", text[a : end.end()], a, end.end(), re.sub(r"^ (.*[^ ].*) $", r"\1", text[b : end.start()].replace("\n", " ")))) if end else put(Token("unclosed-code", m[0], a, b, m[0], status="unsupported"))
        elif kind == "strike" and "strikethrough" in dialect:
            k = put(Token("strikethrough", m[0], a, b, normal_text(m["struck"], labels, dialect)))
        elif kind == "foot" and "footnote" in dialect:
            k = put(Token("footnote-reference", m[0], a, b, "", label(m["note"])))
        elif kind == "link":
            image, close = m[0] == "![", _closing_bracket(text, b - 1)
            name = "image" if image else "link"
            if close < 0:
                k = put(Token(f"unclosed-{name}", m[0], a, b, m[0], status="unsupported"))
                continue
            words = text[b:close]
            inline = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)").match(text, close + 1)
            full = re.compile(r"\[([^\]]*)\]").match(text, close + 1)
            shown = words if image else normal_text(words, labels, dialect)
            if inline:
                k = put(Token(name, text[a : inline.end()], a, inline.end(), shown, inline[1] or inline[2] or ""))
            elif full and label(full[1] or words) in labels:
                k = put(Token(f"reference-{name}", text[a : full.end()], a, full.end(), shown, label(full[1] or words)))
            elif label(words) in labels:
                k = put(Token(f"reference-{name}", text[a : close + 1], a, close + 1, shown, label(words)))
            elif text[close + 1 : close + 2] == "(":
                k = put(Token(f"unclosed-{name}", text[a : close + 2], a, close + 2, text[a : close + 2], status="unsupported"))
            else:
                k = b
        elif kind == "auto":
            k = put(Token("autolink", m[0], a, b, m["uri"], m["uri"]))
        elif kind == "bare" and "autolink" in dialect:
            raw = m[0].rstrip(".,:;!?*_~'\")")
            k = put(Token("autolink", raw, a, a + len(raw), raw, raw))
        elif kind == "tag":
            k = put(Token("raw-html", m[0], a, b, "", status="unsupported"))
        elif kind == "emph":
            end = re.compile(rf"(?<=[^\s\\]){re.escape(m[0])}(?!{re.escape(m[0][0])})" + (r"(?!\w)" if m[0][0] == "_" else "")).search(text, b)
            k = put(Token({1: "emphasis", 2: "strong", 3: "strong-emphasis"}[len(m[0])], text[a : end.end()], a, end.end(), normal_text(text[b : end.start()], labels, dialect))) if end else put(Token("unclosed-emphasis", m[0], a, b, m[0], status="unsupported"))
        elif kind == "hard":
            k = put(Token("line-break", m[0], a, b, "\n"))
        else:
            k = b
    if plain < len(text):
        out.append(Token("text", text[plain:], plain, len(text), html.unescape(text[plain:])))
    return out


def normal_text(text: str, labels=frozenset(), dialect: frozenset[str] = DIALECTS["gfm"]) -> str:
    """The text without its markup."""
    return "".join(t.text for t in scan_inlines(text, labels, dialect))


def front_matter(lines: list[str]) -> tuple[dict[str, str], int]:
    """Scalar entries between --- at the very first line and the next ---; and the lines they take."""
    if not lines or lines[0].rstrip() != "---":
        return {}, 0
    end = next((k for k in range(1, len(lines)) if lines[k].rstrip() in ("---", "...")), 0)
    entries = [re.match(r"([A-Za-z_][\w.-]*):[ \t]*(.*)$", x) for x in lines[1:end]]
    return {m[1]: m[2].strip().strip("\"'") for m in entries if m}, end + 1 if end else 0


class Source:
    """Where pieces of blocks stand in the text: half-open spans of code points and of bytes."""

    def __init__(self, text: str, marked: int = 0):
        self.text = text
        ends = [m.end() for m in re.finditer(r"\r\n|\n|\r", text)]
        self.starts = [0, *ends]
        self.bytes = [marked]
        for a, b in zip(self.starts, ends):
            self.bytes.append(self.bytes[-1] + len(text[a:b].encode()))

    def line(self, k: int) -> int:
        return self.starts[k] if k < len(self.starts) else len(self.text)

    def _byte(self, at: int) -> int:
        k = bisect_right(self.starts, at) - 1
        return self.bytes[k] + len(self.text[self.starts[k] : at].encode())

    def find(self, raw: str, at: int, end: int) -> tuple[int, int] | None:
        """The first place of a piece; line ends of any kind, with the indents and marks of the next line, count as one."""
        if "\n" not in raw:
            k = self.text.find(raw, at, end)
            return (k, k + len(raw)) if k >= 0 else None
        m = re.compile(r"(?:\r\n|\n|\r)[ \t>]*".join(map(re.escape, raw.split("\n")))).search(self.text, at, end)
        return m.span() if m else None

    def locator(self, start: int, end: int) -> dict:
        return {"kind": "span", "start": start, "end": end, "byteStart": self._byte(start), "byteEnd": self._byte(end)}


def is_external(target: str) -> bool:
    return bool(re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//", target))


def linked(target: str, kind: str) -> dict:
    """A linked resource; nothing is fetched or looked for, and the payload of a data URL is not kept."""
    parts = urlsplit(target) if "[" not in target and "]" not in target else urlsplit("")
    if parts.scheme == "data":
        media = parts.path.partition(",")[0].partition(";")[0] or "application/octet-stream"
        handle = f"data:{media}"
    else:
        media = (mimetypes.guess_type(unquote(parts.path or target))[0] if kind == "image" else None) or "application/octet-stream"
        handle = target
    external = is_external(target)
    return {
        "kind": kind, "mediaType": media, "embeddedOrExternal": "external" if external else "linked", "availability": "unavailable", "decodability": "not-attempted", "packagePresence": False,
        "networkAvailability": "unknown" if external else "not-applicable", "derivedHandle": handle, **({"externalTarget": handle} if external else {}),
    }


class Links:
    """Occurrences of links: a resource for each target, a relation from each occurrence, named by its construct."""

    def __init__(self, builder: Builder, labels: dict[str, Block]):
        self.builder, self.labels = builder, labels
        self.resources: dict[tuple[str, str], str] = {}
        self.seen: dict[str, int] = {}

    def occurrence(self, kind: str, target: str) -> str:
        """The name of an occurrence; from the second of a construct on with its number."""
        where = "external" if is_external(target) else "internal" if kind != "image" else "local"
        base = {"reference-link": "md-reference-link", "reference-image": "md-reference-image", "image": f"md-{where}-image", "autolink": "md-autolink"}.get(kind, f"md-inline-{where}")
        self.seen[base] = self.seen.get(base, 0) + 1
        return base if self.seen[base] == 1 else f"{base}-{self.seen[base]}"

    def add(self, run: str, token: Token) -> None:
        if token.kind not in ("link", "image", "autolink", "reference-link", "reference-image"):
            return
        if token.kind.startswith("reference-"):
            block = self.labels.get(token.target)
            target = block.info.get("target", "") if block is not None else ""
            if not target:
                return
        else:
            target = token.target
        kind = "image" if token.kind.endswith("image") else "link"
        if kind == "link" and token.kind == "autolink" and "@" in target and ":" not in target:
            target = f"mailto:{target}"
        if (kind, target) not in self.resources:
            made = self.builder.add("resources", **linked(target, kind))["resourceId"]
            self.builder.add("observations", kind="measurement", targetId=made, method="resolution-not-configured", engine="none", status="unavailable")
            self.resources[kind, target] = made
        made = self.resources[kind, target]
        handle = self.builder.by_id[made]["derivedHandle"]
        self.builder.add("relations", kind="links", fromId=run, toId=made, type=token.kind, target=handle, targetMode="external" if is_external(target) else "internal", sourceOccurrenceId=self.occurrence(token.kind, target), status="preserved")
        if kind == "image":
            self.builder.by_id[run].setdefault("resourceIds", []).append(made)


def convert(raw: bytes, limits: Limits, profile: str = "gfm") -> dict:
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError as error:
        raise SourceError("not UTF-8") from error
    if not text.strip() or "\0" in text:
        raise SourceError("empty, or holds a NUL character")
    dialect = DIALECTS.get(profile, frozenset())
    builder = Builder("markdown", profile, limits)
    lines, source = split_lines(text), Source(text, 3 if raw.startswith(b"\xef\xbb\xbf") else 0)
    meta, skip = front_matter(lines)
    if skip:
        builder.add("extensions", targetId=builder.root, namespace="format:markdown", type="front-matter", schemaVersion="1.0.0", criticality="non-critical", payload={"entries": [{"key": k, "value": v} for k, v in meta.items()]})
        builder.feature("front-matter")
    blocks = Blocks(dialect).parse(lines[skip:], skip)
    labels: dict[str, Block] = {}

    def gather(found: list[Block]):
        for b in found:
            if b.kind in ("definition", "footnote"):
                if (b.kind, b.info["label"]) in seen:
                    b.status = "ambiguous"
                seen.add((b.kind, b.info["label"]))
                labels.setdefault(b.info["label"], b)
            gather(b.inside)

    seen: set = set()
    gather(blocks)
    kinds = {"code": "paragraph", "break": "thematicBreak", "html": "paragraph", "directive": "paragraph", "definition": "resource", "quote": "section", "item": "paragraph"}

    links = Links(builder, {name: b for name, b in labels.items() if b.kind == "definition"})

    def runs(node: str, words: str, first: int, last: int):
        at, end = source.line(first), source.line(last + 1)
        for token in scan_inlines(words, labels.keys(), dialect):
            run = builder.node("run", node, token.status)
            if place := source.find(token.raw, at, end):
                at = place[1]
                builder.add("sourceMaps", targetId=run, format={"name": "markdown"}, locator=source.locator(*place))
            links.add(run, token)
            builder.texts(run, token.raw, token.text)
            if token.kind != "text":
                builder.feature(f"inline-{token.kind}", token.status, run, builder.diagnostic("MARKDOWN-INLINE", f"{token.kind} is kept as text", target=run) if token.status == "unsupported" else None)
            if token.target:
                builder.add("extensions", targetId=run, namespace="format:markdown", type="authoring-facts", schemaVersion="1.0.0", criticality="non-critical", payload={"kind": token.kind, "target": token.target})

    def emit(found: list[Block], parent: str):
        for b in found:
            node = builder.node(kinds.get(b.kind, b.kind), parent, b.status)
            builder.add("sourceMaps", targetId=node, format={"name": "markdown"}, locator={"kind": "lines", "lineStart": b.first + 1, "lineEnd": b.last + 1})
            builder.feature(b.kind, b.status, node, builder.diagnostic(f"MARKDOWN-{b.kind}".upper(), f"{b.kind} is {b.status}", target=node) if b.status != "preserved" else None)
            if b.info and b.kind != "table":
                builder.add("extensions", targetId=node, namespace="format:markdown", type={"code": "code-block", "heading": "heading-authoring", "item": "list-marker", "definition": "reference-definition"}.get(b.kind, "authoring-facts"), schemaVersion="1.0.0", criticality="non-critical", payload=b.info)
            if b.kind == "table":
                width = max(map(len, b.info["rows"]))  # a row may be wider than the one that states the alignment
                align = (b.info["alignment"] + ["none"] * width)[:width]
                columns = [builder.node("column", node) for _ in align]
                rows, cells = [], []
                for r, row in enumerate(b.info["rows"]):
                    rows.append(builder.node("row", node))
                    for c, value in enumerate(row + [""] * (width - len(row))):
                        cells.append(builder.node("cell", rows[-1], address={"row": r + 1, "column": c + 1}))
                        line = b.first + r + (r > 0)
                        runs(cells[-1], value, line, line)
                builder.add("tables", nodeId=node, rowIds=rows, columnIds=columns, cellIds=cells, alignment=align, status="preserved")
            elif b.kind in ("code", "html", "directive"):
                run = builder.node("run", node, b.status)
                builder.text(run, b.text)
            elif b.text and b.kind != "definition":
                runs(node, b.text, b.first, b.last)
            emit(b.inside, node)

    emit(blocks, builder.root)
    return builder.finish()
