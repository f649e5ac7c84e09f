"""DOCX packages: paragraphs, runs, styles, tables, fields, drawings, notes and comments."""

from __future__ import annotations

import re
from decimal import Decimal

from factlattice.sources.colours import Layer, rgb_value, theme_colours
from factlattice.sources.containers import Package, attribute, below, child, children, local
from factlattice.sources.ir import Builder, Limits, SourceError, plain_decimal

OFF = ("0", "false", "off", "no", "none")
VISUAL = {"drawing": "shape", "pict": "shape", "object": "shape"}
#: Names of theme colours in text and the theme's slots. Fixed values of the format.
THEME_SLOTS = {"text1": "dk1", "dark1": "dk1", "background1": "lt1", "light1": "lt1", "text2": "dk2", "dark2": "dk2", "background2": "lt2", "light2": "lt2", "hyperlink": "hlink", "followedHyperlink": "folHlink"}
#: How text flows around a drawing. Fixed values of the format.
WRAPS = {"wrapNone": "none", "wrapSquare": "square", "wrapTight": "tight", "wrapThrough": "through", "wrapTopAndBottom": "top-bottom"}
QUIET = {"rPr", "pPr", "lastRenderedPageBreak", "proofErr", "bookmarkEnd", "commentRangeStart", "commentRangeEnd", "softHyphen", "noBreakHyphen", "permStart", "permEnd", "annotationRef", "footnoteRef", "endnoteRef", "separator", "continuationSeparator"}


def theme_shade(colour: dict, tint: str | None, shade: str | None) -> dict:
    """A theme colour moved towards white by a hexadecimal tint, then towards black by a shade."""
    share = lambda x: int(x, 16) / 255 if re.fullmatch("[0-9A-Fa-f]{1,2}", x or "") else 0.0
    lighter = {k: round(colour[k] + (255 - colour[k]) * share(tint)) for k in "rgb"}
    return {**colour, **{k: round(v * (1 - share(shade))) for k, v in lighter.items()}}


def text_colour(element, theme: dict[str, dict]) -> tuple[dict, dict, str | None]:
    """(authored, resolved, issue) of a colour of text; what cannot be resolved stays as it was written."""
    if slot := attribute(element, "themeColor"):
        token = {"kind": "theme", "slot": slot}
        found = theme.get(THEME_SLOTS.get(slot, slot))
        return (token, theme_shade(found, attribute(element, "themeTint"), attribute(element, "themeShade")), None) if found else (token, token, f"the theme has no colour {slot}")
    value = (attribute(element, "val") or "").lstrip("#")
    if re.fullmatch("[0-9A-Fa-f]{6}", value):
        made = rgb_value(value)
        return made, made, None
    token = {"kind": "theme", "slot": "auto" if value.lower() == "auto" else "unresolved"}
    return token, token, "an automatic colour depends on what is behind it" if token["slot"] == "auto" else f"{value!r} is no colour"


def run_properties(element, theme: dict[str, dict] | None = None) -> Layer:
    """Properties that a style, a paragraph or a run states: sizes in points, toggles as true or false."""
    out, layer = {}, Layer()
    for p in element if element is not None else ():
        name, value = local(p), attribute(p, "val")
        if name in ("b", "i", "strike", "caps", "smallCaps", "vanish"):
            out[{"b": "bold", "i": "italic", "vanish": "hidden"}.get(name, name)] = "false" if value in OFF else "true"
        elif name == "sz" and (value or "").isdigit():
            out["size"] = plain_decimal(f"{int(value) / 2}")
        elif name == "u":
            out["underline"] = value if value in ("single", "double", "dotted", "dash", "wave", "thick", "none", "words") else "single"
        elif name == "color" and (value or attribute(p, "themeColor")):
            authored, resolved, issue = text_colour(p, theme or {})
            layer.put("color", authored, resolved)
            layer.issues += [issue] if issue else []
        elif name == "rFonts" and attribute(p, "ascii"):
            out["font"] = attribute(p, "ascii")
        elif name == "jc" and value:
            out["align"] = "justify" if value == "both" else value
        elif name == "spacing":
            out |= {f"spacing-{k}": plain_decimal(f"{int(attribute(p, k)) / 20}") for k in ("before", "after") if re.fullmatch(r"-?\d+", attribute(p, k) or "")}
        elif name in ("highlight", "vertAlign", "lang") and value:
            out[name] = value
    layer.authored |= out
    layer.resolved |= out
    return layer


def resolve_styles(own: dict[str, dict], defaults: Layer) -> dict[str, tuple[dict, dict, list[str]]]:
    """style -> (properties, source of each, issues): its chain of bases overlaid, the nearest last."""
    out = {}
    for name in own:
        chain, now, issues = [], name, []
        while now is not None:
            if now in chain or now not in own:
                issues.append(f"style {name} has no sound chain of bases")
                break
            chain.append(now)
            now = own[now]["based_on"]
        values, sources = dict(defaults.resolved), dict.fromkeys(defaults.resolved, "defaults")
        for style in reversed(chain):
            values |= own[style]["layer"].resolved
            sources |= dict.fromkeys(own[style]["layer"].resolved, style)
            issues += own[style]["layer"].issues
        out[name] = (values, sources, issues)
    return out


def convert(raw: bytes, limits: Limits, profile: str | None = None) -> dict:
    package = Package(raw, limits)
    main = next((t for kind, t, _ in package.relations("").values() if kind == "officeDocument"), "word/document.xml")
    if main not in package.names:
        raise SourceError("no document part")
    return _Reader(package, Builder("docx", "ECMA-376", limits)).read(main)


class _Reader:
    def __init__(self, package: Package, builder: Builder):
        self.package, self.builder = package, builder
        self.styles: dict[str, str] = {}
        self.overlays: dict[tuple, tuple[str, str]] = {}
        self.theme: dict[str, dict] = {}
        self.sections: list[str] = []
        self.ended = True
        self.drawings: dict[tuple[str, str], str] = {}
        self.ends: list[tuple[str, tuple[str, str], str]] = []
        self.open_fields: list[dict] = []
        self.part = ""

    def read(self, main: str) -> dict:
        relations = self.package.relations(main)
        self.relations = relations
        for kind, target, _ in relations.values():
            if kind == "theme" and target in self.package.names:
                self.theme = theme_colours(self.package.xml(target))
        for kind, target, _ in relations.values():
            if kind == "styles" and target in self.package.names:
                self.read_styles(self.package.xml(target))
        body = child(self.package.xml(main), "body")
        if body is None:
            raise SourceError("no body")
        story = self.builder.node("story")
        self.builder.add("surfaces", partId=self.builder.part, kind="story", ordinal=0)
        self.blocks(body, story, main)
        for kind, target, _ in relations.values():
            if kind in ("header", "footer", "footnotes", "endnotes", "comments") and target in self.package.names:
                self.story(kind, self.package.xml(target), target)
            elif kind == "image":
                there = target in self.package.names
                self.builder.add("resources", kind="image", mediaType=target.rpartition(".")[2].lower(), availability="available" if there else "missing")
                self.builder.feature("image") if there else self.builder.unsupported("image", f"{target} is missing", status="failed")
        for field in self.open_fields:
            self.builder.unsupported("field", "a field that does not end", field["node"], "ambiguous")
        self.connect()
        if self.sections:
            self.builder.by_id[self.builder.part]["surfaceIds"] = self.sections
        return self.builder.finish()

    def read_styles(self, root) -> None:
        defaults = run_properties(child(child(child(root, "docDefaults"), "rPrDefault"), "rPr"), self.theme) if child(root, "docDefaults") is not None else Layer()
        own = {}
        for s in children(root, "style"):
            based, layer = child(s, "basedOn"), Layer()
            for part in ("pPr", "rPr"):
                stated = run_properties(child(s, part), self.theme)
                layer.authored |= stated.authored
                layer.resolved |= stated.resolved
                layer.issues += stated.issues
            own[attribute(s, "styleId", "")] = {"based_on": attribute(based, "val") if based is not None else None, "layer": layer, "role": "run" if attribute(s, "type") == "character" else "paragraph"}
        ids = {name: self.builder.add("styles", role=own[name]["role"], origin="named", name=name, declaration=own[name]["layer"].authored, status="preserved")["styleId"] for name in own}
        for name, (values, sources, issues) in resolve_styles(own, defaults).items():
            base, status = own[name]["based_on"], "ambiguous" if issues else "normalized"
            if base in ids and base != name and not any("chain of bases" in x for x in issues):
                self.builder.by_id[ids[name]]["basedOn"] = ids[base]
            item = self.builder.add("styles", role=own[name]["role"], origin="resolved", resolved=values, resolvedFrom=[ids[name]], propertyProvenance=[{"property": p, "source": ids.get(x, ids[name]), "status": status} for p, x in sources.items()], status=status)
            self.styles[name] = item["styleId"]
            for issue in dict.fromkeys(issues):
                self.builder.unsupported("style-resolution", issue, item["styleId"], "ambiguous")
            if not issues:
                self.builder.feature("style-resolution")

    def format(self, node: str, properties, role: str, base: str | None) -> None:
        """Formats a node by what it states itself over its base style; equal formats over one base are one style."""
        layer, own = run_properties(properties, self.theme), self.builder.by_id[node]
        if not layer.resolved:
            if base:
                own["resolvedStyleId"] = base
            return
        key = (role, base, repr(sorted(layer.authored.items())))
        if key not in self.overlays:
            below_it = self.builder.by_id[base] if base else {}
            status = "ambiguous" if layer.issues or below_it.get("status") == "ambiguous" else "normalized"
            direct = self.builder.add("styles", role=role, origin="direct", direct=layer.resolved, declaration=layer.authored, status="ambiguous" if layer.issues else "preserved")["styleId"]
            sources = {p["property"]: (p["source"], "inherit") for p in below_it.get("propertyProvenance", ())} | dict.fromkeys(layer.resolved, (direct, "direct"))
            resolved = self.builder.add(
                "styles", role=role, origin="resolved", basedOn=base, resolved=below_it.get("resolved", {}) | layer.resolved, resolvedFrom=[*([base] if base else []), direct],
                cascadeTrace=[{"property": p, "source": x, "action": action} for p, (x, action) in sources.items()], propertyProvenance=[{"property": p, "source": x, "status": status} for p, (x, _) in sources.items()], status=status,
            )["styleId"]
            for issue in dict.fromkeys(layer.issues):
                self.builder.unsupported("direct-formatting", issue, direct, "ambiguous")
            self.overlays[key] = direct, resolved
        own["directStyleId"], own["resolvedStyleId"] = self.overlays[key]

    def page(self) -> str:
        """The page surface of the section that is being read."""
        if self.ended:
            k = len(self.sections)
            self.sections.append(self.builder.add("surfaces", partId=self.builder.part, kind="page", ordinal=k, sectionBoundary=f"section-{k + 1}", status="preserved")["surfaceId"])
            self.ended = False
        return self.sections[-1]

    def story(self, kind: str, root, part: str) -> None:
        if kind in ("header", "footer"):
            self.blocks(root, self.builder.node("story", title=kind), part)
            return
        for note in root:
            if attribute(note, "type") in ("separator", "continuationSeparator"):
                continue
            node = self.builder.node({"footnotes": "footnote", "endnotes": "endnote"}.get(kind, "comment"))
            self.blocks(note, node, part)
            self.builder.add("annotations", kind=kind.removesuffix("s"), targetIds=[node], bodyNodeId=node, referenceId=attribute(note, "id", ""), status="preserved")
            self.builder.feature(kind.removesuffix("s"))

    def blocks(self, parent, node: str, part: str) -> None:
        for element in parent:
            name = local(element)
            if name == "p":
                self.paragraph(element, node, part)
            elif name == "tbl":
                self.table(element, node, part)
            elif name == "sdt":
                inner = child(element, "sdtContent")
                if inner is not None:
                    self.blocks(inner, node, part)
            elif name == "sectPr":
                self.section(element)
            elif name not in QUIET and name not in ("bookmarkStart", "tblPr", "tblGrid", "tcPr", "trPr"):
                self.builder.unsupported("element", f"{name} is not decoded", node)

    def section(self, element) -> None:
        """Ends a section: its page surface, and a node with what its pages are like."""
        surface = self.page()
        self.ended = True
        stated = {name: child(element, name) for name in ("pgSz", "pgMar", "cols", "lnNumType", "type")}
        of = lambda name, keys: {k: attribute(stated[name], k) for k in keys if stated[name] is not None and attribute(stated[name], k)}
        payload = {
            "surfaceId": surface, "pgSz": {"orient": "portrait"} | of("pgSz", ("w", "h", "orient")), "pgMar": of("pgMar", ("top", "right", "bottom", "left", "header", "footer", "gutter")),
            "columns": {"num": "1"} | of("cols", ("num", "space")), "lineNumbering": of("lnNumType", ("countBy", "start", "restart")), **of("type", ("val",)),
        }
        node = self.builder.node("section")
        self.builder.add("extensions", targetId=node, namespace="format:docx", type="section-page-properties", schemaVersion="1.0.0", criticality="non-critical", payload=payload)
        self.builder.feature("section", target=node)

    def paragraph(self, element, parent: str, part: str) -> None:
        properties = child(element, "pPr")
        style = child(properties, "pStyle")
        name = attribute(style, "val") if style is not None else None
        heading = re.fullmatch(r"[Hh]eading ?([1-9])", name or "")
        node = self.builder.node("heading" if heading else "paragraph", parent)
        self.format(node, properties, "paragraph", self.styles.get(name))
        numbering = child(properties, "numPr")
        if numbering is not None:
            level, number = child(numbering, "ilvl"), child(numbering, "numId")
            self.builder.add("extensions", targetId=node, namespace="format:docx", type="numbering", schemaVersion="1.0.0", criticality="non-critical", payload={"level": int(attribute(level, "val", "0")) if level is not None else 0, "number": attribute(number, "val", "") if number is not None else ""})
        self.builder.feature("heading" if heading else "paragraph", target=node)
        self.builder.add("sourceMaps", targetId=node, format={"name": "docx"}, locator={"part": part})
        self.part = part
        self.inlines(element, node)
        if child(properties, "sectPr") is not None:
            self.section(child(properties, "sectPr"))

    def inlines(self, parent, node: str) -> None:
        for element in parent:
            name = local(element)
            if name == "r":
                self.run(element, node)
            elif name == "hyperlink":
                kind, target, external = self.relations.get(attribute(element, "id", ""), ("", "#" + attribute(element, "anchor", ""), False))
                self.builder.add("annotations", kind="hyperlink", targetIds=[node], body=target, status="preserved")
                self.builder.feature("hyperlink")
                self.inlines(element, node)
            elif name in ("ins", "del", "moveFrom", "moveTo"):
                self.builder.add("extensions", targetId=node, namespace="format:docx", type="revision", schemaVersion="1.0.0", criticality="non-critical", payload={"kind": name, "author": attribute(element, "author", "")})
                self.builder.feature("revision")
                self.inlines(element, node)
            elif name == "fldSimple":
                field = self.field(node, attribute(element, "instr", ""))
                at = len(self.builder.collections["texts"])
                self.inlines(element, node)
                field["result"] = [t["value"] for t in self.builder.collections["texts"][at:] if t["representation"] == "source"]
                self.end_field(field)
            elif name in ("smartTag", "sdt", "sdtContent", "customXml"):
                self.inlines(element, node)
            elif name == "bookmarkStart":
                self.builder.add("annotations", kind="bookmark", targetIds=[node], body=attribute(element, "name", ""), status="preserved")
            elif name not in QUIET:
                self.builder.unsupported("element", f"{name} is not decoded", node)

    def field(self, node: str, instruction: str = "") -> dict:
        return {"node": node, "instruction": [instruction] if instruction else [], "result": [], "separated": False}

    def end_field(self, field: dict) -> None:
        holder = self.builder.node("field", field["node"])
        instruction = self.builder.text(holder, " ".join(x.strip() for x in field["instruction"]))
        result = self.builder.text(holder, "".join(field["result"]), "displayed", instruction)
        made = self.builder.add("fields", ownerNodeId=holder, instructionTextId=instruction, resultTextId=result, status="preserved")
        self.builder.by_id[holder]["fieldId"] = made["fieldId"]
        self.builder.feature("field", target=holder)

    def run(self, element, parent: str) -> None:
        text, shown = "", True
        properties = child(element, "rPr")
        for c in element:
            name = local(c)
            if name in ("t", "delText"):
                text += c.text or ""
            elif name == "tab":
                text += "\t"
            elif name in ("br", "cr"):
                text += "\n"
            elif name == "noBreakHyphen":
                text += "\u2011"
            elif name == "fldChar":
                kind = attribute(c, "fldCharType")
                if kind == "begin":
                    self.open_fields.append(self.field(parent))
                elif kind == "separate" and self.open_fields:
                    self.open_fields[-1]["separated"] = True
                elif kind == "end" and self.open_fields:
                    self.end_field(self.open_fields.pop())
            elif name == "instrText" and self.open_fields:
                self.open_fields[-1]["instruction"].append(c.text or "")
            elif name in VISUAL:
                self.drawing(c, parent)
            elif name in ("footnoteReference", "endnoteReference", "commentReference"):
                self.builder.add("annotations", kind=name, targetIds=[parent], referenceId=attribute(c, "id", ""), status="preserved")
            elif name == "AlternateContent":
                choice = child(c, "Choice")
                for d in below(choice, "drawing") if choice is not None else ():
                    self.drawing(d, parent)
            elif name not in QUIET and name != "instrText":
                self.builder.unsupported("element", f"{name} is not decoded", parent)
        if text and shown:
            for field in self.open_fields:  # a nested result belongs to every field around it
                if field["separated"]:
                    field["result"].append(text)
            run = self.builder.node("run", parent)
            self.builder.texts(run, text)
            self.builder.feature("run", target=run)
            style = child(properties, "rStyle")
            named = self.styles.get(attribute(style, "val", "")) if style is not None else None
            holder = self.builder.by_id[parent]
            self.format(run, properties, "run", named or holder.get("resolvedStyleId"))

    def drawing(self, element, parent: str) -> None:
        """A drawing with its rectangle, where it is anchored, how text flows around it, its order and its crop."""
        find = lambda *names: next(iter(below(element, *names)), None)
        extent, anchor, transform, doubts = find("extent"), find("anchor"), find("xfrm"), []
        space = next((s["coordinateSpaceId"] for s in self.builder.collections["coordinateSpaces"]), None) or self.builder.add("coordinateSpaces", unit="emu", origin={"x": "0", "y": "0"})["coordinateSpaceId"]
        side = lambda k: {"value": plain_decimal(attribute(extent, k, "0")) if extent is not None else "0", "unit": "emu"}
        offset = [next((o.text for p in below(element, name) for o in below(p, "posOffset")), "0") for name in ("positionH", "positionV")]
        simple = child(anchor, "simplePos")
        if simple is not None and attribute(anchor, "simplePos", "0") in ("1", "true"):
            offset = [attribute(simple, "x", "0"), attribute(simple, "y", "0")]
        angle = Decimal(plain_decimal(attribute(transform, "rot", "0"))) / 60000 % 360 if transform is not None else Decimal(0)
        flipped = transform is not None and any(attribute(transform, k) in ("1", "true") for k in ("flipH", "flipV"))
        if flipped or angle % 90:
            doubts.append("a flip, or a rotation that is no right angle")
        primitive = {"kind": "rectangle", "x": plain_decimal(offset[0]), "y": plain_decimal(offset[1]), "width": side("cx"), "height": side("cy")}
        if angle:
            primitive |= {"kind": "rotatedRectangle", "rotation": {"value": plain_decimal(angle), "unit": "deg"}}
        geometry = self.builder.geometry(space, primitive["kind"], [primitive])
        inside = below(element, "txbxContent")
        kind = "connector" if find("cxnSp") is not None else "chart" if find("chart") is not None else "textBox" if inside else "image" if find("pic") is not None else "shape"
        node = self.builder.node(kind, parent, geometryId=geometry)
        relative = {attribute(p, "relativeFrom") for p in below(element, "positionH", "positionV")}
        if anchor is None:
            place = {"kind": "inline", "nodeId": parent}
        elif "page" in relative:
            place = {"kind": "page", "surfaceId": self.page()}
        elif relative & {"paragraph", "character", "line"} or not relative:
            place = {"kind": "paragraph", "nodeId": parent}
        else:
            place = {"kind": "floating", "surfaceId": self.page(), "offset": ";".join(f"{axis}:{x}" for axis, x in zip("hv", offset))}
        wrap = next((WRAPS[local(e)] for e in anchor if local(e) in WRAPS), None) if anchor is not None else None
        if anchor is not None and wrap is None:
            doubts.append("no known flow of text around it")
        depth = attribute(anchor, "relativeHeight") if anchor is not None else None
        if find("effectExtent") is not None and anchor is not None:
            doubts.append("effects beyond its rectangle")
        clips = [self.crop(space, e) for e in below(element, "srcRect")[:1] if e.attrib]
        right = {0: ("1", "0", "0", "1"), 90: ("0", "1", "-1", "0"), 180: ("-1", "0", "0", "-1"), 270: ("0", "-1", "1", "0")}
        matrix = None if flipped else right.get(angle)
        status = "ambiguous" if doubts else "preserved"
        layout = self.builder.add(
            "layouts", targetId=node, placement="floating" if anchor is not None else "inline", anchor=place, declaredGeometryId=geometry, wrap=wrap, zIndex=int(depth) if (depth or "").isdigit() else None,
            clipGeometryIds=clips or None, transform={**dict(zip("abcd", matrix)), "e": "0", "f": "0"} if matrix and angle else None, status=status,
        )
        self.builder.by_id[node] |= {"layoutIds": [layout["layoutId"]], "status": status}
        identity = find("docPr", "cNvPr")
        if identity is not None:
            self.drawings.setdefault((self.part, attribute(identity, "id", "")), node)
        for ending, role in (("stCxn", "start"), ("endCxn", "to")):
            if (at := find(ending)) is not None and kind == "connector":
                self.ends.append((node, (self.part, attribute(at, "id", "")), role))
        self.builder.feature("drawing", target=node) if not doubts else self.builder.unsupported("drawing", "; ".join(doubts), node, "ambiguous")
        for box in inside[:1]:
            self.blocks(box, node, self.part)

    def crop(self, space: str, element) -> str:
        """The part of a picture that is shown, in percents of it."""
        left, top, right, bottom = (Decimal(plain_decimal(attribute(element, k, "0"))) / 1000 for k in "ltrb")
        fits = min(left, top, right, bottom) >= 0 and left + right <= 100 and top + bottom <= 100
        shown = {"kind": "rectangle", "x": plain_decimal(left), "y": plain_decimal(top), "width": {"value": plain_decimal(100 - left - right), "unit": "percent"}, "height": {"value": plain_decimal(100 - top - bottom), "unit": "percent"}}
        made = self.builder.geometry(space, "cropRegion", [shown], "preserved" if fits else "ambiguous")
        if not fits:
            self.builder.unsupported("crop", "a crop beyond its picture", made, "ambiguous")
        return made

    def connect(self) -> None:
        """Relations from connectors to the drawings at their ends, which may come after them."""
        for connector, key, role in self.ends:
            if key in self.drawings:
                self.builder.add("relations", kind="connectorTarget", fromId=connector, toId=self.drawings[key], endpoint=role, status="preserved")
                self.builder.feature("connector-target", target=connector)
            else:
                self.builder.unsupported("connector-target", f"no drawing {key[1]} at the {role}", connector, "ambiguous")

    def table(self, element, parent: str, part: str) -> None:
        """Rows and cells on a grid; a cell that continues a vertical merge follows the cell that began it."""
        node = self.builder.node("table", parent)
        grid = children(child(element, "tblGrid"), "gridCol")
        columns = [self.builder.node("column", node) for _ in grid]
        rows, cells, merged = [], [], {}
        for r, row in enumerate(children(element, "tr")):
            row_node = self.builder.node("row", node)
            rows.append(row_node)
            before = child(child(row, "trPr"), "gridBefore")
            at = int(attribute(before, "val", "0")) if before is not None else 0
            for cell in children(row, "tc"):
                properties = child(cell, "tcPr")
                span, merge = child(properties, "gridSpan"), child(properties, "vMerge")
                width = int(attribute(span, "val", "1")) if span is not None else 1
                more = {"gridSpan": width}
                if merge is not None:
                    if attribute(merge, "val", "continue") == "restart" or at not in merged:
                        merged[at] = f"{node}-merge-{r}-{at}"
                        more |= {"mergeRole": "master"}
                    else:
                        more |= {"mergeRole": "follower"}
                    more["mergeId"] = merged[at]
                else:
                    merged.pop(at, None)
                made = self.builder.node("cell", row_node, address={"row": r + 1, "column": at + 1}, **more)
                cells.append(made)
                self.blocks(cell, made, part)
                at += width
        self.builder.add("tables", nodeId=node, rowIds=rows, columnIds=columns, cellIds=cells, gridColumns=[int(attribute(g, "w", "0")) for g in grid], status="preserved")
        self.builder.feature("table", target=node)
