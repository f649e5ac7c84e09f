"""Cell formats of XLSX packages: colours, fonts, fills, borders, alignment; their cascade and conditional overlays."""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation

from factlattice.functions.values import sheet_tint
from factlattice.sources.colours import Layer, rgb_value, theme_colours
from factlattice.sources.containers import Package, attribute, child, children, local
from factlattice.sources.ir import Builder, SourceError, plain_decimal

#: Number formats that have an id and no text in a package.
BUILT_IN = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)",
    40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
#: The first eight colours of the indexed palette, which its next eight repeat. Fixed values of the format.
PALETTE = ("000000", "FFFFFF", "FF0000", "00FF00", "0000FF", "FFFF00", "FF00FF", "00FFFF")
#: Points of border lines. Fixed values of the format.
LINE_WIDTHS = {"hair": "0.25", "thin": "0.5", "medium": "1", "thick": "1.5", "double": "1.5"}
UNDERLINES = ("single", "double", "dotted", "wave")
ALIGNMENTS = ("left", "center", "right", "justify")
COMPARISONS = {
    "equal": lambda a, b: a == b, "notEqual": lambda a, b: a != b, "greaterThan": lambda a, b: a > b, "lessThan": lambda a, b: a < b,
    "greaterThanOrEqual": lambda a, b: a >= b, "lessThanOrEqual": lambda a, b: a <= b,
}


def integer(element, name: str, default: int = 0) -> int:
    """An attribute that should be an integer; the default where it is not."""
    text = attribute(element, name) if element is not None else None
    return int(text) if re.fullmatch(r"-?\d{1,9}", text or "") else default


def flag(element, name: str) -> bool:
    return element is not None and attribute(element, name) in ("1", "true")


def colour(element, theme: dict[str, dict]) -> tuple[dict | None, dict | None, str | None]:
    """(authored, resolved, issue) of a colour element; a theme colour is resolved with its tint."""
    token = lambda slot: {"kind": "theme", "slot": slot}
    stated = {n: attribute(element, n) for n in ("rgb", "theme", "indexed", "tint")}
    if raw := stated["rgb"]:
        if not re.fullmatch("(?:[0-9A-Fa-f]{2})?[0-9A-Fa-f]{6}", raw):
            return token("unresolved"), None, f"{raw!r} is no colour"
        alpha = int(raw[:2], 16) if len(raw) == 8 else 255
        made = rgb_value(raw[-6:], 1 if alpha == 255 else plain_decimal(Decimal(alpha) / 255))
        return made, made, None
    if slot := stated["theme"]:
        own = token(f"theme:{slot}")
        if slot not in theme:
            return own, own, f"the theme has no colour {slot}"
        try:
            tint = float(stated["tint"] or 0)
        except ValueError:
            tint = 0.0
        base = theme[slot]
        shade = sheet_tint(base["r"], base["g"], base["b"], tint) if tint else (base["r"], base["g"], base["b"])
        return own, {**base, **dict(zip("rgb", shade))}, None
    if index := stated["indexed"]:
        if re.fullmatch(r"\d|1[0-5]", index):
            made = rgb_value(PALETTE[int(index) % len(PALETTE)])
            return made, made, None
        return token(f"indexed:{index}"), None, f"colour {index} is beyond the fixed palette"
    if flag(element, "auto"):
        return token("auto"), token("auto"), "an automatic colour depends on its window"
    return None, None, "a colour without a value"


def font_layer(font, theme: dict[str, dict]) -> Layer:
    out = Layer()
    for part in font if font is not None else ():
        name, value = local(part), attribute(part, "val")
        if name == "name" and value:
            out.put("fontFamily", value, value)
        elif name == "sz" and value:
            try:
                size = {"value": plain_decimal(value), "unit": "pt"}
                out.put("fontSize", size, size)
            except SourceError:
                out.issues.append(f"{value!r} is no size")
        elif name in ("b", "i", "strike") and value not in ("0", "false"):
            key, on = {"b": ("weight", 700), "i": ("italic", True)}.get(name, ("strike", True))
            out.put(key, on, on)
        elif name == "u":
            if (line := value or "single") in UNDERLINES:
                out.put("underline", line, line)
            elif line != "none":
                out.issues.append(f"underline {line} is not known")
        elif name == "color":
            authored, resolved, issue = colour(part, theme)
            out.put("foreground", authored, resolved)
            out.issues += [issue] if issue else []
    return out


def fill_layer(fill, theme: dict[str, dict]) -> Layer:
    out = Layer()
    if fill is None:
        return out
    pattern = child(fill, "patternFill")
    if pattern is None:
        out.issues.append("a fill that is no pattern")
        return out
    kind = attribute(pattern, "patternType") or "none"
    if kind == "none":
        out.put("fill", {"kind": "none"}, {"kind": "none"})
        return out
    shown = "solid" if kind == "solid" else "pattern"
    source = next((e for e in pattern if local(e) in ("fgColor", "bgColor")), None)
    authored, resolved, issue = colour(source, theme) if source is not None else (None, None, "a fill without a colour")
    out.put("fill", {"kind": shown, "color": authored or {"kind": "theme", "slot": "unresolved"}}, {"kind": shown, "color": resolved} if resolved else None)
    out.issues += [issue] if issue else []
    return out


def border_layer(border, theme: dict[str, dict]) -> Layer:
    out = Layer()
    authored, resolved = {}, {}
    for side in border if border is not None else ():
        line = attribute(side, "style")
        if local(side) not in ("top", "right", "bottom", "left") or not line:
            continue
        stroke = {"dash": line} | ({"width": {"value": LINE_WIDTHS[line], "unit": "pt"}} if line in LINE_WIDTHS else {})
        source = child(side, "color")
        own, shown, issue = colour(source, theme) if source is not None else (None, None, None)
        authored[local(side)] = stroke | ({"color": own} if own else {})
        resolved[local(side)] = stroke | ({"color": shown} if shown else {})
        out.issues += [f"{local(side)} border: {issue}"] if issue else []
    if authored:
        out.put("borders", authored, resolved)
    return out


def alignment_layer(xf) -> Layer:
    out, element = Layer(), child(xf, "alignment")
    value = attribute(element, "horizontal") if element is not None else None
    if value in ALIGNMENTS:
        out.put("paragraphAlignment", value, value)
    return out


class CellStyles:
    """The cell formats of a workbook as styles: named ones, the components that formats are made of, and resolved ones.

    A format is its named style, then its own number format, font, fill, border and alignment (unless it says that one
    does not apply); what comes last gives a property. `codes` and `ids` have an entry for each cell format.
    """

    def __init__(self, package: Package, builder: Builder):
        self.builder = builder
        root = package.optional_xml("xl/styles.xml")
        self.theme = theme_colours(package.optional_xml("xl/theme/theme1.xml")) if root is not None else {}
        listed = lambda group, item: children(child(root, group), item)
        self.own_codes = {integer(f, "numFmtId"): attribute(f, "formatCode") for f in listed("numFmts", "numFmt")}
        self.parts = {
            "font": [font_layer(e, self.theme) for e in listed("fonts", "font")], "fill": [fill_layer(e, self.theme) for e in listed("fills", "fill")],
            "border": [border_layer(e, self.theme) for e in listed("borders", "border")],
        }
        self.differences = listed("dxfs", "dxf")
        self.components: dict[tuple, str] = {}
        self.rules: dict[tuple[int, int], tuple[str, Layer]] = {}
        self.resolved: dict[str, dict[str, tuple]] = {}
        names = {integer(s, "xfId", -1): attribute(s, "name") for s in listed("cellStyles", "cellStyle")}
        bases = [self._named(xf, names.get(k)) for k, xf in enumerate(listed("cellStyleXfs", "xf"))]
        formats = listed("cellXfs", "xf")
        self.codes = [self._code(xf) for xf in formats]
        self.ids = [self._format(xf, bases) for xf in formats]

    def _code(self, xf) -> str | None:
        """The number format; None for General."""
        index = integer(xf, "numFmtId")
        return self.own_codes.get(index) or BUILT_IN.get(index)

    def _layers(self, xf, all_apply: bool):
        """((kind, key), layer) of the parts of a format that apply and state or miss anything."""
        code = {"numberFormat": {"code": self._code(xf) or "General", "locale": "unknown"}}
        yield ("numberFormat", code["numberFormat"]["code"]), Layer(code, dict(code))
        for kind, own in self.parts.items():
            index = integer(xf, f"{kind}Id")
            if not all_apply and attribute(xf, f"apply{kind.title()}") in ("0", "false"):
                continue
            if 0 <= index < len(own):
                yield (kind, index), own[index]
            elif index:
                yield (kind, index), Layer(issues=[f"there is no {kind} {index}"])
        layer = alignment_layer(xf)
        if layer.authored and (all_apply or attribute(xf, "applyAlignment") not in ("0", "false")):
            yield ("alignment", layer.authored["paragraphAlignment"]), layer

    def _style(self, values: dict[str, tuple], issues: list[str], **more) -> str:
        """A style with the resolved (value, source, action) of each property; a source of None is the style itself."""
        status = "ambiguous" if issues else "normalized"
        made = self.builder.add("styles", role="cell", resolved={p: v for p, (v, _, _) in values.items()}, status=status, **more)
        own = made["styleId"]
        made["cascadeTrace"] = [{"property": p, "source": s or own, "action": a} for p, (_, s, a) in values.items()]
        made["propertyProvenance"] = [{"property": p, "source": s or own, "status": status} for p, (_, s, _) in values.items()]
        self.resolved[own] = {p: (v, s or own, a) for p, (v, s, a) in values.items()}
        for issue in dict.fromkeys(issues):
            self.builder.unsupported("cell-style", issue, own, "ambiguous")
        return own

    def _named(self, xf, name: str | None) -> str:
        whole = Layer()
        for _, layer in self._layers(xf, True):
            whole.authored |= layer.authored
            whole.resolved |= layer.resolved
            whole.issues += layer.issues
        return self._style({p: (v, None, "direct") for p, v in whole.resolved.items()}, whole.issues, origin="named", name=name, declaration=whole.authored)

    def _component(self, key: tuple, layer: Layer) -> str:
        if key not in self.components:
            self.components[key] = self._style({p: (v, None, "direct") for p, v in layer.resolved.items()}, layer.issues, origin="component", declaration=layer.authored)
        return self.components[key]

    def _format(self, xf, bases: list[str]) -> str:
        index, issues = integer(xf, "xfId", -1), []
        base = bases[index] if 0 <= index < len(bases) else None
        if base is None and index >= 0:
            issues.append(f"there is no named format {index}")
        values = {p: (v, s, "inherit") for p, (v, s, _) in self.resolved[base].items()} if base else {}
        authored, sources = {}, [base] if base else []
        for key, layer in self._layers(xf, False):
            authored |= layer.authored
            issues += layer.issues
            inherited = key[0] == "numberFormat" and key[1] != "General" and values.get("numberFormat", ({},))[0].get("code") == key[1]
            if inherited or not (layer.authored or layer.issues):
                continue
            source = self._component(key, layer)
            sources.append(source)
            for p, v in layer.resolved.items():
                values.pop(p, None)
                values[p] = (v, source, "direct")
        made = self._style(values, issues, origin="resolved", basedOn=base, declaration=authored, resolvedFrom=sources)
        if not issues:
            self.builder.feature("cell-style", target=made)
        return made

    def rule_style(self, index: int, priority: int) -> tuple[str, Layer] | None:
        """The style of a conditional rule, one for each difference and priority; None if there is no such difference."""
        if not 0 <= index < len(self.differences):
            return None
        if (index, priority) not in self.rules:
            element, layer = self.differences[index], Layer()
            for part in (font_layer(child(element, "font"), self.theme), fill_layer(child(element, "fill"), self.theme)):
                layer.authored |= part.authored
                layer.resolved |= part.resolved
                layer.issues += part.issues
            made = self._style({p: (v, None, "conditional") for p, v in layer.resolved.items()}, layer.issues, origin="conditional", declaration=layer.authored)
            self.rules[index, priority] = made, layer
        return self.rules[index, priority]

    def overlay(self, base: str, rules: list[dict], values: dict[str, tuple]) -> str:
        """The style of a cell whose conditional formats give some properties (value, source) over its own style."""
        whole = {p: v for p, v in self.resolved[base].items() if p not in values} | {p: (v, s, "conditional") for p, (v, s) in values.items()}
        doubtful = [f"rule {r['ruleId']} is not resolved as a whole" for r in rules if self.builder.by_id[r["ruleId"]]["status"] == "ambiguous"]
        if self.builder.by_id[base]["status"] == "ambiguous":
            doubtful.append(f"style {base} is not resolved as a whole")
        made = self._style(whole, doubtful, origin="conditional", basedOn=base, conditional=rules, resolvedFrom=list(dict.fromkeys([base, *(s for _, s in values.values())])))
        if not doubtful:
            self.builder.feature("conditional-style", "normalized", made)
        return made


def decimal_or_none(text: str | None) -> Decimal | None:
    try:
        found = Decimal((text or "").strip().lstrip("="))
    except InvalidOperation:
        return None
    return found if found.is_finite() else None


def apply_conditions(styles: CellStyles, blocks, bounds_of, section: str, cells: dict, raw: dict, base: dict) -> None:
    """Gives cells the styles of the rules that hold for them.

    `cells`, `raw` and `base` are the node, stored text and own style of each (row, column). In a block the rule with
    the least priority gives a property, and a rule that stops ends the block for its cells; a later block overrides an
    earlier one. Rules whose style is missing count as absent.
    """
    builder = styles.builder
    numbers = {p: n for p, t in raw.items() if p in base and (n := decimal_or_none(t)) is not None}
    found: dict[tuple, tuple[list[dict], dict]] = {}
    for block in blocks:
        areas, won, stopped = bounds_of(attribute(block, "sqref", "")), set(), set()
        inside = {p: n for p, n in numbers.items() if any(r1 <= p[0] <= r2 and c1 <= p[1] <= c2 for r1, c1, r2, c2 in areas)}
        for rule in sorted(children(block, "cfRule"), key=lambda r: integer(r, "priority")):
            formula = child(rule, "formula")
            operand, holds = decimal_or_none(formula.text) if formula is not None else None, COMPARISONS.get(attribute(rule, "operator") or "equal")
            if attribute(rule, "type") != "cellIs" or operand is None or holds is None:
                continue
            hit = [p for p, n in inside.items() if p not in stopped and holds(n, operand)]
            if not hit:
                continue
            priority = integer(rule, "priority")
            own = styles.rule_style(integer(rule, "dxfId", -1), priority)
            if own is None:
                builder.unsupported("conditional-formatting", f"the rule of priority {priority} has no style", section, "ambiguous")
                continue
            style, layer = own
            for p in hit:
                rules, values = found.setdefault(p, ([], {}))
                if all(r["ruleId"] != style for r in rules):
                    rules.append({"ruleId": style, "condition": "cellIs", "style": layer.resolved, "priority": priority})
                values |= {name: (v, style) for name, v in layer.resolved.items() if (p, name) not in won}
                won.update((p, name) for name in layer.resolved)
            if flag(rule, "stopIfTrue"):
                stopped.update(hit)
    for p in sorted(found):
        node = builder.by_id[cells[p]]
        node["resolvedStyleId"] = styles.overlay(base[p], *found[p])
        node["styleIds"] = [base[p], node["resolvedStyleId"]]
