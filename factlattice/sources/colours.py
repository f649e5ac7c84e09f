"""Colours of office packages, and what a part of a format states."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from factlattice.sources.containers import attribute, below, local

#: Slots of a theme in the order of their numbers. Fixed values of the format.
SLOTS = ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")


@dataclass
class Layer:
    """What one part of a format states: authored and resolved properties, and what could not be resolved."""

    authored: dict = field(default_factory=dict)
    resolved: dict = field(default_factory=dict)
    issues: list[str] = field(default_factory=list)

    def put(self, name: str, authored, resolved) -> None:
        if authored is not None:
            self.authored[name] = authored
        if resolved is not None:
            self.resolved[name] = resolved


def rgb_value(digits: str, alpha: int | str = 1) -> dict:
    return {"kind": "rgb", **{c: int(digits[k : k + 2], 16) for c, k in (("r", 0), ("g", 2), ("b", 4))}, "a": alpha}


def theme_colours(root) -> dict[str, dict]:
    """Colours of a theme's scheme, by slot and by number."""
    out: dict[str, dict] = {}
    scheme = next(iter(below(root, "clrScheme")), None) if root is not None else None
    for slot in scheme if scheme is not None else ():
        for colour in slot:
            if local(colour) in ("srgbClr", "sysClr"):
                stated = [attribute(colour, n) for n in ("val", "lastClr")]
                if digits := next((d for d in stated if re.fullmatch("[0-9A-Fa-f]{6}", d or "")), None):
                    out[local(slot)] = rgb_value(digits)
                break
    return out | {str(k): out[s] for k, s in enumerate(SLOTS) if s in out}
