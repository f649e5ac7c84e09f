"""JSON pointers (RFC 6901) as columns and on the driver, and templates with * and **."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape(segment: str) -> str:
    return segment.replace("~", "~0").replace("/", "~1")


def unescape(segment: str) -> str:
    return segment.replace("~1", "/").replace("~0", "~")


def escape_column(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def unescape_column(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def segments(pointer: str) -> list[str]:
    """The raw segments of a pointer; the root has none."""
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise ValueError(f"a pointer begins with '/': {pointer!r}")
    return pointer[1:].split("/")


def template_matches(template: list[str], actual: list[str]) -> bool:
    """* stands for one segment, a last ** for the rest (also none), anything else for itself."""
    for k, part in enumerate(template):
        if part == "**":
            return True
        if k >= len(actual) or part not in ("*", actual[k]):
            return False
    return len(template) == len(actual)


def template_condition(pointer: Column, template: str) -> Column:
    """template_matches() as a condition on a column of pointers; a literal template stays an equality that scans push down."""
    parts = segments(template)
    if "**" not in parts and "*" not in parts:
        return pointer == template
    if "**" in parts:
        parts = parts[: parts.index("**")]
        tail = "(?:/.*)?"
    else:
        tail = ""
    literal = []
    for part in parts:
        if part == "*":
            break
        literal.append(part)
    prefix = "".join(f"/{p}" for p in literal)
    pattern = "(?s)^" + "".join("/[^/]*" if p == "*" else "/" + "".join(c if c.isalnum() or c == "_" else "\\" + c if ord(c) < 128 else c for c in p) for p in parts) + tail + "$"
    condition = pointer.rlike(pattern)
    return condition & pointer.startswith(prefix) if prefix else condition
