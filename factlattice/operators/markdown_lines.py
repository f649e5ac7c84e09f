"""Lines of texts with their spans, and the kinds of lines that one line alone decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BREAK = "\r\n|\n|\r"


def lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, text, char_start, char_end, byte_start, byte_end): half-open spans without the line break.

    A document of n breaks has n + 1 lines; LF, CRLF and CR all break, each as long as it is. A null text has none.
    """
    kept = F.regexp_extract_all(F.col(text_col), F.lit(r"(?s)([^\r\n]*(?:\r\n|\n|\r|\z))"), F.lit(1))
    whole = F.filter(kept, lambda x, k: (k == 0) | (x != ""))
    ends_open = F.col(text_col).rlike(r"(?s)(?:\r\n|\n|\r)\z")
    whole = F.when(F.col(text_col).isNull(), F.array().cast("array<string>")).when(F.col(text_col) == "", F.array(F.lit(""))).when(ends_open, F.concat(whole, F.array(F.lit("")))).otherwise(whole)
    rows = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(whole).alias("at", "raw"))
    before = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda size: F.coalesce(F.sum(size).over(before), F.lit(0))
    text = F.regexp_replace("raw", r"[\r\n]+\z", "")
    rows = rows.withColumn("text", text).withColumn("char_start", start(F.length("raw"))).withColumn("byte_start", start(F.octet_length("raw")))
    return rows.select("doc_id", (F.col("at") + 1).alias("line"), "text", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"), "byte_start", (F.col("byte_start") + F.octet_length("text")).alias("byte_end"))


def heading_level(text: Column) -> Column:
    """1 to 6 for an ATX heading, else null."""
    return F.when(text.rlike(r"^ {0,3}#{1,6}(?:[ \t]|$)"), F.length(F.regexp_extract(text, r"^ {0,3}(#{1,6})", 1)))


def heading_title(text: Column) -> Column:
    body = F.regexp_extract(text, r"^ {0,3}#{1,6}(?:[ \t]+(.*))?$", 1)
    return F.trim(F.regexp_replace(body, r"(?:^|[ \t]+)#+[ \t]*$", ""))


def is_thematic_break(text: Column) -> Column:
    return text.rlike(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")


def is_fence(text: Column) -> Column:
    return text.rlike("^ {0,3}(?:```+[^`]*|~~~+.*)$")


def is_list_item(text: Column) -> Column:
    return text.rlike(r"^\s*(?:[-*+]|[0-9]{1,9}[.)])(?:[ \t]|$)") & ~is_thematic_break(text)


def is_pipe_row(text: Column) -> Column:
    return text.contains("|")


def line_kind(text: Column) -> Column:
    """The kind of a line by itself, first match wins: directive, fence, break, heading, blank, code, list, quote, table or text."""
    return (
        F.when(text.rlike("^ {0,3}:::"), "directive").when(is_fence(text), "fence").when(is_thematic_break(text), "break").when(heading_level(text).isNotNull(), "heading")
        .when(text.rlike(r"^\s*$"), "blank").when(is_list_item(text), "list").when(text.rlike("^(?:    |\t)"), "code").when(text.rlike("^ {0,3}>"), "quote").when(is_pipe_row(text), "table").otherwise("text")
    )


def table_cells(text: Column) -> Column:
    """Cells of a pipe row, trimmed; outer pipes are borders and an escaped pipe is none."""
    bare = F.regexp_replace(F.trim(text), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(bare, r"(?<!\\)\|"), lambda c: F.trim(c))
