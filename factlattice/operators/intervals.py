"""Interval joins, and mappings between a text and its normalised form."""

from __future__ import annotations

import difflib
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


def points_in_spans(points: DataFrame, spans: DataFrame, keys: list[str], band: int = 1 << 16) -> DataFrame:
    """points (keys, at) with the half-open spans (keys, start, end) around them, by an equi-join on bands."""
    last = F.greatest(F.col("start"), F.col("end") - 1)
    placed = spans.filter("end > start").withColumn("band", F.explode(F.sequence(F.floor(F.col("start") / band), F.floor(last / band))))
    return points.withColumn("band", F.floor(F.col("at") / band)).join(placed, [*keys, "band"]).filter("at >= start AND at < end").drop("band")


MAPPING = ArrayType(StructType([StructField("op", StringType()), *(StructField(k, IntegerType()) for k in ("source_start", "source_end", "start", "end"))]))


def text_mapping(source: str | None, target: str | None) -> list[tuple] | None:
    """How a target came from its source: equal, replace, delete and insert, as half-open byte ranges of both."""
    if source is None or target is None:
        return None
    at = lambda text, k: len(text[:k].encode())
    steps = difflib.SequenceMatcher(None, source, target, autojunk=False).get_opcodes()
    return [(op, at(source, a), at(source, b), at(target, c), at(target, d)) for op, a, b, c, d in steps]


def with_normal_form(texts: DataFrame, column: str = "value") -> DataFrame:
    """Adds normalized (NFC) and mapping; only texts that change pay for a mapping."""
    normal = F.udf(lambda t: None if t is None else unicodedata.normalize("NFC", t), StringType())
    mapping = F.udf(text_mapping, MAPPING)
    plain = F.col(column).rlike(r"^[\x00-\x7F]*$")  # ASCII is its own normal form
    out = texts.withColumn("normalized", F.when(plain, F.col(column)).otherwise(normal(F.col(column))))
    return out.withColumn("mapping", F.when(F.col("normalized") != F.col(column), mapping(F.col(column), F.col("normalized"))))
