"""Sinks: documents as JSON lines, canonical text, and the evidence of a conversion run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlattice.operators.canonical import canonical_documents


def _apart(target: str, source: str | None) -> None:
    plain = lambda p: p.removeprefix("file://").rstrip("/")
    if source is not None and (plain(source) + "/").startswith(plain(target) + "/"):
        raise ValueError("the target would replace its input")


def write_json(documents: DataFrame, target: str, source: str | None = None) -> None:
    """A JSON document on each line; an existing target and the input's own folder are errors."""
    _apart(target, source)
    documents.select("ir_json").write.mode("error").text(target)


def write_canonical(documents: DataFrame, target: str, projection: str = "full", source: str | None = None) -> DataFrame:
    """Canonical documents as text; gives (document_id, digest, error) of all, those with errors not written."""
    _apart(target, source)
    made = canonical_documents(documents, projection)
    made.filter("error IS NULL").select("canonical").write.mode("error").text(target)
    return made.select("document_id", "digest", "error")


def check_canonical(documents: DataFrame, projection: str = "full") -> DataFrame:
    """(document_id, is_canonical) of documents whose text is or is not in canonical form already."""
    made = canonical_documents(documents, projection)
    return documents.join(made, "document_id").select("document_id", F.coalesce(F.col("ir_json") == F.col("canonical"), F.lit(False)).alias("is_canonical"))


def write_evidence(converted: DataFrame, target: str, run: str) -> None:
    """Input digests and sizes, outcomes and times of a run, beside those of other runs."""
    converted.select(F.lit(run).alias("run"), "path", "format", "input_sha256", "input_bytes", "outcome", "error", "elapsed_ms", "document_id").write.mode("append").partitionBy("run").parquet(target)
