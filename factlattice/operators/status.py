"""Status roll-up, feature inventories and index counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlattice.operators.facts import COLLECTIONS, DOCUMENT
from factlattice.operators.validation import PARTIAL


def conversion_status(features: DataFrame, diagnostics: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, conversion_status) of (document_id): failed if any diagnostic is an error or fatal, else partial if
    any feature (document_id, status) is lost, else complete-with-warnings if any diagnostic warns or informs."""
    lost = features.groupBy("document_id").agg(F.bool_or(F.col("status").isin(*PARTIAL)).alias("lost"))
    told = diagnostics.groupBy("document_id").agg(F.bool_or(F.col("severity").isin("error", "fatal")).alias("failed"), F.bool_or(F.col("severity").isin("info", "warning")).alias("warned"))
    rows = documents.select("document_id").join(lost, "document_id", "left").join(told, "document_id", "left")
    return rows.select("document_id", F.when(F.col("failed"), "failed").when(F.col("lost"), "partial").when(F.col("warned"), "complete-with-warnings").otherwise("complete").alias("conversion_status"))


def feature_inventory(features: DataFrame) -> DataFrame:
    """(document_id, feature, status, occurrences, disposition, diagnostic_ids) of (document_id, feature, status, ordinal,
    diagnostic_ids); ids are distinct, in the order first seen."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "diagnostic_ids"))), lambda x: F.coalesce(x["diagnostic_ids"], F.array().cast("array<string>")))
    disposition = F.when(F.col("status").isin(*PARTIAL, "unavailable"), F.col("status")).otherwise("represented")
    return features.groupBy("document_id", "feature", "status").agg(F.count(F.lit(1)).alias("occurrences"), F.array_distinct(F.flatten(ids)).alias("diagnostic_ids")).withColumn("disposition", disposition)


def reconcile(stated: DataFrame, counted: DataFrame, keys: list[str], count: str = "occurrences") -> DataFrame:
    """Keys whose counts differ between two inventories, with both counts; none if they are equal."""
    left, right = stated.groupBy(*keys).agg(F.sum(count).alias("stated")), counted.groupBy(*keys).agg(F.sum(count).alias("counted"))
    return left.join(right, keys, "full").filter(~F.col("stated").eqNullSafe(F.col("counted")))


def warnings(diagnostics: DataFrame) -> DataFrame:
    """`code: message` of diagnostics that inform or warn."""
    return diagnostics.filter(F.col("severity").isin("info", "warning")).select("document_id", F.concat_ws(": ", "code", "message").alias("warning"))


def index_counts(entities: DataFrame, fields: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """(name, n): entities of each collection (zeros too), and of the tables that are given document fields, entity fields and references."""
    spark = entities.sparkSession
    names = spark.createDataFrame([(f"entities.{c}",) for c in COLLECTIONS], "name string")
    own = entities.filter(F.col("collection") != DOCUMENT).groupBy(F.concat(F.lit("entities."), F.col("collection")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    out = names.join(own, "name", "left").fillna(0, ["n"])
    if fields is not None:
        totals = fields.agg(F.count_if(F.col("collection") == DOCUMENT).alias("document_fields"), F.count_if(F.col("collection") != DOCUMENT).alias("entity_fields"))
        out = out.unionByName(totals.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in ("document_fields", "entity_fields")]))))
    if references is not None:
        out = out.unionByName(references.agg(F.count(F.lit(1)).alias("n")).select(F.lit("references").alias("name"), "n"))
    return out
