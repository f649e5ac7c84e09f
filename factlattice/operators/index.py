"""A persistent index of documents: versioned Parquet tables, published by a manifest and verified on opening."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.operators import facts
from factlattice.operators.canonical import canonical_documents, records_digest
from factlattice.plans.contract import Contract

TABLES = {"entities": ["document_id", "collection", "entity_id"], "fields": ["document_id", "collection", "entity_id", "pointer"], "references": ["document_id", "source_collection", "source_id", "source_pointer", "ordinal", "target_id"]}


class StaleIndex(ValueError):
    """An index that is stale, incomplete or changed."""


@dataclass
class Index:
    entities: DataFrame
    fields: DataFrame
    references: DataFrame
    manifest: dict


def build_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """entities, fields and references of (document_id, ir_json), each row with its own digest."""
    entities = facts.entities(documents)
    fields = facts.flatten(entities)
    tables = {"entities": entities, "fields": fields, "references": facts.references(fields, entities)}
    return {name: with_digest(df) for name, df in tables.items()}


def with_digest(rows: DataFrame) -> DataFrame:
    columns = sorted(c for c in rows.columns if c != "row_sha256")
    return rows.withColumn("row_sha256", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def source_digest(documents: DataFrame) -> str:
    digests = canonical_documents(documents, "full").select("document_id", F.coalesce("digest", F.sha2("error", 256)).alias("digest"))
    return records_digest(digests.withColumn("digest", F.sha2(F.concat_ws("\n", "document_id", "digest"), 256)), "digest").first()["records_digest"]


def _summary(rows: DataFrame) -> dict:
    found = records_digest(rows, "row_sha256").first()
    return {"rows": found["records"], "digest": found["records_digest"]} if found else {"rows": 0, "digest": None}


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def build_index(documents: DataFrame, path: str, contract: Contract) -> dict:
    """Writes a new version below path and then its manifest, the one act that publishes it."""
    spark = documents.sparkSession
    version = uuid.uuid4().hex
    tables = {}
    for name, rows in build_tables(documents).items():
        keys = [F.col(k) for k in TABLES[name] if k in ("collection", "pointer", "target_id")]
        rows.sortWithinPartitions(*keys).write.parquet(f"{path}/{version}/{name}") if keys else rows.write.parquet(f"{path}/{version}/{name}")
        tables[name] = _summary(spark.read.parquet(f"{path}/{version}/{name}"))
    manifest = {"version": version, "contract": contract.version, "source": source_digest(documents), "tables": tables}
    _write_text(spark, f"{path}/manifest-{version}", json.dumps(manifest, sort_keys=True))
    return manifest


def open_index(spark: SparkSession, path: str, version: str, contract: Contract, documents: DataFrame | None = None) -> Index:
    """The tables of a version after all of it was verified: contract, counts, row digests, and the source if given."""
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest-{version}").first()["value"])
    except Exception as error:
        raise StaleIndex(f"no manifest {version}") from error
    if manifest["contract"] != contract.version:
        raise StaleIndex("built under another contract")
    if documents is not None and manifest["source"] != source_digest(documents):
        raise StaleIndex("the source has changed")
    tables = {}
    for name, stated in manifest["tables"].items():
        rows = spark.read.parquet(f"{path}/{version}/{name}")
        checked = with_digest(rows.drop("row_sha256")).select("row_sha256")
        if _summary(checked) != stated:
            raise StaleIndex(f"{name} is not what was built")
        tables[name] = rows
    return Index(tables["entities"], tables["fields"], tables["references"], manifest)


def parity(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(side, n): rows that only one of two results has; zero and zero if they agree."""
    one, two = left.select(*keys), right.select(*keys)
    only = lambda a, b, side: a.exceptAll(b).agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return only(one, two, "left").unionByName(only(two, one, "right"))


def unregistered(fields: DataFrame, contract: Contract) -> DataFrame:
    """(collection, template) of observed pointers, list positions as *, that the contract does not know."""
    return uncovered(fields.filter("pointer != ''").select("collection", F.regexp_replace("pointer", "/[0-9]+(?=/|$)", "/*").alias("template")).distinct(), contract)


def uncovered(seen: DataFrame, contract: Contract) -> DataFrame:
    """(collection, template) of distinct observed templates that the contract does not know; they are read once."""
    known = contract.table(seen.sparkSession).select("collection", "pointer")  # the contract is written by hand
    literal = seen.select("collection", "template").join(F.broadcast(known.withColumnRenamed("pointer", "template")), ["collection", "template"], "left_anti")
    pattern = F.concat(F.lit("^"), F.replace(F.replace(F.regexp_replace("pointer", r"([.+?^$(){}|\[\]\\])", r"\\$1"), F.lit("/**"), F.lit("(/.*)?")), F.lit("/*"), F.lit("/[^/]*")), F.lit("$"))
    wild = known.filter("pointer LIKE '%*%'").select(F.col("collection").alias("known_collection"), pattern.alias("pattern"))
    return literal.join(F.broadcast(wild), F.expr("collection = known_collection AND template RLIKE pattern"), "left_anti")
