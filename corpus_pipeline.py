"""From documents to packed sequences: language ID, exact dedup, near-duplicate removal, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from factlattice.llm.common import Work, documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).join(ids.select("doc_id"), "doc_id", "left_semi")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null texts and those without letters); lang is what was identified.

    As in all stages an id names one text; rows without an id go. `run` gives ids to those rows before.
    """
    found = language_id.identify(docs).filter("lang_pred != 'und'")
    found = found.groupBy("doc_id").agg(F.first("lang_pred").alias("lang_pred"))
    return docs.join(found, "doc_id").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts that with the smallest doc_id stays."""
    return _keep(docs, exact_dedup.exact_duplicates(docs).filter("kept")).dropDuplicates(["doc_id"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document that names it stays."""
    return _keep(docs, jaccard_join.near_duplicates(docs).filter("doc_id = class_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that sources, languages and topics come near their target weights."""
    return _keep(docs, mixing.mix(docs, mixing.form_topic(F.col("text"))).filter("drawn"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their places in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Kernels, connected components and hashes of the stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def name_rows(docs: DataFrame, work: Work) -> tuple[DataFrame, DataFrame | None]:
    """The documents with an id for each text, and a table of names (name, doc_id) or None where no id was given.

    Stages tell documents by their ids alone. Rows without an id, and rows that repeat an id with another text than
    that of the least digest, get a name of 62 bits made from id and text, which no other row has; like a null id they
    mostly stand behind all others. Rows that repeat an id and its text stay as they are: they are exact copies.
    """
    digest = F.sha2(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")).cast("binary"), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"))
    ids = rows.filter("doc_id IS NOT NULL")
    repeated = work.table(ids.groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).filter("first != last").select("doc_id", "first"), "repeated")
    others = ids.join(repeated, "doc_id").filter("digest != first").select("doc_id", "digest")
    odd = work.table(others.unionByName(rows.filter("doc_id IS NULL")).distinct(), "odd")
    n, seed = odd.count(), 0
    if not n:
        return docs, None
    while True:
        name = F.pmod(F.xxhash64("doc_id", "digest", F.lit(seed)), F.lit(1 << 62)) + F.lit(1 << 62)
        names = work.table(odd.select("doc_id", "digest", name.alias("name")), f"names-{seed}")
        if names.select("name").distinct().count() == n and names.join(ids, names["name"] == ids["doc_id"], "left_semi").isEmpty():
            break
        seed += 1
    known = F.broadcast(repeated) if repeated.count() <= exact_dedup.BROADCAST_ROWS else repeated
    whole = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(known, "doc_id", "left").withColumn("digest", digest)
    own = F.when(F.col("doc_id").isNull() | (F.col("digest") != F.col("first")), name).otherwise(F.col("doc_id"))
    return whole.select(own.alias("doc_id"), *COLUMNS[1:]), names.select("name", "doc_id")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents that every stage keeps, also of those without an id or with one that others have too.

    An empty table, or one without any language to learn, gives no pieces.
    """
    work = Work(spark, "pipeline")
    docs, names = name_rows(documents(spark, sf_dir), work)
    for k, (_, stage) in enumerate(STAGES):
        docs = work.table(stage(spark, docs, sf_dir), f"stage-{k}")
    if names is None:
        return docs
    columns = docs.columns
    out = docs.withColumnRenamed("doc_id", "name").join(names.withColumn("named", F.lit(True)), "name", "left")
    return out.withColumn("doc_id", F.when(F.col("named"), F.col("doc_id")).otherwise(F.col("name"))).select(*columns)
