"""Incremental ingestion of files; the batch operators are applied to each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factlattice.sources.convert import convert_files
from factlattice.sources.ir import Limits


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, limits: Limits | None = None):
    """Converts files as they arrive below `source` and appends the documents to `target`; stops when all are done."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(source)

    def write(batch: DataFrame, number: int) -> None:
        convert_files(batch.select("path", "content"), limits).write.mode("overwrite").parquet(f"{target}/batch={number}")  # a batch that is run again replaces itself

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
