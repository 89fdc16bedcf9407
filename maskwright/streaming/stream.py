"""Streams of documents: the same row-local expressions, released and quarantined as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from maskwright.plans.options import AnalyzeOptions
from maskwright.plans.pipeline import analyze, gate, sanitize


def read_documents(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 64) -> DataFrame:
    """New Parquet files under a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sanitize_stream(docs: DataFrame, options: AnalyzeOptions | None = None) -> DataFrame:
    """A stream's documents sanitized and verified: no state, no watermark, no shuffle."""
    return sanitize(analyze(docs, options))


def write_gated(sanitized: DataFrame, released: str, quarantined: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes what passed to one folder and the rest, without text, to another, exactly once a batch.

    Folders are kept by batch: a batch that is repeated after a failure takes its own place again.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            parts = gate(rows)
            parts.released.write.mode("overwrite").parquet(f"{released}/batch={number}")
            parts.quarantined.write.mode("overwrite").parquet(f"{quarantined}/batch={number}")
        finally:
            rows.unpersist()

    writer = sanitized.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
