"""Reports over the detections of a corpus: exploded rows, joined and aggregated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.operators import anonymize


def by_type(found: DataFrame, *keys: str) -> DataFrame:
    """Detections, documents that have them, and mean confidence, by type and keys."""
    return found.groupBy(*keys, "type").agg(F.count("*").alias("detections"), F.countDistinct("doc_id").alias("documents"), F.round(F.avg("confidence"), 6).alias("confidence"))


def cube(found: DataFrame, *keys: str) -> DataFrame:
    """Detections for every combination of the keys, totals included; a total's key is 'ALL'."""
    counted = found.cube(*keys).agg(F.count("*").alias("detections"), *(F.grouping(k).alias(f"_{k}") for k in keys))
    return counted.select(*(F.when(F.col(f"_{k}") == 1, F.lit("ALL")).otherwise(F.col(k)).alias(k) for k in keys), "detections")


def top_documents(found: DataFrame, n: int) -> DataFrame:
    """The n documents with most detections, ties by doc_id: each partition keeps n, no full sort."""
    return found.groupBy("doc_id").agg(F.count("*").alias("detections"), F.countDistinct("value").alias("distinct_values")).orderBy(F.desc("detections"), "doc_id").limit(n)


def canonical_key(type_: Column, value: Column, metadata: Column) -> Column:
    return anonymize.canonical(type_, value, metadata)


def shared_values(found: DataFrame, least: int = 2) -> DataFrame:
    """Values by what makes them one, with their documents, where at least so many have them.

    An aggregation over the key takes the place of a self-join, which would pair all documents of a value.
    """
    keyed = found.withColumn("key", canonical_key(F.col("type"), F.col("value"), F.col("metadata")))
    counted = keyed.groupBy("type", "key").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("occurrences"), F.min("doc_id").alias("first_doc"))
    return counted.filter(F.col("documents") >= least)


def placeholder_numbers(found: DataFrame) -> DataFrame:
    """Group numbers by window functions over exploded rows: the same as the row-local allocation.

    For corpora whose single documents have too many detections for one row.
    """
    keyed = found.withColumns({"label": anonymize.label(F.col("type"), F.col("metadata")), "key": canonical_key(F.col("type"), F.col("value"), F.col("metadata"))})
    first = F.min("start").over(Window.partitionBy("doc_id", "label", "key"))
    ranked = keyed.withColumn("_first", first).withColumn("number", F.dense_rank().over(Window.partitionBy("doc_id", "label").orderBy("_first")).cast("long"))
    return ranked.withColumn("placeholder", anonymize.bracketed(F.col("label"), F.col("number"))).drop("_first")
