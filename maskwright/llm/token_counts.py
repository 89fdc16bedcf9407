"""Token counts through a digest cache: a text is tokenised only if its digest was never counted.

The cache is a Parquet table (content, tokenizer, n_tokens) keyed by the SHA-256 of the normalised
content and that of the tokenizer file, so that a new tokenizer version misses and old counts stay.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import Shipped, in_arrow, join_unique, texts, written

#: Where a null doc_id stands in the order.
LOWEST = -(1 << 63)
CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"


def counting(file: bytes, suffix: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, from the bytes of a tokenizer file."""
    if suffix == ".model":
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=file)
        return lambda whole: [len(own.encode(t)) for t in whole]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    other = Tokenizer.from_buffer(file)
    other.no_truncation()
    other.no_padding()
    return lambda whole: [len(x.ids) for x in other.encode_batch_fast(whole, add_special_tokens=False)]


@cache
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """The same for a tokenizer file of this machine."""
    return counting(Path(path).read_bytes(), Path(path).suffix)


def normalised(text: Column) -> Column:
    """What is digested: the text itself, null as empty. Anything more could change a count."""
    return F.coalesce(text.cast("string"), F.lit(""))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, content of every row."""
    text = normalised(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest(text).alias("content"))


def cached_counts(spark: SparkSession, cache_dir: str, version: str) -> DataFrame:
    """content, n_tokens that the cache holds for a tokenizer version, each content once: writers that
    counted the same text at once, or an append that was tried again, leave several rows. Nothing, if the folder isn't there."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.filter(F.col("tokenizer") == version).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def count_misses(docs: DataFrame, contents: DataFrame, known: DataFrame, file: Shipped) -> DataFrame:
    """Cache rows for the distinct ``contents`` (content, chosen) that ``known`` (content) lacks.

    One document stands for all copies of its content, the one of the smallest doc_id. The texts move
    once, dealt by content and doc_id together, so that any number of copies spreads evenly, and meet
    the chosen documents there.
    """
    chosen = contents.select("content", "chosen").join(known.select("content"), "content", "left_anti")
    texts_of = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("chosen"), normalised(F.col("text")).alias("text")).withColumn("content", digest(F.col("text")))
    missed = texts_of.join(chosen.hint("shuffle_hash"), ["content", "chosen"], "left_semi").select("content", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = file.made(counting)(texts(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("content"), pa.array(np.array(n, dtype=np.int64))], names=["content", "n_tokens"])

    counts = in_arrow(missed, work, "content binary, n_tokens long", rows=64)
    # rows that repeat both id and text were counted alike
    return counts.groupBy("content").agg(F.min("n_tokens").alias("n_tokens")).select("content", F.lit(file.digest).alias("tokenizer"), "n_tokens")


def count_tokens(docs: DataFrame, path: str, cache_dir: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, after appending what the cache missed.

    A null text is empty: no bytes, no tokens. Repeated rows stay repeated. ``docs`` may be empty and
    have further columns, which are dropped; the cache folder may not exist yet, and may hold a content
    several times. Rows that share a content with very many others stay where they are.
    """
    spark, file = docs.sparkSession, Shipped(docs.sparkSession, path)
    rows = written(keyed(docs), "count-keys")
    contents = written(rows.groupBy("content").agg(F.min(F.coalesce("doc_id", F.lit(LOWEST))).alias("chosen"), F.count("*").alias("n")), "count-contents")
    count_misses(docs, contents, cached_counts(spark, cache_dir, file.digest), file).write.mode("append").parquet(cache_dir)
    counts = cached_counts(spark, cache_dir, file.digest)
    found = join_unique(rows, counts, "content", contents.select("content", "n"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
