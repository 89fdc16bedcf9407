"""Corpus pipeline: quality, toxicity, near-duplicates, mixing, and token ids.

A stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run`` writes every
stage's result to the shared folder as Parquet and reads it again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import bpe, mixing, quality, simhash, toxicity
from maskwright.llm.common import Scratch, table
from maskwright.llm.queries import tokenizer


def kept(docs: DataFrame, scored: Callable[[DataFrame], DataFrame], condition: str) -> DataFrame:
    """The rows of ``docs`` whose scores meet a condition; columns named like the scores' stay what they were."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    out = scored(docs.select(rest, "text")).filter(condition)
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score 0.3 or more for quality, by a classifier trained on these documents' labels.

    A null text is scored as empty, a row with a null doc_id teaches nothing; repeated rows are scored alike
    and all stay or go. Without labels, every text gets one score. An empty table stays empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return kept(docs, lambda d: quality.scored(d, model, 0.3, "quality_score"), "predicted = 1")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more for toxicity, by a classifier trained on these documents' labels.

    Nulls, repeated rows, missing labels and empty tables are as in ``keep_quality``; without labels none goes.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return kept(docs, lambda d: toxicity.scored(d, model, 0.5, "toxic_score"), "predicted = 0")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, Jaccard 0.8 or more), that of the smallest doc_id.

    Texts without words, null ones too, are one group; a null doc_id stays only where its group has no
    other; of rows that tie in doc_id and text the first one read stays. An empty table stays empty.
    """
    return simhash.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents until the sources' words have their target weights.

    A null source is one of its own, a text without words weighs nothing and follows its source's rate;
    rows with one doc_id share a draw. An empty table stays empty.
    """
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids of each whole text, their number and whether decoding them gives the text.

    A null text has no ids, like an empty one, and counts as given back; rows stay one by one.
    """
    ids = bpe.encode_rows(docs.select("doc_id", "source", "text"), tokenizer("byte_bpe_50k.tiktoken"), checked="round_trip")
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("token_ids", token_ids),
]

#: The classifiers can't be said in SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        own = Scratch(spark, f"pipeline-{name}")
        docs = own.keep(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        before = own
    return docs
