"""The thin queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import bpe, html_text, media, mixing, neighbours, quality, simhash, token_counts, token_files, toxicity
from maskwright.llm.common import shared_dir, table, unique


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.counted(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.filter(F.col("vec_id") % 20 == 0), k=20)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{shared_dir(spark)}/{unique('token-file')}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), to, end_id=2)
    tokens = spark.read.schema(token_files.FILE_SCHEMA).parquet(to)
    return token_files.with_starts(token_files.checksums(tokens), tokens).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{shared_dir(spark)}/{unique('token-counts')}"
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), cache)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, source_size * CAST(2.0 AS DOUBLE) AS bound FROM s
), r AS (
  SELECT *, coalesce(sum(bound) OVER (ORDER BY bound / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(0 AS DOUBLE)) AS filled,
    sum(weight) OVER (ORDER BY bound / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
    CAST(sum(source_size) OVER () AS DOUBLE) AS everything
  FROM w
), l AS (
  SELECT *, (everything * CAST(1.5 AS DOUBLE) - filled) / weight_left AS level FROM r
), m AS (
  SELECT *, max(CASE WHEN level * weight <= bound THEN level END) OVER () AS found FROM l
), t AS (
  SELECT source, source_size, least(bound, coalesce(found * weight, bound)) AS target FROM m
), k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '|mix-1'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_neighbours": op2_neighbours,
        "op3_html": op3_html,
        "op4_simhash": op4_simhash,
        "op5_token_files": op5_token_files,
        "op6_token_counts": op6_token_counts,
        "op7_bpe": op7_bpe,
        "op8_media": op8_media,
        "op9_toxicity": op9_toxicity,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL}
