"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import written

#: Tables of sources up to this many rows are broadcast; larger ones are joined with salted keys.
BROADCAST_SOURCES = 100_000
#: Ways in which a source's documents are split for that join.
SALTS = 64


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of the key's MD5; the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target for a table (source, source_size) with a row for each source.

    Weights go round by code point of the source, null last. Filling by weight until a source holds
    ``most`` times its size, and resharing what it can't take, ends where one level times the weight,
    or that bound if less, adds up to ``share`` of all sizes. With the sources in the order in which
    they fill up, the level follows from two running sums; the windows see sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    wide = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    own = sizes.withColumn("weight", weight.cast("double")).withColumn("bound", F.col("source_size") * F.lit(float(most)))
    filling = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    own = own.withColumn("full", F.coalesce(F.sum("bound").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    own = own.withColumn("left", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    own = own.withColumn("all", F.sum("source_size").over(wide))
    level = (F.col("all") * F.lit(float(share)) - F.col("full")) / F.col("left")
    own = own.withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("bound"), level)).over(wide))
    return own.select("source", "source_size", F.least("bound", F.coalesce(F.col("level") * F.col("weight"), F.col("bound"))).alias("target"))


def rates(docs: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """The table of ``targets`` with ``rate``, how often a source's documents repeat; written, as it is small."""
    sizes = docs.groupBy("source").agg(F.sum(words(F.col("text"))).alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return written(targets(sizes, weights, share, most).withColumn("rate", rate), "mix-rates")


def counted(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (size times copies).

    A document gets floor(rate) copies and one more if its hash falls below the rate's fraction, so
    a source's words come near its target and no document exceeds ``most`` times its size, rounded
    up. Rows with the same doc_id share their draw. A null source is a source of its own; an empty
    table stays empty. Columns of docs named like the new ones are replaced.
    """
    new = ("size", "source_size", "target", "rate", "copies", "taken")
    docs = docs.drop(*new)
    mix = rates(docs, weights, share, most).withColumnRenamed("source", "mix_source")
    own = docs.withColumn("size", words(F.col("text")))
    same = F.col("source").eqNullSafe(F.col("mix_source"))
    if mix.count() <= BROADCAST_SOURCES:
        own = own.join(F.broadcast(mix), same)
    else:
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
        many = mix.withColumn("mix_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        own = own.withColumn("own_salt", salt).join(many, same & (F.col("own_salt") == F.col("mix_salt"))).drop("own_salt", "mix_salt")
    whole = F.floor("rate")
    copies = whole + (uniform(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    return own.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop("mix_source", "rate")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as ``counted`` says, with the columns of ``docs``."""
    own = counted(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", "source"), **how)
    return own.filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
