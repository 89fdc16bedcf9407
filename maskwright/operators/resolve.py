"""Overlap resolution: of claims on the same characters, the strongest stay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.let import let
from maskwright.plans.options import PRIORITY


def priority(type_: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))[type_], F.lit(0))


def overlap(a: Column, b: Column) -> Column:
    """Touching spans don't overlap."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def resolve_overlaps(found: Column) -> Column:
    """The detections that stand, in document order.

    Longer beats shorter, then surer, then by type, then earlier, then by detector's name, and last
    by order of emission. Each is taken if it is clear of all taken before it.
    """

    def key(x: Column, i: Column) -> Column:
        # ascending: the strongest first
        return F.struct((x["start"] - x["end"]).alias("length"), (-x["confidence"]).alias("sure"), (-priority(x["type"])).alias("rank"), x["start"].alias("start"), x["detector"].alias("detector"), i.alias("ord"), x["end"].alias("end"))

    empty = F.array().cast("array<struct<start:int,end:int,ord:int>>")

    def take(taken: Column, x: Column) -> Column:
        own = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["ord"].alias("ord"))
        return F.when(F.exists(taken, lambda t: overlap(t, x)), taken).otherwise(F.concat(taken, F.array(own)))

    def standing(all_: Column) -> Column:
        taken = F.array_sort(F.aggregate(F.array_sort(F.transform(all_, key)), empty, take))
        return F.transform(taken, lambda t: F.get(all_, t["ord"]))

    # most texts have at most one claim
    return let(found, lambda all_: F.when(F.size(all_) <= 1, all_).otherwise(standing(all_)))
