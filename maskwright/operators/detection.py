"""The record that every detector makes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DETECTION = "struct<type:string,start:int,end:int,value:string,confidence:double,detector:string,metadata:map<string,string>>"


def none() -> Column:
    """No detection."""
    return F.array().cast(f"array<{DETECTION}>")


def detections(found: Column, type_: str, confidence: float | Callable[[Column], Column], detector: str, metadata: Callable[[Column], Column] | None = None) -> Column:
    """An array of spans as detections of one type. Confidence and metadata may depend on the span."""

    def one(x: Column) -> Column:
        sure = confidence(x) if callable(confidence) else F.lit(confidence)
        about = metadata(x) if metadata else F.lit(None)
        return F.struct(
            F.lit(type_).alias("type"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            x["value"].alias("value"),
            sure.cast("double").alias("confidence"),
            F.lit(detector).alias("detector"),
            about.cast("map<string,string>").alias("metadata"),
        )

    return F.transform(found, one)


def shortened(found: Column, value: Callable[[Column], Column]) -> Column:
    """Spans whose value loses something at its end."""

    def one(x: Column) -> Column:
        kept = value(x["value"])
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(kept)).alias("end"), kept.alias("value"))

    return F.transform(found, one)
