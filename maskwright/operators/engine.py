"""The detection engine: selected detectors, filters, overlap resolution and ids, in one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.let import let
from maskwright.operators.detection import none
from maskwright.operators.registry import Registry, default_registry
from maskwright.operators.resolve import resolve_overlaps
from maskwright.plans.options import MAX_TEXT, AnalyzeOptions

#: Breaks a table cell or document part; a value that holds it runs across one.
CELL_BREAK = "\x1f"


def well_formed(text: Column, found: Column) -> Column:
    """Whether offsets, values and confidences of all detections agree with the text."""

    def fine(x: Column) -> Column:
        inside = (x["start"] >= 0) & (x["end"] > x["start"]) & (x["end"] <= F.length(text))
        return inside & (F.substring(text, x["start"] + 1, x["end"] - x["start"]) == x["value"]) & x["confidence"].between(0, 1)

    return F.forall(found, fine)


def sound(text: Column, found: Column) -> Column:
    """Detections as they are, or null if any of them is malformed: replacing those would cut at the wrong places."""
    return let(found, lambda x: F.when(F.coalesce(well_formed(text, x), F.lit(False)), x))


def raw_detections(text: Column, options: AnalyzeOptions, registry: Registry | None = None) -> Column:
    """All detections of the enabled types, in order of emission. Types are dropped before overlaps are looked at.

    Null where a detector that is checked gives spans that don't agree with the text.
    """
    registry = registry or default_registry(options)
    built = [sound(text, d.build(text, options)) if d.checked else d.build(text, options) for d in registry.select(options.enabled_types)]
    found = F.concat(*built) if built else none()
    return F.filter(found, lambda x: x["type"].isin(*options.enabled_types) & ~x["value"].contains(CELL_BREAK))


def detect(text: Column, options: AnalyzeOptions, registry: Registry | None = None) -> Column:
    """Detections that stand, in document order, each with an id by its place.

    A text over the limit gives null, not a failed job; so do a null text and a detector's malformed result.
    """
    standing = resolve_overlaps(raw_detections(text, options, registry))

    def with_id(x: Column, i: Column) -> Column:
        return F.struct(F.format_string("d%05d", i).alias("id"), *(x[f].alias(f) for f in ("type", "start", "end", "value", "confidence", "detector", "metadata")))

    return F.when(F.length(text) <= MAX_TEXT, F.transform(standing, with_id))
