"""Analyze and sanitize whole tables of documents.

Every step is an expression over one row: no shuffle, so the plan scales with the scan and runs on
streams as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.let import once
from maskwright.functions.strings import nfkc
from maskwright.operators import anonymize, verify
from maskwright.operators.engine import detect
from maskwright.operators.registry import Registry, default_registry
from maskwright.plans.options import MAX_TEXT, AnalyzeOptions

#: The status that an error of a kind answers a request with.
HTTP_STATUS = {
    "INVALID_INPUT": 400,
    "UNSUPPORTED_FORMAT": 415,
    "FILE_TOO_LARGE": 413,
    "MALFORMED_DOCUMENT": 422,
    "SUSPICIOUS_DOCUMENT": 422,
    "NOT_IMPLEMENTED": 501,
    "SESSION_NOT_FOUND": 404,
    "SESSION_EXPIRED": 410,
    "CAPACITY_EXCEEDED": 503,
    "VERIFICATION_FAILED": 422,
    "INTERNAL_ERROR": 500,
}


def normal_forms(found: Column) -> Column:
    """The values of detections in normal form KC, in order."""
    return F.transform(found, lambda x: nfkc(x["value"]))


def analyze(docs: DataFrame, options: AnalyzeOptions | None = None, text: str = "text", registry: Registry | None = None) -> DataFrame:
    """``docs`` with detections (placeholders assigned), groups, warnings and error_code.

    A text over the limit has no detections and error_code INVALID_INPUT; a null text MALFORMED_DOCUMENT;
    one for which a detector gave spans that aren't in it INTERNAL_ERROR.
    """
    options = options or AnalyzeOptions()
    registry = registry or default_registry(options)
    warnings = F.array(*map(F.lit, registry.warnings(options.enabled_types))).cast("array<string>")
    own = docs.withColumn("_found", detect(F.col(text), options, registry))
    own = own.withColumn("_forms", normal_forms(F.col("_found")))
    own = own.withColumn("detections", anonymize.assign(F.col("_found"), forms=F.col("_forms"))).drop("_found", "_forms")
    failed = F.when(F.col(text).isNull(), F.lit("MALFORMED_DOCUMENT")).when(F.length(text) > MAX_TEXT, F.lit("INVALID_INPUT")).when(F.col("detections").isNull(), F.lit("INTERNAL_ERROR"))
    return own.withColumns({"groups": anonymize.groups(F.col("detections")), "warnings": warnings, "error_code": failed})


def sanitize(analyzed: DataFrame, excluded: Column | None = None, text: str = "text", mode: str = "text-replacement", unreadable: str | None = None) -> DataFrame:
    """``analyzed`` with sanitized text, counts, checks and status, all verified on the text written.

    ``excluded`` holds placeholders to keep. A document that analysis refused stays refused.
    """
    none = F.array().cast("array<string>")
    own = analyzed.withColumn("_excluded", F.coalesce(excluded, none) if excluded is not None else none)
    own = own.withColumns({"_applied": anonymize.applied(F.col("detections"), F.col("_excluded")), "_skipped": anonymize.skipped(F.col("detections"), F.col("_excluded"))})
    own = own.withColumn("sanitized", anonymize.rewritten(F.col(text), F.col("_applied")))
    if mode == "visual-redaction":
        own = own.withColumn("checks", verify.visual_only())
    else:
        # where nothing was replaced, nothing is looked for
        searched = F.when(F.size("_applied") > 0, verify.masked(F.col("sanitized"), F.col("_applied"), F.col("_skipped"))).otherwise("")
        own = own.withColumns({"_masked": searched, "_forms": normal_forms(F.col("_applied"))})
        own = own.withColumn("_masked", nfkc(F.col("_masked")))
        own = own.withColumn("_hay", verify.haystack(F.col("_masked")))
        own = own.withColumn("checks", verify.checks(F.col("sanitized"), F.col("_hay"), F.col("_applied"), F.col("_forms"), F.col(unreadable) if unreadable else None))
    status = verify.worst(F.transform("checks", lambda c: c["status"]))
    own = own.withColumns(
        {
            "status": F.when(F.col("error_code").isNull(), status),
            "unverified_types": verify.unverified_types(F.col("checks"), F.col("_applied")),
            "replaced_groups": F.size(F.array_distinct(F.transform("_applied", lambda x: x["group_id"]))),
            "replaced_occurrences": F.size("_applied"),
        }
    )
    return own.drop("_excluded", "_applied", "_skipped", "_masked", "_forms", "_hay")


@dataclass(frozen=True)
class Gate:
    """Documents that may go out, and the rest with the reason and no text."""

    released: DataFrame
    quarantined: DataFrame


def gate(sanitized: DataFrame, text: str = "text") -> Gate:
    """Only documents of which every check passed are released; of others, placeholders at most are told."""
    code = F.coalesce("error_code", F.when(F.coalesce(F.col("status") != "pass", F.lit(True)), F.lit("VERIFICATION_FAILED")))
    judged = sanitized.withColumn("error_code", once(code))
    offending = F.array_distinct(F.flatten(F.transform("checks", lambda c: c["offending"])))
    hidden = [c for c in (text, "sanitized", "detections", "groups", "checks") if c in sanitized.columns]
    status = F.create_map(*(F.lit(x) for pair in HTTP_STATUS.items() for x in pair))[F.col("error_code")]
    return Gate(
        judged.filter("error_code IS NULL").drop("error_code"),
        judged.filter("error_code IS NOT NULL").withColumns({"offending": offending, "http_status": status}).drop(*hidden),
    )


def blocks_release(warnings: Column) -> Column:
    """Whether analysis said already that the document can't pass."""
    return F.exists(warnings, lambda w: w.contains("cannot be verified as sanitized"))


def exploded(analyzed: DataFrame, *keys: str) -> DataFrame:
    """A row for each detection, with the key columns: the form that joins, windows and reports work on."""
    own = analyzed.withColumn("detections", once(F.col("detections")))
    return own.select(*keys, F.posexplode("detections").alias("ord", "d")).select(*keys, "ord", "d.*")
