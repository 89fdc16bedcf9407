"""Whole files through the engine: bytes in, verified bytes or a refusal out.

Each format has a reader and a writer; a file that no reader takes keeps its row with an error code.
What is verified is the text read back from the bytes that were written, by the readers alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions.strings import nfkc, sanitized_file_name
from maskwright.operators import anonymize, verify
from maskwright.operators.registry import Registry
from maskwright.plans.options import MAX_TEXT, AnalyzeOptions
from maskwright.plans.pipeline import analyze, normal_forms
from maskwright.sources import docx, formats, pdf
from maskwright.sources.arrow import with_columns
from maskwright.sources.assembly import for_detection
from maskwright.sources.docx import BadDocument

STRINGS = T.ArrayType(T.StringType())
#: Formats whose bytes are more than their text.
CONTAINERS = ("docx", "pdf")


def _read(format_: str, raw: bytes | None) -> tuple:
    """text, regions, warnings, unreadable, error of a container; nulls for other files."""
    if raw is None:
        return None, None, None, None, None
    try:
        if format_ == "pdf":
            found = pdf.read_pdf(raw)
            regions = sorted({"annotation" if ":" in x[5:] else "body" for x in found["locators"]})
            return found["text"], regions, found["warnings"], found["unreadable"], None
        found = docx.read_docx(raw)
        return found.text, sorted({r.region for r in found.runs}), found.warnings, found.unreadable, None
    except BadDocument as e:
        return None, None, None, None, e.code


def _write(format_: str, raw: bytes | None, original: str | None, sanitized: str | None, replaced: list[dict] | None) -> tuple:
    """bytes, warnings, error of a rewritten container."""
    if raw is None or sanitized is None:
        return None, None, None
    try:
        if format_ == "pdf":
            made, lost = pdf.write_pdf(sanitized)
            return made, [f"{lost} character(s) that the font lacks were set as question marks."] if lost else [], None
        return docx.rewrite_docx(raw, original, [(x["start"], x["end"], x["placeholder"]) for x in replaced or ()]), [], None
    except BadDocument as e:
        return None, None, e.code


def _swept(raw: bytes | None) -> tuple:
    """All text inside a PDF file, and what it holds that a written one must not."""
    if raw is None:
        return None, None
    try:
        return pdf.sweep(raw)
    except BadDocument:
        return None, None


def extract(files: DataFrame, max_bytes: int = formats.MAX_FILE_BYTES) -> DataFrame:
    """``files`` (file_name, content) with format, safe_name, text, regions, extract_warnings, unreadable, error_code.

    Containers are read in one Arrow pass; nothing that was not read is passed on.
    """
    own = formats.validated(files, max_bytes).withColumnRenamed("text", "_plain")
    own = own.withColumn("_raw", F.when(F.col("format").isin(*CONTAINERS), F.col("content")))
    own = with_columns(own, _read, ("format", "_raw"), text=T.StringType(), regions=STRINGS, extract_warnings=STRINGS, unreadable=STRINGS, _bad=T.StringType())
    long = F.when(F.length("text") > MAX_TEXT, F.lit("INVALID_INPUT"))
    own = own.withColumn("error_code", F.coalesce("error_code", "_bad", long))
    readable, empty = F.col("error_code").isNull(), F.array().cast("array<string>")
    own = own.withColumns({"text": F.when(readable, F.coalesce("text", "_plain")), "regions": F.when(readable, F.coalesce("regions", F.array(F.lit("body"))))})
    own = own.withColumns({"extract_warnings": F.coalesce("extract_warnings", empty), "unreadable": F.coalesce("unreadable", empty)})
    return own.drop("_raw", "_plain", "_bad")


def generate(docs: DataFrame, text: str = "sanitized", replaced: str = "_applied") -> DataFrame:
    """``docs`` with bytes in each one's format and generate_warnings; one that would come out broken has an error_code."""
    spans = F.transform(replaced, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["placeholder"].alias("placeholder")))
    inside = F.col("format").isin(*CONTAINERS)
    own = docs.withColumn("_plain", F.when(~inside, formats.generated(F.col(text), F.col("text"), F.col("format"))))
    own = own.withColumns({"_raw": F.when(inside, F.col("content")), "_spans": spans})
    own = with_columns(own, _write, ("format", "_raw", "text", text, "_spans"), bytes=T.BinaryType(), generate_warnings=STRINGS, _bad=T.StringType())
    error = F.coalesce("error_code", "_bad", "_plain.error_code")
    own = own.withColumns({"error_code": error, "bytes": F.when(error.isNull(), F.coalesce("bytes", "_plain.bytes")), "generate_warnings": F.coalesce("generate_warnings", F.array().cast("array<string>"))})
    return own.drop("_plain", "_raw", "_spans", "_bad")


def reread(docs: DataFrame) -> DataFrame:
    """``docs`` with ``read_back``, the text of the bytes written (null if they can't be read), and for PDF files inside and leftovers."""
    inside = F.col("format").isin(*CONTAINERS)
    own = docs.withColumns({"_raw": F.when(inside, F.col("bytes")), "_pdf": F.when(F.col("format") == "pdf", F.col("bytes"))})
    own = with_columns(own, lambda f, raw: _read(f, raw)[:1], ("format", "_raw"), _again=T.StringType())
    own = with_columns(own, _swept, ("_pdf",), inside=T.StringType(), leftovers=STRINGS)
    plain = F.when(~inside & F.is_valid_utf8(F.col("bytes").cast("string")), F.col("bytes").cast("string"))
    return own.withColumn("read_back", F.coalesce("_again", plain)).drop("_raw", "_pdf", "_again")


def process(files: DataFrame, options: AnalyzeOptions | None = None, excluded: Column | None = None, registry: Registry | None = None) -> DataFrame:
    """``files`` with bytes, sanitized_name, counts, checks, status and error_code.

    ``bytes`` is there only for a file whose every check passed.
    """
    none = F.array().cast("array<string>")
    # a value broken over lines of a page is one; offsets stay, as a line end becomes one space
    seen = F.when(F.col("format") == "pdf", for_detection(F.col("text"))).otherwise(F.col("text"))
    own = extract(files).withColumnRenamed("error_code", "_refused").withColumn("_seen", seen)
    own = analyze(own, options, text="_seen", registry=registry)
    own = own.withColumn("error_code", F.coalesce("_refused", "error_code")).drop("_refused")
    own = own.withColumn("_excluded", F.coalesce(excluded, none) if excluded is not None else none)
    own = own.withColumns({"_applied": anonymize.applied(F.col("detections"), F.col("_excluded")), "_skipped": anonymize.skipped(F.col("detections"), F.col("_excluded"))})
    own = own.withColumn("sanitized", anonymize.rewritten(F.col("text"), F.col("_applied")))
    own = reread(generate(own))
    own = own.withColumns({"_masked": verify.masked(F.col("read_back"), F.col("_applied"), F.col("_skipped")), "_forms": normal_forms(F.col("_applied"))})
    own = own.withColumn("_deep", verify.masked(F.col("inside"), F.col("_applied"), F.col("_skipped")))
    own = own.withColumns({"_masked": nfkc(F.col("_masked")), "_deep": nfkc(F.col("_deep"))})
    own = own.withColumns({"_hay": verify.haystack(F.col("_masked")), "_deep": verify.haystack(F.col("_deep"))})
    checks = verify.checks(F.col("read_back"), F.col("_hay"), F.col("_applied"), F.col("_forms"), F.col("unreadable"))
    deep = verify.pdf_checks(F.col("inside"), F.col("_deep"), F.col("leftovers"), F.col("_applied"), F.col("_forms"))
    checks = F.when(F.col("format") == "pdf", F.concat(checks, deep)).otherwise(checks)
    own = own.withColumn("checks", F.when(F.col("error_code").isNull(), F.when(F.col("read_back").isNull(), verify.unreadable_output()).otherwise(checks)))
    status = F.when(F.col("checks").isNotNull(), verify.worst(F.transform("checks", lambda c: c["status"])))
    own = own.withColumn("status", status).withColumn("error_code", F.coalesce("error_code", F.when(F.col("status") != "pass", F.lit("VERIFICATION_FAILED"))))
    passed = F.col("error_code").isNull()
    own = own.withColumns(
        {
            "bytes": F.when(passed, F.col("bytes")),
            "sanitized_name": F.when(passed, sanitized_file_name(F.col("safe_name"))),
            "replaced_groups": F.when(passed, F.size(F.array_distinct(F.transform("_applied", lambda x: x["group_id"])))),
            "replaced_occurrences": F.when(passed, F.size("_applied")),
        }
    )
    return own.drop("_excluded", "_applied", "_skipped", "_masked", "_forms", "_hay", "_deep", "_seen", "inside", "leftovers", "sanitized", "read_back")
