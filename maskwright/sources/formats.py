"""What a file is, by its bytes: format sniffing, text decoding, shape checks, upload gate."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions.jsregex import WS
from maskwright.functions.let import let
from maskwright.functions.strings import js_trim, safe_file_name
from maskwright.plans.options import MAX_TEXT

#: Formats with media types and extensions, and what each one's handling promises.
FORMATS = {
    "txt": ("text/plain", ".txt"),
    "csv": ("text/csv", ".csv"),
    "json": ("application/json", ".json"),
    "pdf": ("application/pdf", ".pdf"),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".docx"),
}
MAX_FILE_BYTES = 10 * 1024 * 1024
#: How far into a ZIP container the marker of a Word document is looked for.
MARKER_REACH, MARKER = 64 * 1024, "word/document.xml"
HEADER_REACH = 1024


def strict_json(text: str) -> bool:
    """Whether a text is one JSON value, with nothing that only lenient parsers take."""

    def refuse(_: str) -> None:
        raise ValueError

    stripped = text.strip("\t\n\r ")
    try:
        json.loads(stripped, parse_constant=refuse, strict=True)
    except (ValueError, RecursionError):
        return False
    return True


@F.pandas_udf(T.BooleanType())
def _json(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else strict_json(v))


def json_valid(text: Column) -> Column:
    """Strict JSON. Spark's own parsers take trailing text and refuse repeated keys, so Python parses."""
    return _json(text)


def looks_like_json(text: Column) -> Column:
    """An object or array, strictly; only texts that begin like one are parsed."""
    start = js_trim(text).rlike(r"\A[{\[]")
    return start & F.coalesce(_json(F.when(start, js_trim(text))), F.lit(False))


def line_columns(text: Column, keep: str = ".") -> Column:
    """Comma-separated columns of each line that has a match of ``keep``."""
    lines = F.filter(F.split(text, "\r?\n", -1), lambda x: x.rlike(keep))
    return F.transform(lines, lambda x: F.size(F.split(x, ",", -1)))


def looks_like_csv(text: Column) -> Column:
    """At least two of the first ten non-blank lines, all with the same number of columns over one."""
    counts = F.slice(line_columns(text, rf"(?s)[^{WS[1:-1]}]"), 1, 10)
    return let(counts, lambda c: (F.size(c) >= 2) & (F.array_min(c) > 1) & (F.array_min(c) == F.array_max(c)))


def csv_shape_kept(before: Column, after: Column) -> Column:
    """Whether both texts have the same columns on the same lines, empty ones aside."""
    return line_columns(before, r"(?s)\A.") == line_columns(after, r"(?s)\A.")


def declared_format(extension: Column) -> Column:
    plain = F.regexp_replace(F.lower(extension), r"\A\.", "")
    return F.when(plain.isin(*FORMATS), plain)


def sniffed(files: DataFrame, content: str = "content", extension: str | None = "extension") -> DataFrame:
    """``files`` with format, evidence, mismatch, text (of text formats) and error_code.

    Order: PDF signature, ZIP signature with a Word body, else strict UTF-8 without NUL; then JSON,
    CSV where declared (or undeclared and shaped like it), else plain text. Nothing else is accepted.
    """
    raw = F.col(content)
    declared = declared_format(F.col(extension)) if extension else F.lit(None).cast("string")
    head = F.substring(raw, 1, 5)
    is_pdf, is_zip = head == F.lit(b"%PDF-"), F.substring(raw, 1, 4) == F.lit(b"PK\x03\x04")
    is_docx = is_zip & F.contains(F.decode(F.substring(raw, 1, MARKER_REACH), "ISO-8859-1"), F.lit(MARKER))
    plain = F.is_valid_utf8(raw.cast("string")) & ~is_pdf & ~is_zip
    own = files.withColumn("text", F.when(plain, F.regexp_replace(raw.cast("string"), "\\A\ufeff", "")))
    own = own.withColumn("text", F.when(~F.contains(F.col("text"), F.lit("\0")), F.col("text")))
    own = own.withColumn("_json", looks_like_json(F.col("text")))
    csv = (declared == "csv") | (declared.isNull() & looks_like_csv(F.col("text")))
    kind = F.when(is_pdf, "pdf").when(is_docx, "docx").when(F.col("text").isNull(), None).when(F.col("_json"), "json").when(csv, "csv").otherwise("txt")
    own = own.withColumn("format", kind).drop("_json")
    evidence = F.when(F.col("format").isin("pdf", "docx"), "signature").when(F.col("format") == "json", "content-parse").when(F.col("format").isNotNull(), "text-heuristic")
    error = F.when(F.col("format").isNull(), F.lit("UNSUPPORTED_FORMAT")).when(F.length("text") > MAX_TEXT, F.lit("INVALID_INPUT"))
    return own.withColumns({"evidence": evidence, "mismatch": F.coalesce(declared != F.col("format"), F.lit(False)), "error_code": error})


def validated(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """The upload gate over (file_name, content): size first, then content, then a harmless name.

    Refused files keep their row, with error_code and no content.
    """
    size = F.octet_length("content")
    early = F.when(F.coalesce(size, F.lit(0)) == 0, F.lit("INVALID_INPUT")).when(size > max_bytes, F.lit("FILE_TOO_LARGE"))
    extension = F.regexp_extract(F.col("file_name"), r"\.([A-Za-z0-9]{1,8})\z", 1)
    own = files.withColumns({"_early": early, "content": F.when(early.isNull(), F.col("content")), "_ext": F.when(extension != "", extension)})
    own = sniffed(own, extension="_ext").withColumn("error_code", F.coalesce("_early", "error_code"))
    suffix = F.create_map(*(F.lit(x) for f, (_, e) in FORMATS.items() for x in (f, e)))[F.col("format")]
    note = F.when(F.col("mismatch"), F.concat(F.lit("The file extension did not match its contents; it was processed as "), F.col("format"), F.lit(".")))
    refused = F.col("error_code").isNotNull()
    return own.withColumns({"safe_name": F.when(~refused, safe_file_name(F.col("file_name"), suffix)), "note": note, "content": F.when(~refused, F.col("content"))}).drop("_early", "_ext")


def pdf_plausible(content: Column) -> Column:
    """Null if a PDF header stands at the very start, else the error: none within reach, or data before it."""
    reach = F.decode(F.substring(content, 1, HEADER_REACH + 5), "ISO-8859-1")
    at = F.instr(reach, "%PDF-")
    return F.when((F.octet_length(content) < 5) | (at == 0), F.lit("MALFORMED_DOCUMENT")).when(at > 1, F.lit("SUSPICIOUS_DOCUMENT"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file_name and content of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("file_name"), "content")


def generated(text: Column, original: Column, format_: Column) -> Column:
    """struct<bytes, error_code>: a sanitized text as a file of its format, if it still is one."""
    broken = F.when((format_ == "json") & ~F.coalesce(json_valid(F.when(format_ == "json", text)), F.lit(False)), F.lit("MALFORMED_DOCUMENT")).when((format_ == "csv") & ~csv_shape_kept(original, text), F.lit("MALFORMED_DOCUMENT"))
    broken = F.when(format_.isin("txt", "csv", "json"), broken).otherwise(F.lit("NOT_IMPLEMENTED"))
    return F.struct(F.when(broken.isNull(), F.encode(text, "UTF-8")).alias("bytes"), broken.alias("error_code"))


def format_capabilities(spark: SparkSession) -> DataFrame:
    """What each format's handling promises. PDF files come out as new documents of their text."""
    rows = [
        ("txt", True, True, True, False, False, ["text-replacement"]),
        ("csv", True, True, True, False, False, ["text-replacement"]),
        ("json", True, True, True, False, False, ["text-replacement"]),
        ("pdf", True, False, True, True, True, ["content-removal"]),
        ("docx", True, True, True, True, True, ["text-replacement"]),
    ]
    own = spark.createDataFrame(rows, "format string, true_text_replacement boolean, preserves_layout boolean, supports_verification boolean, may_contain_hidden_text boolean, may_contain_embedded_files boolean, supported_modes array<string>")
    media = F.create_map(*(F.lit(x) for f, (m, _) in FORMATS.items() for x in (f, m)))
    return own.withColumn("media_type", media[F.col("format")])
