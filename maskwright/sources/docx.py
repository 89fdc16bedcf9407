"""Word documents: a guarded reader of their text, and a writer of the rewritten package.

The container is checked before anything is inflated. Text comes from the runs of the body, headers,
footers, notes and comments, then from the descriptive properties; a run knows where its characters
stand in the part, so that replacements go back into the very runs they came from.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.sources.arrow import with_columns

#: What separates cells and parts, limits of a container, order of its parts, names of properties.
CELL_BREAK, PART_BREAK = "\x1f", "\n\x1f\n"
MAX_ENTRIES, MAX_INFLATED, MAX_RATIO = 512, 256 * 1024 * 1024, 120
PARTS = (
    (r"word/document\.xml", "body"),
    (r"word/header\d+\.xml", "header"),
    (r"word/footer\d+\.xml", "footer"),
    (r"word/footnotes\.xml", "footnote"),
    (r"word/endnotes\.xml", "footnote"),
    (r"word/comments\.xml", "annotation"),
    (r"docProps/core\.xml", "metadata"),
    (r"docProps/app\.xml", "metadata"),
)
PROPERTIES = frozenset("creator title subject description lastModifiedBy Company Manager".split())
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

MARKUP = re.compile(r"</w:tc|<w:((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
PROPERTY = re.compile(r"<((?:[A-Za-z0-9]+:)?([A-Za-z0-9]+))>([^<]*)</\1>")


class BadDocument(ValueError):
    """A container that is not read; ``code`` says what is wrong with it."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


@dataclass
class Run:
    """Characters start to end of the text, standing at inner_start to inner_end of a part."""

    part: str
    region: str
    start: int
    end: int
    inner_start: int
    inner_end: int


@dataclass
class Package:
    """A document's text and where it comes from."""

    text: str = ""
    runs: list[Run] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    unreadable: list[str] = field(default_factory=list)
    parts: dict[str, bytes] = field(default_factory=dict)


def inspect_zip(raw: bytes) -> dict:
    """Entries and declared sizes of a container, from its directory alone."""
    at = raw.rfind(b"PK\x05\x06", max(0, len(raw) - 65_557))
    if at < 0 or at + 22 > len(raw):
        raise BadDocument("SUSPICIOUS_DOCUMENT")
    count, cursor = struct.unpack_from("<H", raw, at + 10)[0], struct.unpack_from("<I", raw, at + 16)[0]
    if cursor >= len(raw):
        raise BadDocument("SUSPICIOUS_DOCUMENT")
    packed, plain, names = 0, 0, []
    for _ in range(count):
        if raw[cursor : cursor + 4] != b"PK\x01\x02" or cursor + 46 > len(raw):
            raise BadDocument("SUSPICIOUS_DOCUMENT")
        small, large = struct.unpack_from("<II", raw, cursor + 20)
        lengths = struct.unpack_from("<HHH", raw, cursor + 28)
        names.append(raw[cursor + 46 : cursor + 46 + lengths[0]].decode("utf-8", "replace"))
        packed, plain = packed + small, plain + large
        cursor += 46 + sum(lengths)
    return {"entries": count, "compressed": packed, "uncompressed": plain, "names": names}


def safe_zip(found: dict) -> bool:
    """Whether a container stays within the limits and its names within it."""
    too_much = found["entries"] > MAX_ENTRIES or found["uncompressed"] > MAX_INFLATED
    bomb = found["compressed"] > 0 and found["uncompressed"] / found["compressed"] > MAX_RATIO
    return not (too_much or bomb or any(n.startswith("/") or ".." in n or re.match("[A-Za-z]:", n) for n in found["names"]))


def read_zip(raw: bytes) -> dict[str, bytes]:
    """The entries of a safe container, inflated under a cap whatever they declare."""
    if not safe_zip(inspect_zip(raw)):
        raise BadDocument("SUSPICIOUS_DOCUMENT")
    out, left = {}, MAX_INFLATED
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for info in z.infolist():
                if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    raise BadDocument("MALFORMED_DOCUMENT")
                with z.open(info) as f:
                    data = f.read(left + 1)
                left -= len(data)
                if left < 0:
                    raise BadDocument("SUSPICIOUS_DOCUMENT")
                out[info.filename] = data
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, OSError) as e:
        raise BadDocument("MALFORMED_DOCUMENT") from e
    return out


def write_zip(parts: dict[str, bytes]) -> bytes:
    """A container of the parts, the same bytes every time."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def decode_xml(raw: str) -> str:
    """Character data with the five named and all numeric references read; impossible ones become U+FFFD."""

    def one(m: re.Match) -> str:
        body = m[1]
        if body in ENTITIES:
            return ENTITIES[body]
        code = int(body[2:], 16) if body[1] == "x" else int(body[1:])
        return "\ufffd" if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)

    return re.sub(r"&(amp|lt|gt|quot|apos|#x[0-9a-fA-F]+|#\d+);", one, raw)


def escape_xml(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def read_part(package: Package, name: str, xml: str, region: str) -> None:
    """Adds a part's runs: a line for each paragraph, a break for each table cell."""
    first, pending, depth, at = len(package.text), "", 0, 0
    while m := MARKUP.search(xml, at):
        at = m.end()
        if m[1] is None:
            depth = max(0, depth - 1)
            continue
        closed = m[1].rstrip().endswith("/")
        tag = re.match("[A-Za-z0-9]*", m[1])[0]
        if closed:
            continue
        if tag == "tc":
            depth += 1
            pending = CELL_BREAK if len(package.text) > first else pending
        elif tag == "p":
            if pending != CELL_BREAK and len(package.text) > first:
                pending = "\n"
        elif tag in ("t", "delText", "instrText"):
            end = xml.find(f"</w:{tag}>", at)
            if end < 0:
                return
            decoded = decode_xml(xml[at:end])
            package.text += pending
            pending = ""
            package.runs.append(Run(name, "table" if depth else region, len(package.text), len(package.text) + len(decoded), at, end))
            package.text += decoded
            at = end + len(tag) + 5


def read_properties(package: Package, name: str, xml: str) -> None:
    """Adds the descriptive properties, a line each."""
    first = len(package.text)
    for m in PROPERTY.finditer(xml):
        if m[2] in PROPERTIES:
            package.text += "\n" if len(package.text) > first else ""
            decoded = decode_xml(m[3])
            package.runs.append(Run(name, "metadata", len(package.text), len(package.text) + len(decoded), m.start(3), m.end(3)))
            package.text += decoded


def read_docx(raw: bytes) -> Package:
    """A document's text in the fixed order of its parts, with warnings and what could not be read."""
    package = Package(parts=read_zip(raw))
    if "word/document.xml" not in package.parts:
        raise BadDocument("MALFORMED_DOCUMENT")
    ranked = sorted((rank, name, region) for name in package.parts for rank, (pattern, region) in enumerate(PARTS) if re.fullmatch(pattern, name))
    for _, name, region in ranked:
        xml = package.parts[name].decode("utf-8", "replace")
        package.text += PART_BREAK if package.text and xml else ""
        if region == "metadata":
            read_properties(package, name, xml)
        else:
            read_part(package, name, xml, region)
    if any(n.startswith("word/media/") for n in package.parts):
        if package.text.strip():
            package.warnings.append("Pictures were kept. Text that appears only inside an image was not read and was not removed.")
        else:
            package.unreadable.append("word/media")
    if any(n.startswith("word/embeddings/") for n in package.parts):
        package.warnings.append("Embedded files were removed so they cannot carry unsanitized text.")
    return package


def run_text(text: str, start: int, end: int, replacements: list[tuple[int, int, str]]) -> str:
    """What a run says after replacement: the whole placeholder where a match begins, nothing where it goes on."""
    out, at = [], start
    for a, b, placeholder in replacements:
        if b <= at or a >= end:
            continue
        if a >= at:
            out += [text[at:a], placeholder]
        at = max(at, min(end, b))
    return "".join([*out, text[at:end]])


def rewrite_docx(raw: bytes, original: str, replacements: list[tuple[int, int, str]]) -> bytes:
    """The package with replaced text, without embedded files and reviewers' names.

    The text read again must be the one that was analysed, else the document is refused.
    """
    package = read_docx(raw)
    if package.text != original:
        raise BadDocument("MALFORMED_DOCUMENT")
    ordered = sorted(replacements)
    out = {}
    for name, data in package.parts.items():
        own = [r for r in package.runs if r.part == name]
        if name.startswith("word/embeddings/"):
            continue
        if own:
            xml, pieces, at = data.decode("utf-8", "replace"), [], 0
            for r in own:
                pieces += [xml[at : r.inner_start], escape_xml(run_text(original, r.start, r.end, ordered))]
                at = r.inner_end
            data = re.sub(r'\s(w:author|w:initials)="[^"]*"', r' \1=""', "".join([*pieces, xml[at:]])).encode()
        elif name.endswith(".rels") and b"embeddings/" in data:
            data = re.sub(rb'<Relationship\b[^>]*Target="embeddings/[^"]*"[^>]*/>', b"", data)
        out[name] = data
    return write_zip(out)


STRINGS = T.ArrayType(T.StringType())


def _extracted(raw: bytes | None) -> tuple:
    if raw is None:
        return None, None, None, None, None
    try:
        p = read_docx(raw)
    except BadDocument as e:
        return None, None, None, None, e.code
    return p.text, sorted({r.region for r in p.runs}), p.warnings, p.unreadable, None


def extracted(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with text, regions, extract_warnings, unreadable and extract_error; bad documents have only the error."""
    kinds = {"text": T.StringType(), "regions": STRINGS, "extract_warnings": STRINGS, "unreadable": STRINGS, "extract_error": T.StringType()}
    return with_columns(files, _extracted, (content,), **kinds)


def _rewritten(raw: bytes | None, original: str | None, replaced: list[dict] | None) -> tuple:
    if raw is None or original is None:
        return None, None
    try:
        return rewrite_docx(raw, original, [(x["start"], x["end"], x["placeholder"]) for x in replaced or ()]), None
    except BadDocument as e:
        return None, e.code


def rewritten(docs: DataFrame, content: str = "content", text: str = "text", replaced: str = "detections") -> DataFrame:
    """``docs`` with bytes, the document with its detections replaced by placeholders, and rewrite_error."""
    spans = F.transform(replaced, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["placeholder"].alias("placeholder")))
    own = docs.withColumn("_replaced", spans)
    return with_columns(own, _rewritten, (content, text, "_replaced"), bytes=T.BinaryType(), rewrite_error=T.StringType()).drop("_replaced")


def _inspected(raw: bytes | None) -> tuple:
    try:
        found = inspect_zip(raw or b"")
    except BadDocument as e:
        return None, None, None, False, e.code
    safe = safe_zip(found)
    return found["entries"], found["compressed"], found["uncompressed"], safe, None if safe else "SUSPICIOUS_DOCUMENT"


def inspected(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with what a container declares: entries, compressed, uncompressed, safe and zip_error."""
    kinds = {"entries": T.IntegerType(), "compressed": T.LongType(), "uncompressed": T.LongType(), "safe": T.BooleanType(), "zip_error": T.StringType()}
    return with_columns(files, _inspected, (content,), **kinds)
