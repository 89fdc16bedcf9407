"""String helpers: ECMAScript trimming, previews, file names, normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.checks import digits
from maskwright.functions.jsregex import WS
from maskwright.functions.let import let

BULLET = "•"
#: How a type's values are shown in a preview.
PREVIEW_POLICY = {
    "PERSON": "masked",
    "ORGANIZATION": "masked",
    "ADDRESS": "masked",
    "EMAIL": "masked",
    "URL": "masked",
    "PHONE": "suffix",
    "IP_ADDRESS": "suffix",
    "CREDIT_CARD": "suffix",
    "DATE_OF_BIRTH": "type-only",
    "SSN": "type-only",
    "GOVERNMENT_ID": "type-only",
    "BANK_ACCOUNT": "type-only",
    "CUSTOM": "type-only",
}


def js_trim(value: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(value, rf"\A{WS}+|{WS}+\z", "")


def collapse(value: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(value, rf"{WS}+", " ")


def _normal(value: Column, method: str) -> Column:
    """A Unicode normal form, from the ICU library that Spark brings along; ASCII is its own."""
    icu = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), value, F.lit(True))
    return F.when(value.isNull() | value.rlike(r"\A[\x00-\x7F]*\z"), value).otherwise(icu)


def nfkc(value: Column) -> Column:
    """Unicode normal form KC, which Spark has no function for."""
    return _normal(value, "compose")


def nfkd(value: Column) -> Column:
    """Unicode normal form KD."""
    return _normal(value, "decompose")


def mask_token(token: Column) -> Column:
    """The first character, and a bullet for each other one, four at most."""
    size = F.length(token)
    return F.when(size <= 1, token).otherwise(F.concat(F.left(token, F.lit(1)), F.repeat(F.lit(BULLET), F.least(size - 1, F.lit(4)))))


def mask_words(value: Column) -> Column:
    masked = F.array_join(F.transform(F.split(js_trim(value), rf"{WS}+", -1), mask_token), " ")
    return F.when(masked == "", F.lit(BULLET * 3)).otherwise(masked)


def mask_host(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.array_join(F.transform(labels, lambda x, i: F.when(i == F.size(labels) - 1, x).otherwise(mask_token(x))), ".")


def mask_email(value: Column) -> Column:
    local, host = F.regexp_extract(value, r"(?s)\A(.*)@", 1), F.regexp_extract(value, r"(?s)@([^@]*)\z", 1)
    return F.when(local == "", mask_words(value)).otherwise(F.concat(mask_token(local), F.lit("@"), mask_host(host)))


def mask_url(value: Column) -> Column:
    host = F.try_parse_url(value, F.lit("HOST"))
    scheme = F.lower(F.try_parse_url(value, F.lit("PROTOCOL")))
    return F.coalesce(F.concat(scheme, F.lit("://"), mask_host(F.lower(host))), mask_words(value))


def preview(type_: Column, value: Column, metadata: Column) -> Column:
    """What may be shown of a value, by the policy of its type."""
    plain = digits(value)
    policy = F.create_map(*(F.lit(x) for pair in PREVIEW_POLICY.items() for x in pair))[type_]
    dots = F.lit(BULLET * 4)
    brand = F.coalesce(metadata["cardBrand"], F.lit("Card"))
    card = F.when(F.length(plain) >= 4, F.concat_ws(" ", brand, dots, F.right(plain, F.lit(4)))).otherwise(F.concat_ws(" ", brand, dots))
    octets = F.split(value, r"\.", -1)
    ip = F.when(F.size(octets) == 4, F.concat(F.get(octets, F.lit(0)), F.lit("."), F.get(octets, F.lit(1)), F.lit(f".{BULLET * 3}.{BULLET * 3}"))).otherwise(dots)
    tail = F.when(F.length(plain) >= 2, F.concat(F.lit(f"{BULLET * 3} {BULLET * 3} {BULLET * 2}"), F.right(plain, F.lit(2)))).otherwise(dots)
    suffix = F.when(type_ == "CREDIT_CARD", card).when(type_ == "IP_ADDRESS", ip).otherwise(tail)
    masked = F.when(type_ == "EMAIL", mask_email(value)).when(type_ == "URL", mask_url(value)).otherwise(mask_words(value))
    return F.when(policy == "type-only", F.lit(f"{BULLET * 4} {BULLET * 4}")).when(policy == "suffix", suffix).otherwise(masked)


def safe_file_name(name: Column, extension: Column) -> Column:
    """A harmless name of at most 80 characters, with the extension of the format found."""
    base = F.regexp_replace(F.regexp_extract(name, r"(?s)([^/\\]*)\z", 1), r"(?s)\.[^.]*\z", "")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(let(base, nfkd), r"[^A-Za-z0-9._-]", "_"), r"\.{2,}", "."), r"\A[._-]+", "")
    clean = F.left(clean, F.lit(80))
    return let(clean, lambda c: F.concat(F.when(c == "", F.lit("document")).otherwise(c), extension))


def sanitized_file_name(safe: Column) -> Column:
    return F.concat(F.lit("sanitized-"), safe)


def encodable(text: Column, allowed: str) -> Column:
    """struct<text, substituted>: text for a font that has the characters of the class ``allowed``.

    Line ends become LF and tabs four spaces, other control and format characters go, and what the
    font lacks becomes a question mark, counted.
    """
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\t", "    "), r"[\p{Cc}\p{Cf}&&[^\n]]", "")
    odd = rf"[^\n{allowed}]"
    return F.struct(F.regexp_replace(plain, odd, "?").alias("text"), F.regexp_count(plain, F.lit(odd)).alias("substituted"))
