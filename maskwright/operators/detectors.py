"""Detectors: from a text column to an array of detections, in built-in expressions.

Each finds leftmost matches that don't overlap. A detector whose matches need a character that most
texts lack looks for that first, so that a text without it costs one scan.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import checks
from maskwright.functions.jsregex import WB, WS, WS_MEMBERS, to_java
from maskwright.functions.let import let
from maskwright.functions.spans import part, spans
from maskwright.operators.detection import detections, none, shortened
from maskwright.plans.options import CustomPattern

EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
URL = rf"https?://[^{WS_MEMBERS}\x1f<>\x22'\x60]{{1,2000}}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9.])"
IPV6 = r"(?<![:A-Za-z0-9_])(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}(?![:A-Za-z0-9_])"
CARD = r"[0-9](?:[ -]?[0-9]){11,21}"
SIN = r"(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{3}(?![0-9-])"
US_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
MASKED_SIN = r"\*{3}-\*{3}-[0-9]{3}(?![0-9-])"
MASKED_SSN = r"\*{3}-\*{2}-[0-9]{4}(?![0-9-])"
NINE = r"(?<![0-9-])[0-9]{9}(?![0-9-])"
#: Wording that must stand so many characters before nine bare digits.
SSN_WORDS, SSN_REACH = rf"(?iu){WB}(?:sin|s\.i\.n\.|ssn|s\.s\.n\.|social{WS}+insurance(?:{WS}+number)?|social{WS}+security(?:{WS}+number)?){WB}", 40
ROUTING_WORDS, ROUTING_REACH = rf"(?iu){WB}(?:routing|transit|aba|rtn){WB}", 48
ACCOUNT = rf"(?iu)(?:account number|acct\.?){WS}+[0-9]{{6,17}}(?![0-9-])"
NAME_PART = r"[A-Z][\p{L}.'-]*"
ADDRESS = rf"{WB}[0-9]{{1,6}}{WS}+{NAME_PART}(?:{WS}+{NAME_PART}){{0,5}}(?:,{WS}*(?:Suite|Ste\.?|Apt\.?|Unit){WS}+[A-Za-z0-9_-]+)?,{WS}*{NAME_PART}(?:{WS}+{NAME_PART})*,{WS}*[A-Z]{{2}}{WS}+[0-9]{{5}}(?:-[0-9]{{4}})?{WB}"
GAP = rf"[{WS_MEMBERS}.-]"
NANP = rf"(?<![0-9(])(?:\+?1{GAP}*)?(?:\([0-9]{{3}}\){GAP}*|[0-9]{{3}}{GAP}+)[0-9]{{3}}{GAP}+[0-9]{{4}}(?![0-9])"
VANITY = rf"{WB}1{GAP}?8[0-9]{{2}}{GAP}[0-9]{{3}}{GAP}[A-Z]{{4}}{WB}"
#: In place of a telephone library: international numbers, and national ones of the regions of the +1 plan.
INTERNATIONAL = rf"(?<![0-9A-Za-z+])\+[1-9](?:[ ().-]{{0,2}}[0-9]){{7,14}}(?![0-9])"
NATIONAL = r"(?<![0-9+(])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-]?)[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9])"


def email(text: Column) -> Column:
    """Addresses whose last label could be a top-level domain, without a final dot or hyphen."""
    found = shortened(spans(text, EMAIL), lambda v: F.regexp_replace(v, r"[.-]+\z", ""))
    kept = F.filter(found, lambda x: x["value"].rlike(r"\.[A-Za-z]{2,24}\z"))
    return F.when(text.contains("@"), detections(kept, "EMAIL", 0.95, "email")).otherwise(none())


def url(text: Column) -> Column:
    """http and https addresses without the punctuation of the sentence."""
    found = shortened(spans(text, URL), lambda v: F.regexp_replace(v, r"[.,;:!?)\]}>\x22']+\z", ""))
    return F.when(text.contains("://"), detections(found, "URL", 0.9, "url")).otherwise(none())


def ip_address(text: Column) -> Column:
    """Dotted quads in range, and full IPv6 addresses."""

    def kind(pattern: str, confidence: float, version: str) -> Column:
        return detections(spans(text, pattern), "IP_ADDRESS", confidence, "ip-address", lambda x: F.create_map(F.lit("version"), F.lit(version)))

    four, six = text.rlike(r"[0-9]\.[0-9]{1,3}\."), text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")
    return F.concat(F.when(four, kind(IPV4, 0.85, "4")).otherwise(none()), F.when(six, kind(IPV6, 0.9, "6")).otherwise(none()))


def card_windows(candidate: Column) -> Column:
    """Readings of a run of digits: the whole, and of more than 19 digits each 16 in a row."""
    whole = F.struct(F.lit(0).alias("offset"), candidate.alias("value"))
    later = [
        F.struct(F.length(F.regexp_extract(candidate, rf"\A((?:[0-9][ -]?){{{i}}})", 1)).alias("offset"), F.regexp_extract(candidate, rf"\A(?:[0-9][ -]?){{{i}}}([0-9](?:[ -]?[0-9]){{15}})", 1).alias("value"))
        for i in range(7)
    ]
    return F.when(F.length(checks.digits(candidate)) <= 19, F.array(whole)).otherwise(F.filter(F.array(*later), lambda w: w["value"] != ""))


def credit_card(text: Column) -> Column:
    """The first reading of each run of digits that has a right checksum, or is grouped and of a known network."""

    def judged(w: Column) -> Column:
        record = lambda plain: F.struct(w["offset"].alias("offset"), w["value"].alias("value"), plain.alias("digits"), checks.card_network(plain).alias("brand"), checks.luhn(plain).alias("luhn"))
        return let(checks.digits(w["value"]), record)

    def sound(w: Column) -> Column:
        grouped = w["value"].rlike("[ -]")
        return F.length(w["digits"]).between(13, 19) & ~checks.implausible(w["digits"]) & (w["luhn"] | (grouped & w["brand"].isNotNull()))

    def first(x: Column) -> Column:
        good = F.slice(F.filter(F.transform(card_windows(x["value"]), judged), sound), 1, 1)
        return F.transform(
            good,
            lambda w: F.struct((x["start"] + w["offset"]).alias("start"), (x["start"] + w["offset"] + F.length(w["value"])).alias("end"), w["value"].alias("value"), w["digits"].alias("digits"), w["brand"].alias("brand"), w["luhn"].alias("luhn")),
        )

    def about(x: Column) -> Column:
        last4 = F.right(x["digits"], F.lit(4))
        return F.when(x["brand"].isNull(), F.create_map(F.lit("last4"), last4)).otherwise(F.create_map(F.lit("cardBrand"), x["brand"], F.lit("last4"), last4))

    found = F.flatten(F.transform(spans(text, CARD), first))
    sure = lambda x: F.when(~x["luhn"], 0.86).when(x["brand"].isNull(), 0.75).otherwise(0.98)
    return F.when(text.rlike("[0-9][0-9 -]{11}"), detections(found, "CREDIT_CARD", sure, "credit-card", about)).otherwise(none())


def before(text: Column, start: Column, reach: int) -> Column:
    """Up to so many characters before a place."""
    return part(text, F.greatest(start - reach, F.lit(0)), start)


def social_number(text: Column) -> Column:
    """Canadian and US social numbers: grouped, masked, or nine bare digits after their name."""

    def kind(pattern: str, confidence, keep=None) -> Column:
        found = spans(text, pattern)
        return detections(F.filter(found, keep) if keep else found, "SSN", confidence, "sin-ca")

    grouped = F.concat(
        kind(SIN, 0.95, lambda x: checks.canadian_sin(checks.digits(x["value"]))),
        kind(US_SSN, 0.9, lambda x: checks.us_ssn(checks.digits(x["value"]))),
    )
    masked = F.when(text.contains("***-"), F.concat(kind(MASKED_SIN, 0.85), kind(MASKED_SSN, 0.85))).otherwise(none())
    sure = lambda x: F.when(checks.canadian_sin(x["value"]), 0.8).otherwise(0.7)
    bare = kind(NINE, sure, lambda x: (checks.canadian_sin(x["value"]) | checks.us_ssn(x["value"])) & before(text, x["start"], SSN_REACH).rlike(SSN_WORDS))
    return F.concat(F.when(text.rlike("[0-9]{3}-[0-9]{2,3}-[0-9]{3}"), grouped).otherwise(none()), masked, F.when(text.rlike("[0-9]{9}"), bare).otherwise(none()))


def bank_account(text: Column) -> Column:
    """Routing numbers near their name, and account numbers after theirs."""
    routing = F.filter(spans(text, NINE), lambda x: checks.aba_routing(x["value"]) & before(text, x["start"], ROUTING_REACH).rlike(ROUTING_WORDS))

    def number(x: Column) -> Column:
        value = F.regexp_extract(x["value"], r"([0-9]+)\z", 1)
        return F.struct((x["end"] - F.length(value)).alias("start"), x["end"].alias("end"), value.alias("value"))

    account = F.transform(spans(text, ACCOUNT), number)
    both = F.concat(detections(routing, "BANK_ACCOUNT", 0.9, "bank-account"), detections(account, "BANK_ACCOUNT", 0.85, "bank-account"))
    return F.when(text.rlike("[0-9]{6}"), both).otherwise(none())


def address(text: Column) -> Column:
    """US street addresses with city, state and ZIP code."""
    return F.when(text.rlike("[0-9]{5}"), detections(spans(text, ADDRESS), "ADDRESS", 0.7, "address")).otherwise(none())


def apart(found: Column, others: Column) -> Column:
    """Those that overlap none of the others."""
    return F.filter(found, lambda x: ~F.exists(others, lambda o: (o["start"] < x["end"]) & (x["start"] < o["end"])))


def phone(text: Column, region: str | None = None) -> Column:
    """Telephone numbers: by numbering plan, then formatted ten-digit ones, then toll-free words.

    No telephone library is at hand: international numbers of 8 to 15 digits count, those of the +1
    plan as surely valid if area and exchange can exist; with region US or CA, so do national ones.
    """

    def valid(x: Column) -> Column:
        return checks.digits(x["value"]).rlike(r"\A1[2-9][0-9]{2}[2-9][0-9]{6}\z")

    where = region if region in ("US", "CA") else None
    known = detections(spans(text, INTERNATIONAL), "PHONE", lambda x: F.when(valid(x), 0.95).otherwise(0.7), "phone", lambda x: F.create_map(F.lit("region"), F.when(valid(x), F.lit(where or "US")).otherwise("unknown")))
    later = [detections(spans(text, NATIONAL), "PHONE", 0.95, "phone", lambda x: F.create_map(F.lit("region"), F.lit(where)))] if where else []
    later += [detections(spans(text, p), "PHONE", 0.8, "phone") for p in (NANP, VANITY)]
    for found in later:
        known = with_apart(known, found)
    return F.when(text.rlike("[0-9]{3}"), known).otherwise(none())


def with_apart(known: Column, found: Column) -> Column:
    """Known detections, and the found ones that overlap none of them."""
    return let(known, lambda earlier: F.concat(earlier, apart(found, earlier)))


def custom(text: Column, patterns: tuple[CustomPattern, ...]) -> Column:
    """User patterns in the order given. Empty matches don't count."""

    def one(p: CustomPattern) -> Column:
        java = ("(?iu)" if p.ignore_case else "") + to_java(p.pattern)
        found = _with_empty(text, p) if regex.match(p.pattern, "", regex.IGNORECASE if p.ignore_case else 0) else spans(text, java)
        return detections(found, "CUSTOM", 1.0, "custom-regex", lambda x: F.create_map(F.lit("patternName"), F.lit(p.name)))

    return F.concat(*map(one, patterns)) if patterns else none()


def _with_empty(text: Column, pattern: CustomPattern) -> Column:
    """A pattern that can match nothing has no pieces between matches, so Python finds its spans."""
    compiled = regex.compile(pattern.pattern, regex.ASCII | (regex.IGNORECASE if pattern.ignore_case else 0))

    @F.pandas_udf("array<struct<start:int,end:int,value:string>>")
    def find(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [] if v is None else [{"start": m.start(), "end": m.end(), "value": m.group()} for m in compiled.finditer(v) if m.group()])

    return find(text)


def never(text: Column) -> Column:
    """A type that is named but not looked for yet."""
    return none()


