"""Personal and organisation names: capitalised sequences, lexicon hits, and how far a name reaches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from unicodedata import category

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.jsregex import WB, WS
from maskwright.functions.let import let
from maskwright.functions.spans import spans
from maskwright.operators.detection import detections

#: Words that end a personal name when they come next.
NAME_ENDS = """
Systems System Architect Architecture Assigned Department Regional Office Data Governance Security Operations Client
Relations Research Development Software Engineer Engineering Developer Quality Assurance Manager Management Director
Coordinator Specialist Analyst Officer Consultant Administrator Technician Supervisor Lead Senior Junior Principal
Montreal Geneva Document Section Executive Overview Introduction Historical Context Technical Constraints Parser
Behavior Testing Complex Interleaved Prose Edge Cases Concluding Segment Target Entity Recognition Dense Flow
Application Parsing Extraction Diagnostic Report Page Name Text Test Press MIT For The This During Furthermore
Similarly Modern Automated Project Departmental Bank Holdings Company Corporation Corp Inc LLC Ltd Group Avenue Street
Road Drive Boulevard Way Lane Server Cluster Node Portal Infrastructure Network Database signed called demonstrate
noted consider hosted managed verified confirmed collaborate isolate accurately Pay
""".split()
#: Words of headings and labels.
HEADINGS = """
Access Account Accounts Address Administrator Associated Benchmark Billing Card Cardholder Chase Classifications
Client Cluster Comprehensive Confidential Contact Contacts Corporate Credentials Credit Customer Database Direct
Email Emergency Escalation Evaluation Evergreen Financial Holdings Hotline Identifiable Incident Information
Infrastructure Interaction Internal Ledger Line Link Links Locations Logs Manhattan Matching Narrative Network New
Node Number Operating Park Pattern Payment Personnel Personally Phone Physical Portal Primary Purpose Records Reserve
Secure Server Settlement Silicon Suite Support Target Terrace Transaction Trust Validation Vector Vectors Vendor Web
York
""".split()
#: Name particles and company words, as patterns.
PARTICLE = r"(?:Ibn|Von|van|de|del|Van|Der|Di|Da|Mc|Mac|O'|Al-|Saint|St\.?)"
COMPANY = "Bank Inc Corp Corporation LLC Ltd University Laboratories Holdings".split()
NAME_WORD = r"\A\p{Lu}[\p{L}-]+(?:'[\p{L}-]+)?\z"
#: The boundary before the first letter is asked for after it, where few places are left.
CAPITAL = r"(?:[A-Z](?<![A-Za-z0-9_].)|[\p{Lu}&&[^A-Z]](?<=[A-Za-z0-9_].))"
SEQUENCE = rf"(?s){CAPITAL}[\p{{L}}-]+(?:{WS}+(?:{PARTICLE}{WS}+)?\p{{Lu}}[\p{{L}}-]+){{1,5}}{WB}"
#: Given names and titles from which a person is read where no language model is at hand. Ours, and replaceable.
GIVEN_NAMES = """
Ada Adam Ahmed Alan Alice Amelia Ana Andrew Anna Anne Anthony Antoine Barbara Benjamin Brigitte Carlos Catherine Charles
Charlotte Christine Claire Daniel David Diana Eleanor Elena Elizabeth Emily Emma Eric Fatima Francois Frank George Grace
Hannah Hans Helen Henry Isabelle Jack James Jane Jean Jennifer John Jose Joseph Julia Karen Karl Kevin Laura Linda Lisa
Louis Lucas Marcus Margaret Maria Marie Mark Martin Mary Matthew Michael Michelle Mohamed Nancy Nicole Olivia Omar Patricia
Paul Peter Philip Pierre Priya Rachel Richard Robert Sandra Sarah Simon Sofia Sophie Stephen Steven Susan Tariq Thomas
Victor Victoria William Yuki
""".split()


def one_of(word: Column, words: list[str]) -> Column:
    return word.isin(*words)


def heading_word(word: Column) -> Column:
    """A heading or ending word, or all capitals."""
    capitals = (F.length(word) > 1) & (word == F.upper(word)) & (word != F.lower(word))
    return one_of(word, HEADINGS) | one_of(word, NAME_ENDS) | capitals


def heading_phrase(value: Column) -> Column:
    """Whether no word of the value could be part of a name."""
    words = F.filter(F.split(value, r"[^\p{L}\p{N}'-]+", -1), lambda w: w != "")
    return F.forall(words, lambda w: heading_word(w) | w.rlike(rf"\A{PARTICLE}\z"))


def without_possessive(value: Column) -> Column:
    return F.regexp_replace(value, r"['’]s\z", "")


def sequence_values(text: Column) -> Column:
    """Distinct values of capitalised sequences that read as names, in order of appearance."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(SEQUENCE), F.lit(0)), without_possessive)

    def marks(w: Column) -> Column:
        return F.struct(w.alias("w"), (~heading_word(w)).alias("free"), w.rlike(NAME_WORD).alias("name"), w.rlike(rf"\A{PARTICLE}\z").alias("particle"))

    def from_first(marked: Column) -> Column:
        first = F.array_position(F.transform(marked, lambda m: m["free"] & m["name"]), True).cast("int")
        return let(first, lambda k: F.when(k > 0, F.slice(marked, k, F.size(marked))))

    def to_stop(marked: Column) -> Column:
        stop = F.array_position(F.transform(marked, lambda m: ~m["free"] | ~(m["particle"] | m["name"])), True).cast("int")
        return let(stop, lambda k: F.when(k > 0, F.slice(marked, F.lit(1), k - 1)).otherwise(marked))

    def name(value: Column) -> Column:
        marked = F.transform(F.split(value, f"{WS}+", -1), marks)

        def sound(kept: Column) -> Column:
            joined = F.array_join(F.transform(kept, lambda m: m["w"]), " ")
            fine = lambda j: F.when((F.size(kept) >= 2) & F.exists(kept, lambda m: ~m["particle"]) & value.contains(j) & ~heading_phrase(j), j)
            return let(joined, fine)

        return let(let(let(marked, from_first), to_stop), sound)

    return F.array_distinct(F.filter(F.transform(raw, name), lambda v: v.isNotNull()))


def in_word(char: str) -> bool:
    return char == "_" or category(char)[0] in "LN"


def places(text: str, value: str) -> Iterator[tuple[int, int]]:
    """Spans of a literal that no letter, digit or underscore adjoins, also those that overlap."""
    at, size = text.find(value), len(value)
    while at >= 0:
        end = at + size
        if not (at and in_word(text[at - 1])) and not (end < len(text) and in_word(text[end])):
            yield at, end
        at = text.find(value, at + 1)


def occurrences(text: Column, value: Column) -> Column:
    """Spans of a literal that no letter, digit or underscore adjoins."""
    return spans(text, F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), value, F.lit(r"\E(?![\p{L}\p{N}_])")))


def person_sequences(text: Column) -> Column:
    found = F.flatten(F.transform(sequence_values(text), lambda v: occurrences(text, v)))
    return detections(found, "PERSON", 0.58, "person-sequence")


# Growing a name word by word is a loop over the text, so lexicon names are found in Python, by whole Arrow batches.
_ENDS, _HEADINGS = frozenset(NAME_ENDS), frozenset(HEADINGS)
_PARTICLE = regex.compile(rf"{PARTICLE}\Z")
_NEXT = regex.compile(rf"[ \t]+(?:{PARTICLE}\s+)?(\p{{Lu}}[\p{{L}}'-]+)")
_COMPANY = regex.compile(rf"(?a:\b)(?:{'|'.join(COMPANY)})(?a:\b)")
_COMPANY_NAME = regex.compile(rf"\p{{Lu}}[\p{{L}}&'-]*(?: \p{{Lu}}[\p{{L}}&'-]*){{0,3}} (?:{'|'.join(COMPANY)})\b")
_POSSESSIVE = regex.compile(r"['’]s\Z")


def _heads(word: str) -> bool:
    return word in _HEADINGS or word in _ENDS or len(word) > 1 and word == word.upper() != word.lower()


def is_heading_phrase(value: str) -> bool:
    words = [w for w in regex.split(r"[^\p{L}\p{N}'-]+", value) if w]
    return all(_heads(w) or _PARTICLE.match(w) for w in words)


def grown(text: str, start: int, end: int) -> tuple[int, int]:
    """A name's span with the particles and capitalised words that follow it."""
    while m := _NEXT.match(text, end):
        bare = _POSSESSIVE.sub("", m[1])
        if _heads(bare):
            break
        end = m.end() - (len(m[1]) - len(bare))
        if bare != m[1]:
            break
    return start, start + len(_POSSESSIVE.sub("", text[start:end]))


def clipped(value: str) -> str:
    """A name without what a line end, a parenthesis or label words add to it."""
    line = regex.split(r"[\x1f\n]", value)[0]
    paren = regex.search(r"\s*\(", line)
    words = (line[: paren.start()] if paren and paren.start() > 0 else line).split()
    while len(words) > 1 and _heads(words[-1]):
        words.pop()
    return " ".join(words)


def _trimmed(value: str) -> str:
    return _POSSESSIVE.sub("", regex.sub(r"\A[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\Z", "", value.strip()))


@cache
def _surfaces(names: tuple[str, ...]) -> regex.Pattern:
    return regex.compile(rf"(?<![\p{{L}}\p{{N}}_])(?:(?:Mr|Mrs|Ms|Dr|Prof)\.? \p{{Lu}}[\p{{L}}-]+|\L<names>)(?![\p{{L}}\p{{N}}_])", names=names)


def lexicon_hits(text: str, names: tuple[str, ...]) -> list[dict]:
    """People by given name or title, and organisations by company word, at every place they occur."""
    out: list[dict] = []
    sources = (("PERSON", 0.6, _surfaces(names).findall(text)), ("ORGANIZATION", 0.55, _COMPANY_NAME.findall(text)))
    for kind, confidence, raw in sources:
        seen: set[str] = set()
        for value in raw:
            surface = _trimmed(value)
            surface = clipped(surface) if kind == "PERSON" else surface
            if len(surface) < 3 or surface in seen or is_heading_phrase(surface):
                continue
            if kind == "ORGANIZATION" and ("&" in surface or not 2 <= len(surface.split()) <= 4):
                continue
            seen.add(surface)
            for start, end in places(text, surface):
                if kind == "PERSON":
                    start, end = grown(text, start, end)
                found = text[start:end]
                if "\x1f" in found or is_heading_phrase(found):
                    continue
                kept = "ORGANIZATION" if kind == "PERSON" and _COMPANY.search(found) else kind
                out.append({"type": kept, "start": start, "end": end, "value": found, "confidence": confidence})
    return out


def lexicon_names(text: Column, names: tuple[str, ...] = tuple(GIVEN_NAMES)) -> Column:
    """Detections of the lexicon, of both types."""

    @F.pandas_udf("array<struct<type:string,start:int,end:int,value:string,confidence:double>>")
    def find(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [] if v is None else lexicon_hits(v, names))

    none = F.lit(None).cast("map<string,string>")
    return F.transform(find(text), lambda x: F.struct(x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["confidence"].alias("confidence"), F.lit("nlp-entity").alias("detector"), none.alias("metadata")))
