"""What a caller asks for: types, user patterns, blocked words; checked on the driver before a plan is built."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import regex

#: Types with their labels, and their rank where all else ties.
TYPES = {
    "PERSON": "Names / people",
    "ORGANIZATION": "Organizations",
    "EMAIL": "Email addresses",
    "PHONE": "Phone numbers",
    "CREDIT_CARD": "Credit card numbers",
    "SSN": "Social Insurance Numbers",
    "GOVERNMENT_ID": "Government IDs",
    "BANK_ACCOUNT": "Bank / account numbers",
    "ADDRESS": "Addresses",
    "DATE_OF_BIRTH": "Dates of birth",
    "IP_ADDRESS": "IP addresses",
    "URL": "URLs",
    "CUSTOM": "Custom patterns",
}
PRIORITY = {
    "CUSTOM": 100,
    "CREDIT_CARD": 90,
    "SSN": 85,
    "GOVERNMENT_ID": 80,
    "BANK_ACCOUNT": 75,
    "EMAIL": 70,
    "PHONE": 65,
    "URL": 60,
    "IP_ADDRESS": 55,
    "DATE_OF_BIRTH": 40,
    "ADDRESS": 35,
    "PERSON": 30,
    "ORGANIZATION": 25,
}
#: Limits, default types and the default tag of blocked words.
MAX_TEXT, MAX_PATTERN, MAX_PATTERNS, MAX_NAME = 5_000_000, 200, 20, 32
DEFAULT_TYPES = ("PERSON", "ORGANIZATION", "PHONE", "EMAIL", "CREDIT_CARD", "SSN", "BANK_ACCOUNT", "ADDRESS")
DEFAULT_TAG = "REDACTED"
#: Escapes that ECMAScript's unicode mode knows.
KNOWN_ESCAPE = re.compile(r"[\^$\\.*+?()\[\]{}|/dDwWsSbBfnrtv0-]|x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f]{1,6}\}|u[0-9A-Fa-f]{4}|[pP]\{[A-Za-z_=]+\}|c[A-Za-z]")


#: The patterns of groups that may run away, a repeated one that repeats or alternates within.
REPEATED_REPEAT = re.compile(r"\((?:\?:)?[^()]*[*+][^()]*\)\s*[*+{]")
REPEATED_CHOICE = re.compile(r"\((?:\?:)?[^()]*\|[^()]*\)\s*[*+{]")


class InvalidInput(ValueError):
    """A request that can't be met; its message says why and holds no document text."""


def check_pattern(source: str) -> None:
    """Raises InvalidInput for a user pattern that is too long, may run away, or isn't valid in unicode mode."""
    if not 1 <= len(source) <= MAX_PATTERN:
        raise InvalidInput(f"A pattern has 1 to {MAX_PATTERN} characters.")
    if REPEATED_REPEAT.search(source) or REPEATED_CHOICE.search(source):
        raise InvalidInput("A repeated group must not repeat or alternate within.")
    if re.search(r"\\[1-9]", source) or "(?<" in source:
        raise InvalidInput("Back-references, lookbehind and named groups are not supported.")
    inside = False
    at = 0
    while at < len(source):
        c = source[at]
        if c == "\\":
            m = KNOWN_ESCAPE.match(source, at + 1)
            if not m or (m[0] == "-" and not inside):
                raise InvalidInput("The pattern has an unknown escape.")
            at = m.end()
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "]" or c == "}" or c == "{" and not re.compile(r"\{\d+(?:,\d*)?\}").match(source, at):
            raise InvalidInput("The pattern has a lone bracket.")
        elif c == "{":
            at = source.index("}", at)
        at += 1
    try:
        regex.compile(re.sub(r"\\u\{([0-9A-Fa-f]+)\}", lambda m: rf"\U{int(m[1], 16):08x}", source))
    except (regex.error, ValueError) as e:
        raise InvalidInput("The pattern is not a valid regular expression.") from e


@dataclass(frozen=True)
class CustomPattern:
    """A named user pattern; all hits of one name share a placeholder label."""

    name: str
    pattern: str
    ignore_case: bool = False

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Z][A-Z0-9_]*", self.name) or len(self.name) > MAX_NAME:
            raise InvalidInput("A pattern's name is upper-case letters, digits and underscores.")
        check_pattern(self.pattern)


@dataclass(frozen=True)
class AnalyzeOptions:
    """Types to look for, user patterns, and the region of national telephone numbers."""

    enabled_types: tuple[str, ...] = DEFAULT_TYPES
    custom_patterns: tuple[CustomPattern, ...] = ()
    default_region: str | None = None
    #: Given names for the lexicon detector; empty leaves that detector out.
    given_names: tuple[str, ...] | None = field(default=None)

    def __post_init__(self) -> None:
        if not self.enabled_types or (unknown := set(self.enabled_types) - set(TYPES)):
            raise InvalidInput(f"Unknown or no types: {', '.join(sorted(unknown)) if self.enabled_types else 'none'}.")
        if len(self.custom_patterns) > MAX_PATTERNS:
            raise InvalidInput(f"At most {MAX_PATTERNS} patterns.")


@dataclass(frozen=True)
class BlockedWord:
    word: str
    ignore_case: bool = True


def word_pattern(word: str) -> str:
    """A word or phrase as a bounded pattern; spaces match any white space."""
    parts = word.split()
    if not parts:
        raise InvalidInput("A blocked word must not be empty.")
    return rf"\b{r'\s+'.join(re.sub(r'[.*+?^${}()|\[\]\\]', r'\\\g<0>', p) for p in parts)}\b"


def redaction_tag(raw: str) -> str:
    """A tag as a placeholder label."""
    tag = re.sub("_+", "_", re.sub("[^A-Z0-9]+", "_", raw.strip().upper()).strip("_"))
    if not tag:
        return DEFAULT_TAG
    return (tag if tag[0].isalpha() else f"TAG_{tag}")[:MAX_NAME]


def blocked_patterns(words: list[BlockedWord], tag: str = DEFAULT_TAG) -> tuple[CustomPattern, ...]:
    return tuple(CustomPattern(redaction_tag(tag), word_pattern(w.word), w.ignore_case) for w in words)


def analyze_options(enabled_types: tuple[str, ...] = DEFAULT_TYPES, blocked: list[BlockedWord] | None = None, tag: str = DEFAULT_TAG) -> AnalyzeOptions:
    """Options with blocked words as custom patterns, whose type is then on."""
    patterns = blocked_patterns(blocked or [], tag)
    types = tuple(enabled_types) + (("CUSTOM",) if patterns and "CUSTOM" not in enabled_types else ())
    return AnalyzeOptions(types, patterns)
