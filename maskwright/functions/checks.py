"""Checksums and number ranges as column expressions over strings of ASCII digits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Card networks in the order in which they are tried. Lengths, and prefixes or ranges of prefixes.
CARD_NETWORKS = (
    ("Visa", (13, 16, 19), ("4",)),
    ("Mastercard", (16,), (("51", "55"), ("2221", "2720"))),
    ("American Express", (15,), ("34", "37")),
    ("Discover", (16, 19), ("6011", "65", ("622126", "622925"))),
    ("JCB", (16, 17, 18, 19), (("3528", "3589"),)),
    ("Diners Club", (14, 16, 19), (("300", "305"), "36", "38", "39")),
    ("UnionPay", (16, 17, 18, 19), ("62",)),
)
#: Weights of the digits of a bank routing number.
ROUTING_WEIGHTS = (3, 7, 1, 3, 7, 1, 3, 7, 1)


def digits(value: Column) -> Column:
    """The ASCII digits of a value."""
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(value: Column, least: int = 12, most: int = 19) -> Column:
    """Whether a value is digits only, of a length within bounds, with a right mod-10 checksum."""
    return value.rlike(r"\A[0-9]+\z") & F.length(value).between(least, most) & F.call_function("luhn_check", value)


def implausible(value: Column) -> Column:
    """All digits alike, or each one more than the one before."""
    alike = value == F.repeat(F.left(value, F.lit(1)), F.length(value))
    return alike | F.lit("0123456789").contains(value)


def card_network(value: Column) -> Column:
    """The network's name by prefix and length, or null."""

    def starts(rule: str | tuple[str, str]) -> Column:
        if isinstance(rule, str):
            return value.startswith(rule)
        return F.left(value, F.lit(len(rule[0]))).between(*rule)

    tests = [F.length(value).isin(*lengths) & reduce(lambda a, b: a | b, map(starts, rules)) for _, lengths, rules in CARD_NETWORKS]
    return F.coalesce(*(F.when(t, F.lit(name)) for t, (name, _, _) in zip(tests, CARD_NETWORKS, strict=True)))


def canadian_sin(value: Column) -> Column:
    return (F.length(value) == 9) & luhn(value, 9, 9) & (value != "000000000")


def us_ssn(value: Column) -> Column:
    """Nine digits whose area, group and serial can be issued."""
    return value.rlike(r"\A(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}\z")


def aba_routing(value: Column) -> Column:
    """Nine digits with a right weighted checksum, not all zero."""
    terms = [F.substring(value, i + 1, 1).try_cast("int") * w for i, w in enumerate(ROUTING_WEIGHTS)]
    return F.coalesce(value.rlike(r"\A[0-9]{9}\z") & (reduce(lambda a, b: a + b, terms) % 10 == 0) & (value != "000000000"), F.lit(False))
