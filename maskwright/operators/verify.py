"""Verification: the rewritten text is searched for every value that was to go."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.checks import digits
from maskwright.functions.jsregex import WS_MEMBERS
from maskwright.functions.let import let
from maskwright.functions.strings import collapse, js_trim

SEPARATORS = rf"[{WS_MEMBERS}.\-()_/]"
#: Shorter variants of a value are not looked for; so many digits are looked for as digits.
LEAST, DIGITS = 4, 6


def without_separators(value: Column) -> Column:
    return F.regexp_replace(value, SEPARATORS, "")


def variants(value: Column, form: Column) -> Column:
    """Ways in which a value could have survived. ``form`` is its normal form KC, trimmed."""

    def some(own: Column) -> Column:
        plain = digits(own)
        return F.array(own, F.lower(own), form, F.lower(collapse(own)), F.lower(without_separators(own)), F.when(F.length(plain) >= DIGITS, plain))

    return F.filter(F.array_distinct(let(js_trim(value), some)), lambda v: F.length(v) >= LEAST)


def haystack(form: Column) -> Column:
    """The views of a text (in normal form KC) that variants are looked for in."""
    low = F.lower(form)
    return F.struct(low.alias("lowered"), collapse(low).alias("collapsed"), without_separators(low).alias("separatorless"), digits(form).alias("digits"))


def bounded(text: Column, literal: Column) -> Column:
    """Whether a literal occurs, whatever its case, with no letter or mark at either side."""
    return text.contains(F.lower(literal)) & F.regexp_like(text, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}])\Q"), F.replace(literal, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{M}])")))


def survives(hay: Column, variant: Column, value: Column) -> Column:
    """Whether a variant of a value is in a text: digits among all digits, values with digits anywhere, words whole."""
    anywhere = hay["lowered"].contains(variant) | hay["collapsed"].contains(variant) | hay["separatorless"].contains(variant)
    whole = bounded(hay["lowered"], variant) | bounded(hay["collapsed"], variant)
    return F.when(variant.rlike(r"\A[0-9]{6,}\z"), hay["digits"].contains(variant)).when(value.rlike("[0-9]"), anywhere).otherwise(whole)


def masked(text: Column, applied: Column, skipped: Column) -> Column:
    """The text with kept values and then placeholders blanked, so that neither counts as residue."""

    def blank(some: Column, literals: Column) -> Column:
        return F.aggregate(F.array_distinct(literals), some, lambda t, v: F.when(v == "", t).otherwise(F.replace(t, v, F.lit(" "))))

    return blank(blank(text, F.transform(skipped, lambda x: x["value"])), F.transform(applied, lambda x: x["placeholder"]))


def residual(hay: Column, applied: Column, forms: Column) -> Column:
    """Placeholders, sorted, of the replaced values that are still there."""

    def left(own: Column) -> Column:
        trimmed = F.transform(applied, lambda x, i: F.struct(x["placeholder"].alias("placeholder"), x["value"].alias("value"), js_trim(F.get(own, i)).alias("form")))
        kept = F.filter(trimmed, lambda x: F.exists(variants(x["value"], x["form"]), lambda v: survives(hay, v, x["value"])))
        return F.array_sort(F.array_distinct(F.transform(kept, lambda x: x["placeholder"])))

    return let(forms, left)


def missing(text: Column, applied: Column) -> Column:
    """Placeholders, sorted, that should be in the text and aren't."""
    expected = F.array_distinct(F.transform(applied, lambda x: x["placeholder"]))
    return F.array_sort(F.filter(expected, lambda p: ~text.contains(p)))


def check(id_: str, status: Column, offending: Column) -> Column:
    return F.struct(F.lit(id_).alias("id"), status.alias("status"), offending.alias("offending"))


def checks(text: Column, hay: Column, applied: Column, forms: Column, unreadable: Column | None = None) -> Column:
    """The checks of one document: no residue, all placeholders there, nothing unread."""
    nothing = F.array().cast("array<string>")

    def judged(id_: str, offending: Column) -> Column:
        return let(offending, lambda x: check(id_, F.when(F.size(x) == 0, F.lit("pass")).otherwise(F.lit("fail")), x))

    both = F.array(judged("residual-values", residual(hay, applied, forms)), judged("placeholders-present", missing(text, applied)))
    if unreadable is None:
        return both
    unread = F.array(check("unreadable-content", F.lit("inconclusive"), nothing))
    return F.concat(both, F.when(F.coalesce(F.size(unreadable), F.lit(0)) > 0, unread).otherwise(F.slice(unread, 1, 0)))


def pdf_checks(inside: Column, hay: Column, leftovers: Column, applied: Column, forms: Column) -> Column:
    """Two more for PDF files: no residue in any object or stream, and nothing but pages left."""
    nothing = F.array().cast("array<string>")
    deep = let(residual(hay, applied, forms), lambda x: check("deep-streams", F.when(F.size(x) > 0, F.lit("fail")).otherwise(F.lit("pass")), x))
    shallow = check("structural-channels", F.when(F.size(leftovers) > 0, F.lit("fail")).otherwise(F.lit("pass")), nothing)
    return F.when(inside.isNull(), F.array(check("deep-streams", F.lit("inconclusive"), nothing))).otherwise(F.array(deep, shallow))


def visual_only() -> Column:
    """The one check of a document that was only covered up: its text is all there."""
    return F.array(check("residual-values", F.lit("fail"), F.array().cast("array<string>")))


def unreadable_output() -> Column:
    """The one check of a document that could not be read back."""
    return F.array(check("output-parses", F.lit("inconclusive"), F.array().cast("array<string>")))


def worst(statuses: Column) -> Column:
    return F.when(F.array_contains(statuses, "fail"), F.lit("fail")).when(F.array_contains(statuses, "inconclusive"), F.lit("inconclusive")).otherwise(F.lit("pass"))


def unverified_types(found: Column, applied: Column) -> Column:
    """Types that can't be vouched for: all replaced ones, unless every check passed."""
    types = F.array_distinct(F.transform(applied, lambda x: x["type"]))
    return F.when(F.exists(found, lambda c: c["status"] != "pass"), types).otherwise(F.array().cast("array<string>"))
