"""Stable pseudonyms: one placeholder for each distinct value of a document, and the rewritten text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.checks import digits
from maskwright.functions.jsregex import WS
from maskwright.functions.let import let
from maskwright.functions.spans import part
from maskwright.functions.strings import collapse, js_trim, nfkc, preview

#: Types whose values are compared by their digits, by case, and in a normal form.
BY_DIGITS = ("CREDIT_CARD", "SSN", "BANK_ACCOUNT", "GOVERNMENT_ID")
BY_CASE = ("EMAIL", "URL", "IP_ADDRESS")
BY_FORM = ("PERSON", "ORGANIZATION", "ADDRESS")


def canonical(type_: Column, value: Column, metadata: Column, normal: Callable[[Column], Column] = nfkc) -> Column:
    """What two values of a type must share to be one. ``normal`` gives a value's normal form."""
    plus = F.when(js_trim(value).startswith("+"), F.lit("+")).otherwise(F.lit(""))
    return (
        F.when(type_.isin(*BY_DIGITS), digits(value))
        .when(type_ == "PHONE", F.concat(plus, digits(value)))
        .when(type_.isin(*BY_CASE), F.lower(js_trim(value)))
        .when(type_.isin(*BY_FORM), collapse(F.lower(js_trim(normal(value)))))
        .when(type_ == "DATE_OF_BIRTH", F.regexp_replace(value, f"{WS}+", ""))
        .otherwise(F.concat(F.coalesce(metadata["patternName"], F.lit("CUSTOM")), F.lit(":"), value))
    )


def label(type_: Column, metadata: Column) -> Column:
    """The word of a placeholder."""
    name = metadata["patternName"]
    return F.when((type_ == "CUSTOM") & (name != ""), name).when(type_ == "SSN", F.lit("SIN")).otherwise(type_)


def bracketed(word: Column, number: Column) -> Column:
    """[LABEL_001]; numbers over 999 grow longer."""
    return F.format_string("[%s_%03d]", word, number)


def assign(found: Column, formatter: Callable[[Column, Column], Column] = bracketed, forms: Column | None = None) -> Column:
    """Detections with placeholder and group_id. Values are numbered by first appearance, for each label.

    ``forms`` is the array of the values' normal forms, where they are at hand already.
    """

    def keyed(x: Column, form: Column | None = None) -> Column:
        word = label(x["type"], x["metadata"])
        normal = lambda v: v if form is None else form
        return F.struct(word.alias("label"), canonical(x["type"], x["value"], x["metadata"], normal).alias("key"))

    def numbers(distinct: Column) -> Column:
        same = lambda k, i: F.size(F.filter(F.slice(distinct, F.lit(1), i + 1), lambda o: o["label"] == k["label"]))
        return F.transform(distinct, same)

    def placed(keys: Column, distinct: Column, ordinals: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            fields = ("id", "type", "start", "end", "value", "confidence", "detector", "metadata")

            def with_number(n: Column) -> Column:
                word = F.get(keys, i)["label"]
                return F.struct(*(x[f].alias(f) for f in fields), formatter(word, n).alias("placeholder"), F.format_string("%s_%03d", word, n).alias("group_id"))

            return let(F.get(ordinals, F.array_position(distinct, F.get(keys, i)).cast("int") - 1), with_number)

        return F.transform(found, one)

    def of_keys(keys: Column) -> Column:
        return let(F.array_distinct(keys), lambda distinct: let(numbers(distinct), lambda ordinals: placed(keys, distinct, ordinals)))

    if forms is None:
        return let(F.transform(found, lambda x: keyed(x)), of_keys)
    return let(forms, lambda own: let(F.transform(found, lambda x, i: keyed(x, F.get(own, i))), of_keys))


def applied(assigned: Column, excluded: Column) -> Column:
    """Detections to be replaced."""
    return F.filter(assigned, lambda x: ~F.array_contains(excluded, x["placeholder"]))


def skipped(assigned: Column, excluded: Column) -> Column:
    """Detections that the caller keeps."""
    return F.filter(assigned, lambda x: F.array_contains(excluded, x["placeholder"]))


def overlapping(assigned: Column) -> Column:
    """Whether any detection begins before the one before it has ended."""
    return F.exists(F.transform(assigned, lambda x, i: x["start"] < F.coalesce(F.get(assigned, i - 1)["end"], F.lit(0))), lambda b: b)


def rewritten(text: Column, replaced: Column) -> Column:
    """The text with placeholders for the detections, which must be in order and apart.

    What lies between two is cut out once, and all is joined at the end. Overlaps raise an error.
    """

    def piece(x: Column, i: Column) -> Column:
        since = F.coalesce(F.get(replaced, i - 1)["end"], F.lit(0))
        return F.concat(part(text, since, x["start"]), x["placeholder"])

    rest = F.substring(text, F.coalesce(F.get(replaced, F.size(replaced) - 1)["end"], F.lit(0)) + 1, F.length(text))
    whole = F.concat(F.array_join(F.transform(replaced, piece), ""), rest)
    checked = F.when(overlapping(replaced), F.raise_error(F.lit("Overlapping detections can't be replaced.")).cast("string")).otherwise(whole)
    return F.when(F.size(replaced) == 0, text).otherwise(checked)


def groups(assigned: Column) -> Column:
    """One record for each group, by first appearance: what a reviewer chooses from."""
    ids = F.array_distinct(F.transform(assigned, lambda x: x["group_id"]))

    def record(g: Column, own: Column) -> Column:
        first = F.get(own, F.lit(0))
        return F.struct(
            g.alias("group_id"),
            first["type"].alias("type"),
            first["placeholder"].alias("placeholder"),
            first["value"].alias("preview_raw"),
            preview(first["type"], first["value"], first["metadata"]).alias("preview_masked"),
            F.size(own).cast("long").alias("occurrences"),
            F.array_max(F.transform(own, lambda x: x["confidence"])).alias("confidence"),
            F.array_distinct(F.transform(own, lambda x: x["detector"])).alias("detectors"),
            first["metadata"].alias("metadata"),
        )

    return F.transform(ids, lambda g: let(F.filter(assigned, lambda x: x["group_id"] == g), lambda own: record(g, own)))
