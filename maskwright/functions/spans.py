"""Matches with their offsets, from built-in expressions.

Spark gives all matches of a pattern or the pieces between them, but no positions. A match begins
after all pieces and matches before it, so its start is a running sum, taken in two levels (within
runs of ``RUN`` matches, and over runs) so that texts with very many matches stay cheap. Offsets
count code points from 0; ends are exclusive.

The expression is written as SQL text, which the driver parses at once: a plan has dozens of them, and
made of column objects each would take hundreds of calls to the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = 64


def bound(value: str, name: str, body: str) -> str:
    """``body`` with a name for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


#: Characters that the matches ``{0}`` and the pieces before them take.
TOTAL = "aggregate({0}, 0, (_a, _x) -> _a + _x.gap + _x.size)"
#: A run of matches with offsets, beginning at ``_base``.
PLACED = f"transform(_run, (_y, _j) -> {bound(f'_base + {TOTAL.format("slice(_run, 1, _j)")} + _y.gap', '_s', 'struct(_s AS start, _s + _y.size AS `end`, _y.value AS value)')})"
#: All matches with offsets, run by run.
BY_RUNS = bound(
    f"transform(sequence(0, CAST(floor((size(_pairs) - 1) / {RUN}) AS INT)), _r -> slice(_pairs, _r * {RUN} + 1, {RUN}))",
    "_runs",
    bound(f"transform(_runs, _q -> {TOTAL.format('_q')})", "_sizes", f"flatten(transform(_runs, (_run, _i) -> {bound('aggregate(slice(_sizes, 1, _i), 0, (_a, _x) -> _a + _x)', '_base', PLACED)}))"),
)
PAIRS = "zip_with(slice(split(_in.text, _in.pattern, -1), 1, size(_found)), _found, (_g, _v) -> struct(length(_g) AS gap, length(_v) AS size, _v AS value))"
SPANS = f"_in -> {bound('regexp_extract_all(_in.text, _in.pattern, 0)', '_found', f'CASE WHEN size(_found) = 0 THEN CAST(array() AS ARRAY<STRUCT<start: INT, `end`: INT, value: STRING>>) WHEN size(_found) > 0 THEN {bound(PAIRS, "_pairs", BY_RUNS)} END')}"


def spans(text: Column, pattern: Column | str) -> Column:
    """array<struct<start int, end int, value string>> of all matches, left to right.

    The pattern must not match the empty string. Null text has no array; no match gives an empty one.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.get(F.call_function("transform", F.array(F.struct(text.alias("text"), p.alias("pattern"))), F.expr(SPANS)), F.lit(0))


def part(text: Column, start: Column, end: Column) -> Column:
    """The text between two offsets."""
    return F.substring(text, start + 1, end - start)
