"""Patterns with ECMAScript meaning for the JVM's regex engine.

In ECMAScript, ``\\b`` and ``\\w`` know ASCII only and ``\\s`` knows all Unicode white space; in the
JVM it is the other way round. Patterns here are put together from these fragments.
"""

from __future__ import annotations

import re

#: Members of ECMAScript's white-space class, for use inside brackets.
WS_MEMBERS = r"\t\n\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{WS_MEMBERS}]"
NOT_WS = f"[^{WS_MEMBERS}]"
WORD = "[A-Za-z0-9_]"
#: The ASCII word boundary, and its negation.
WB = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
NOT_WB = f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"

ESCAPES = {"b": WB, "B": NOT_WB, "s": WS, "S": NOT_WS, "v": r"\x{000B}", "/": "/", "-": r"\-"}


def to_java(source: str) -> str:
    """A checked ECMAScript pattern (unicode mode) as one for the JVM that matches alike."""
    out, i, inside = [], 0, False
    while i < len(source):
        c = source[i]
        if c == "\\":
            n = source[i + 1]
            if n == "u" and (m := re.match(r"u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})", source[i + 1 :])):
                out.append(rf"\x{{{m[1] or m[2]}}}")
                i += 1 + m.end()
                continue
            if inside and n in "sS":
                out.append(WS_MEMBERS if n == "s" else NOT_WS)
            elif inside and n == "b":
                out.append(r"\x08")
            else:
                out.append(ESCAPES.get(n, "\\" + n))
            i += 2
            continue
        if inside:
            inside = c != "]"
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            inside = True
            out.append(c)
            if source.startswith("^", i + 1):
                out.append("^")
                i += 1
        else:
            out.append({"$": r"\z", ".": r"[^\n\r\x{2028}\x{2029}]"}.get(c, c))
        i += 1
    return "".join(out)
