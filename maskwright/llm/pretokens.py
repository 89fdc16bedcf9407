"""Splitting texts into pre-tokens exactly as the Rust tokenizer libraries do, and remembering their ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import regex

from maskwright.llm.common import BoundedCache
from maskwright.llm.stretches import MOST_SLOTS, Table

#: Fixed value: the public pre-tokenisation pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens taken from a text at a time, so that a very long text needs bounded memory.
PIECES = 1 << 16
#: Distinct pre-tokens that a worker remembers in each of two generations.
REMEMBERED_PIECES = 80_000
#: Characters of texts that go through the table together, about.
RUN = 1 << 19
#: White space that may join other white space into one pre-token.
JOINING = ("  ", " \n", "\n ", "\n\n", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0")
#: Outside these long-settled blocks, Unicode versions may differ on what is a letter or number.
UNSETTLED = regex.compile(r"[^\x00-ԩ‐-‧₠-₿]")


def char_class(name: str) -> str:
    r"""Ranges of the code points that \p{name} matches in the Rust libraries' Unicode version."""
    import tiktoken

    own = tiktoken.Encoding("classes", pat_str=rf"\p{{{name}}}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    found, ranges = own.decode_bytes(own.encode_ordinary(every)).decode(), []
    for c in map(ord, found):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@cache
def settled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


@cache
def exact(pattern: str) -> regex.Pattern:
    """The pattern with the letters and numbers of the Rust libraries written out."""
    letters, numbers = char_class("L"), char_class("N")
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]")
    return regex.compile(pattern.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]"))


def pieces(text: str, pattern: str = PATTERN) -> Iterator[list[str]]:
    """The pre-tokens of a text in order, at most some at a time if it is very long."""
    split = (exact if UNSETTLED.search(text) else settled)(pattern)
    if len(text) <= PIECES * 4:
        yield split.findall(text)
    else:
        found = (m.group() for m in split.finditer(text))
        while some := list(islice(found, PIECES)):
            yield some


def plain(text: str) -> bool:
    """Whether single spaces and newlines surely begin pre-tokens: none adjoins other white space, and
    there are no characters on which Unicode versions differ."""
    return not any(x in text for x in JOINING) and not UNSETTLED.search(text)


class Memory:
    """Ids of whole texts from a function that gives those of distinct pre-tokens, as bytes.

    ``by_stretch``, where given, encodes whole stretches of text instead (see ``stretches``).
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], pattern: str = PATTERN, of_pieces: int = REMEMBERED_PIECES, by_stretch: Callable[[list[str]], list[bytes]] | None = None, slots: int = MOST_SLOTS) -> None:
        self.encode, self.pattern = encode, pattern
        self.known = BoundedCache(of_pieces)
        self.table = Table(by_stretch or self.encode_stretches, slots)

    def learn(self, lists: list[list[str]]) -> None:
        """Makes the pre-tokens of ``lists`` known."""
        absent = self.known.missing(chain.from_iterable(lists))
        for at in range(0, len(absent), PIECES):
            some = absent[at : at + PIECES]
            self.known.update(zip(some, self.encode(some), strict=True))

    def join(self, some: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, some))

    def encode_stretches(self, some: list[str]) -> list[bytes]:
        """The ids of stretches by their pre-tokens."""
        found = list(map(settled(self.pattern).findall, some))
        self.learn(found)
        return list(map(self.join, found))

    def runs(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, some at a time."""
        for some in pieces(text, self.pattern):
            self.learn([some])
            yield np.frombuffer(self.join(some), dtype="<u4")

    def all_runs(self, whole: list[str]) -> Iterator[Iterator[np.ndarray]]:
        """``runs`` of each text; those that are plain and not very long go through the table together."""
        ready: dict[int, np.ndarray] = {}
        some: list[int] = []
        size = 0
        fit = [len(t) <= PIECES * 4 and plain(t) for t in whole]
        for i, text in enumerate(whole):
            if not ready and not some:
                # the next run of plain texts, about RUN bytes of them
                for j in range(i, len(whole)):
                    if fit[j]:
                        some.append(j)
                        size += len(whole[j])
                        if size >= RUN:
                            break
                ready = dict(zip(some, self.table.ids([whole[j].encode() for j in some]), strict=True))
                some, size = [], 0
            yield iter((ready.pop(i),)) if fit[i] else self.runs(text)
