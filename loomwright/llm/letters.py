"""Splitting texts by a tokenizer's pattern with the letter classes of the tokenizer's own library.

Libraries carry Unicode tables of different versions, so a pattern's letters, numbers and blanks
aren't the same characters everywhere. Code points on which versions can differ (those that
Python's tables don't assign, and those that ``regex`` classes otherwise than they do) are asked of
the library one by one when a text has them, and stand-ins of the class that it gives take
their places while the text is split.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache

import regex

#: A character of each class whose class no version changes.
STAND_INS = {"letter": "\u01bb", "number": "\u0663", "blank": "\u2003", "other": "\u00a4"}


#: Finds characters outside of blocks that hold none of those code points.
UNUSUAL = re.compile("[^\x00-\u0377\u0400-\u052f\u2010-\u2027\u2030-\u205e\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fff\uac00-\ud7a3]")


@lru_cache(1)
def doubtful_ranges() -> tuple[list[int], list[int]]:
    """First and last code points of the ranges on whose class Unicode versions differ."""
    first: list[int] = []
    last: list[int] = []
    for begin in range(0, sys.maxunicode + 1, 4096):  # a block at a time keeps workers small
        block = [c for c in range(begin, begin + 4096) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, block))
        letters, numbers = set(regex.findall(r"\p{L}", text)), set(regex.findall(r"\p{N}", text))
        for c, x in zip(block, text):
            kind = unicodedata.category(x)
            if kind == "Cn" or (kind[0] == "L") != (x in letters) or (kind[0] == "N") != (x in numbers):
                if last and last[-1] == c - 1:
                    last[-1] = c
                else:
                    first.append(c)
                    last.append(c)
    return first, last


_FINE: set[str] = set()


def doubtful(text: str) -> set[str]:
    """The characters of a text on whose class Unicode versions differ."""
    try:
        text.encode("latin-1")  # at once, where a text has nothing else
        return set()
    except UnicodeEncodeError:
        if UNUSUAL.search(text) is None:
            return set()
    found = set()
    for c in set(text) - _FINE:
        first, last = doubtful_ranges()
        k = bisect_right(first, ord(c)) - 1
        if k >= 0 and ord(c) <= last[k]:
            found.add(c)
        else:
            _FINE.add(c)
    return found


class Splitter:
    """``findall`` of a pattern over texts; ``kind_of`` tells the class (a key of ``STAND_INS``) of a doubtful character."""

    def __init__(self, pattern: str, kind_of: Callable[[str], str]):
        compiled = regex.compile(pattern)
        self.find, self.finditer = compiled.findall, compiled.finditer
        self.kind_of = kind_of
        self.known: dict[str, str] = {}

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not (odd := doubtful(text)):
            return self.find(text)
        for c in odd.difference(self.known):
            self.known[c] = STAND_INS[self.kind_of(c)]
        return [text[m.start() : m.end()] for m in self.finditer(text.translate({ord(c): self.known[c] for c in odd}))]


def kinds_of_tiktoken(pattern: str) -> Callable[[str], str]:
    """The classes of the ``tiktoken`` library, seen by which neighbours its splitting leaves a character with."""

    def kind_of(c: str) -> str:
        import tiktoken

        probes = {"letter": "a" + c, "number": "1" + c, "blank": "\t" + c}
        ranks = {bytes([b]): b for b in range(256)} | {p.encode(): 256 + k for k, p in enumerate(probes.values())}
        one = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return next((kind for kind, p in probes.items() if len(one.encode_ordinary(p)) == 1), "other")

    return kind_of
