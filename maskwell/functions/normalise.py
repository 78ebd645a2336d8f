"""Text as a detector sees it: no invisible characters, NFKC by grapheme cluster, ASCII digits; with the way back.

Offsets are code points. ``Normalised.original(a, b)`` is the smallest span of the source that made text[a:b], whole clusters;
``Normalised.normalised(a, b)`` is what a span of the source became, or None if that is nothing.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right

import regex

_INVISIBLE = regex.compile(r"\p{Default_Ignorable_Code_Point}+")
_CLUSTER = regex.compile(r"\X")
_DIGIT = regex.compile(r"\p{Nd}")
#: Zeros of digit blocks newer than the Unicode tables of common runtimes.
_NEW_ZEROS = (0x10D40, 0x116D0, 0x116DA, 0x11BF0, 0x11DE0, 0x16130, 0x16D70, 0x1CCF0, 0x1E5F1)
_NEW_DIGITS = {z + i: str(i) for z in _NEW_ZEROS for i in range(10)}


#: Characters that are themselves under NFKC, no digits, and never part of a larger cluster, but for CR LF.
SIMPLE = "\\x00-\\x7f\u00a1\u00a7\u00a9\u00ab\u00ae\u00b0\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u2013\u2014\u2018-\u201e\u20ac"
_ALL_SIMPLE = regex.compile(f"[{SIMPLE}]*+")


def ascii_digits(text: str) -> str:
    """Every decimal digit of any script as its ASCII digit."""
    if text.isascii():
        return text
    return _DIGIT.sub(lambda m: str(unicodedata.decimal(m[0], m[0])), text.translate(_NEW_DIGITS))


class Normalised:
    __slots__ = ("text", "_starts", "_ends", "size")

    def __init__(self, text: str, starts: list[int] | None, ends: list[int] | None, size: int):
        self.text, self._starts, self._ends, self.size = text, starts, ends, size

    def original(self, start: int, end: int) -> tuple[int, int]:
        if not 0 <= start < end <= len(self.text):
            raise ValueError(f"no span of a text of {len(self.text)}: {start}, {end}")
        return (start, end) if self._starts is None else (self._starts[start], self._ends[end - 1])

    def normalised(self, start: int, end: int) -> tuple[int, int] | None:
        if not 0 <= start < end <= self.size:
            raise ValueError(f"no span of a text of {self.size}: {start}, {end}")
        if self._starts is None:
            return start, end
        a, b = bisect_right(self._ends, start), bisect_left(self._starts, end)
        return (a, b) if a < b else None


def normalise(source: str) -> Normalised:
    if source.isascii():  # nothing to fold; only CR LF is a cluster of two
        if "\r\n" not in source and not _INVISIBLE.search(source):
            return Normalised(source, None, None, len(source))
    elif "\r\n" not in source and _ALL_SIMPLE.fullmatch(source):
        return Normalised(source, None, None, len(source))
    hidden = [m.span() for m in _INVISIBLE.finditer(source)]
    places = list(range(len(source)))
    for a, b in reversed(hidden):
        del places[a:b]
    visible = _INVISIBLE.sub("", source) if hidden else source
    groups: list[list] = []  # [start, end, text] over ``visible``; a cluster that composes with the last one joins it
    for m in _CLUSTER.finditer(visible):
        own = m[0] if len(m[0]) == 1 and m[0].isascii() else unicodedata.normalize("NFKC", m[0])
        if groups and not m[0][0].isascii():
            both = groups[-1][2] + own
            composed = unicodedata.normalize("NFKC", both)
            if composed != both:
                groups[-1][1:] = [m.end(), composed]
                continue
        groups.append([m.start(), m.end(), own])
    text, starts, ends = [], [], []
    for a, b, own in groups:
        own = ascii_digits(own)
        text.append(own)
        starts += [places[a]] * len(own)
        ends += [places[b - 1] + 1] * len(own)
    return Normalised("".join(text), starts, ends, len(source))
