"""Putting values back into an answer, whole or in pieces; the result doesn't depend on how it was cut."""

from __future__ import annotations

from collections.abc import Callable

from .placeholders import BARE_OTHER, BRACKETED, mentions, undecided_from
from .unsafe import RULES, Scanner, continues_host

#: (namespace, index) to (value, whether only its exact spelling counts), or None.
Lookup = Callable[[str, int], "tuple[str, bool] | None"]
COUNTS = ("restored", *RULES, "host", "bare-space")


class Restorer:
    """``push`` pieces of one answer and ``end`` it; each returns text that may go out. All state but the lookup is plain."""

    def __init__(self, lookup: Lookup, everywhere: bool = False):
        self.lookup, self.scanner = lookup, None if everywhere else Scanner()
        self.context, self.held, self.offset = "", "", 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.regions: list[tuple[int, int]] = []

    def push(self, piece: str) -> str:
        self.held += piece
        text = self.context + self.held
        return self._release(max(0, undecided_from(text) - len(self.context)))

    def end(self) -> str:
        out = self._release(len(self.held))
        for start, end in self.regions:
            self.counts[self.scanner.at(start, end)] += 1
        self.regions = []
        return out

    def _release(self, size: int) -> str:
        text, base = self.context + self.held, len(self.context)
        stop, out, at = base + size, [], base
        for m in mentions(text):
            if m.start < base or m.end > stop:
                continue
            out.append(text[at : m.start])
            if self.scanner:
                self.scanner.feed(text[at : m.end])
            out.append(self._value(m, text) or text[m.start : m.end])
            at = m.end
        out.append(text[at:stop])
        if self.scanner:
            self.scanner.feed(text[at:stop])
        self.context, self.held = text[max(0, stop - 2) : stop], text[stop:]
        self.offset += size
        return "".join(out)

    def _value(self, m, text: str) -> str | None:
        entry = self.lookup(m.namespace, m.index)
        if entry is None or entry[1] and not m.bracketed:
            return None
        if self.scanner:
            shift = self.offset - len(self.context)
            if self.scanner.at(shift + m.start, shift + m.end):
                self.regions.append((shift + m.start, shift + m.end))
                return None
            if continues_host(text[m.end : m.end + 2], m.bracketed):
                self.counts["host"] += 1
                return None
        self.counts["restored"] += 1
        return entry[0]


def restore(text: str, lookup: Lookup, everywhere: bool = False) -> tuple[str, dict[str, int]]:
    """The answer with its values, and how many were restored or held back, by reason."""
    r = Restorer(lookup, everywhere)
    out = r.push(text) + r.end()
    brackets = [m.span() for m in BRACKETED.finditer(text)]
    for m in BARE_OTHER.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in brackets) and lookup(m[1].upper(), int(m[2])):
            r.counts["bare-space"] += 1
    return out, r.counts
