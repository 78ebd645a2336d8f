"""Where a restored value could leak: link destinations, quoted attributes, URLs and paths of bare hosts.

Four searches by regular expressions run over each piece of an answer: destinations after an opener, quoted attributes, and
addresses within tokens. What a piece leaves unfinished is kept as a short prefix or an open region, so that the result
doesn't depend on how an answer is cut. The regions of each kind are disjoint and in order, and are looked up by bisection.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import regex

#: The reasons, the stronger first.
RULES = ("markdown-destination", "reference-label", "html-attribute", "url", "unclosed-angle", "unclosed-quote")
#: White space of the web's script language, as a class of characters.
_SPACE = r"\t\n\v\f\r \xa0  -     　﻿"
_LINE_ENDS = r"\n\r  "
_BREAKS = _SPACE + "<>()\"'"

_SPACES = regex.compile(f"[{_SPACE}]*+")
_PLAIN = regex.compile(f"[^{_SPACE}]*+")
_ANGLE = regex.compile(r"[^>\n]*+")
_LINK = regex.compile(r"\]\(")
_LABELLED = regex.compile(rf"\[(?:\\[^{_LINE_ENDS}]|[^\]\\\n])++\]:")
#: What the end of a piece may still become: an unfinished label, or a closed one that waits for its colon.
_LABEL_END = regex.compile(rf"\[(?<inside>(?:\\[^{_LINE_ENDS}]|[^\]\\\n])*+)(?<escape>\\?)\Z")
_CLOSED_END = regex.compile(rf"\[(?:\\[^{_LINE_ENDS}]|[^\]\\\n])++\]\Z")
_QUOTE = regex.compile(f"=[{_SPACE}]*+([\"'])")
_EQUALS_END = regex.compile(rf"=[{_SPACE}]*+\Z")

_TOKEN = regex.compile(f"[^{_BREAKS}]++")
_RUN_END = regex.compile(r"(?<![A-Za-z0-9_+.:/-])[A-Za-z0-9_+.:/-]++\Z")
_SCHEME = regex.compile(r"(?<![A-Za-z0-9_+.-])[A-Za-z0-9_+.-]++://(?=.)", regex.S)
_FIRST_LETTER = regex.compile(r"(?<![A-Za-z0-9_])[A-Za-z](?=[A-Za-z0-9+.-]*+:)")
_MAIL = regex.compile(r"(?<![A-Za-z0-9_])mailto:(?=.)", regex.S)
_HOST = regex.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]++/")
_LABEL = regex.compile(r"[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+")
_TOP = regex.compile(r"[A-Za-z]{2,}+")


@dataclass
class Region:
    start: int
    end: int
    rule: str


def _host_start(run: str) -> int | None:
    """Where in a run of host characters before a slash its longest name of two labels or more starts."""
    labels = run.split(".")
    if len(labels) < 2 or not _TOP.fullmatch(labels[-1]):
        return None
    at, found = len(run) - len(labels[-1]), None
    for label in reversed(labels[:-1]):
        at -= len(label) + 1
        if _LABEL.fullmatch(label):
            found = at
            continue
        # the end of a label that is no label may be one, unless an underscore glues it to what is before
        own = label[len(label.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-")) :]
        glued = len(own) < len(label)
        begin = own.find("-") if glued else 0
        rest = own[begin:].lstrip("-") if begin >= 0 else ""
        if rest and _LABEL.fullmatch(rest):
            found = at + len(label) - len(rest)
        break
    return found


def _address_start(token: str) -> int | None:
    """Where in a token the first URL or host with a path starts."""
    mail = _MAIL.search(token)
    found = [mail.start()] if mail else []
    for m in _SCHEME.finditer(token):
        if letter := _FIRST_LETTER.search(token, m.start(), m.end()):
            if not mail or mail.end() != m.end() - 2:  # one colon is read as that of mailto
                found.append(letter.start())
            break
    for m in _HOST.finditer(token):
        if (at := _host_start(m[0][:-1])) is not None:
            found.append(m.start() + at)
            break
    return min(found, default=None)


class Scanner:
    """Takes an answer piece by piece; ``at`` tells what a span touches so far."""

    def __init__(self):
        self.position = 0
        self.plain: list[Region] = []
        self.angle: list[Region] = []
        self.quoted: list[Region] = []
        self.addresses: list[Region] = []
        self.open: dict[str, bool] = dict.fromkeys(("plain", "angle", "quoted", "address"), False)
        self.pending: str | None = None  # the rule of an opener whose destination hasn't begun
        self.closing = ""  # the rule of the open angle region once it is closed
        self.quote = self.opener = self.equals = self.run = ""

    @property
    def regions(self) -> list[Region]:
        return [*self.plain, *self.angle, *self.quoted, *self.addresses]

    def feed(self, text: str) -> None:
        if text:
            self._feed_destinations(text)
            self._feed_attributes(text)
            self._feed_addresses(text)
            self.position += len(text)

    def _begin(self, text: str, at: int) -> None:
        """Begins the pending destination at the next place from ``at`` on that isn't white space, if nothing covers it yet."""
        at = _SPACES.match(text, at).end()
        if at == len(text):
            return
        rule, self.pending, here = self.pending, None, self.position + at
        if text[at] == "<":
            if not self.angle or self.angle[-1].end <= here:
                self.closing = rule
                self.angle.append(Region(here, here + 1, "unclosed-angle"))
                self._extend_angle(text, at + 1)
        elif not self.plain or self.plain[-1].end <= here:
            self.plain.append(Region(here, here, rule))
            self._extend_plain(text, at)

    def _extend_plain(self, text: str, at: int) -> None:
        stop = _PLAIN.match(text, at).end()
        self.plain[-1].end, self.open["plain"] = self.position + stop, stop == len(text)

    def _extend_angle(self, text: str, at: int) -> None:
        stop, own = _ANGLE.match(text, at).end(), self.angle[-1]
        own.end, self.open["angle"] = self.position + stop, stop == len(text)
        if text[stop : stop + 1] == ">":
            own.end, own.rule = self.position + stop + 1, self.closing

    def _feed_destinations(self, text: str) -> None:
        if self.open["angle"]:
            self._extend_angle(text, 0)
        if self.open["plain"]:
            self._extend_plain(text, 0)
        if self.pending:
            self._begin(text, 0)
        whole, shift = self.opener + text, len(self.opener)
        links = [(m.end(), RULES[0]) for m in _LINK.finditer(whole)]
        labels = [(m.end(), RULES[1]) for m in _LABELLED.finditer(whole)]
        for end, rule in sorted([*links, *labels]):
            if end > shift:
                self.pending = rule
                self._begin(text, end - shift)
        if m := _LABEL_END.search(whole):
            self.opener = "[" + ("\\]" if whole.endswith("]") else "x" * bool(m["inside"])) + m["escape"]
        else:
            self.opener = "[x]" if _CLOSED_END.search(whole) else "]" if whole.endswith("]") else ""

    def _feed_attributes(self, text: str) -> None:
        at = 0
        whole, shift = self.equals + text, len(self.equals)
        self.equals = ""
        while True:
            if self.quote:
                stop = text.find(self.quote, at)
                self.quoted[-1].end = self.position + (len(text) if stop < 0 else stop)
                if stop < 0:
                    return
                self.quoted[-1].rule, self.quote = "html-attribute", ""
                at = stop + 1
                whole, shift = text, 0
            m = _QUOTE.search(whole, at + shift if at else 0)
            if not m:
                break
            self.quote, at = m[1], m.end() - shift
            self.quoted.append(Region(self.position + at, self.position + at, "unclosed-quote"))
        if _EQUALS_END.search(whole, at + shift if at else 0):
            self.equals = "="

    def _feed_addresses(self, text: str) -> None:
        at = 0
        if self.open["address"]:
            m = _TOKEN.match(text)
            at = m.end() if m else 0
            self.addresses[-1].end = self.position + at
            if at == len(text):
                return
            self.open["address"] = False
            self.run = ""
        whole, shift = self.run + text[at:], at - len(self.run)
        self.run = ""
        for m in _TOKEN.finditer(whole):
            start, last = _address_start(m[0]), m.end() == len(whole)
            if start is not None:
                self.addresses.append(Region(self.position + shift + m.start() + start, self.position + shift + m.end(), "url"))
                self.open["address"] = last
            elif last and (rest := _RUN_END.search(m[0])):
                self.run = rest[0]

    def at(self, start: int, end: int) -> str | None:
        """The strongest rule of the regions that touch [start, end), or None."""
        own = []
        for regions in (self.plain, self.angle, self.quoted, self.addresses):
            i = bisect_left(regions, end, key=lambda r: r.start)
            while i and regions[i - 1].end > start:
                i -= 1
                own.append(RULES.index(regions[i].rule))
        return RULES[min(own)] if own else None


def unsafe_regions(text: str) -> list[tuple[int, int]]:
    """All regions of a text, overlapping or touching ones joined."""
    scanner = Scanner()
    scanner.feed(text)
    out: list[list[int]] = []
    for r in sorted((r for r in scanner.regions if r.start < r.end), key=lambda r: r.start):
        if out and r.start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r.end)
        else:
            out.append([r.start, r.end])
    return [tuple(x) for x in out]


def continues_host(after: str, bracketed: bool) -> bool:
    """Whether what follows a placeholder would make it a label of a host's name."""
    return bool(regex.match(r"[.-][A-Za-z0-9-]" if not bracketed else r"\.[A-Za-z0-9-]", after))
