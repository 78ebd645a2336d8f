"""Placeholders: their grammar, the numbering of values in one conversation, and which end of a stream is still undecided."""

from __future__ import annotations

from dataclasses import dataclass, field

import regex

from ..functions.normalise import normalise
from .candidates import TYPES, address_key, phone_number

NAMESPACES = (*TYPES, "LITERAL")
#: Namespaces whose placeholder may also be written with a blank and without brackets.
SPACED = ("AADHAAR", "LITERAL")
LAST_INDEX = 9999
_INDEX = "([1-9][0-9]{0,3})"
_GLUE = r"[\p{L}\p{N}\p{M}_]"
_ALL = "|".join(NAMESPACES)


def _bare(names: tuple[str, ...], separator: str) -> str:
    return rf"(?<!{_GLUE})({'|'.join(x for n in names for x in (n, n.title()))}){separator}{_INDEX}"


BRACKETED = regex.compile(rf"\[({_ALL})[_ ]{_INDEX}\]", regex.I)
BARE = regex.compile(_bare(NAMESPACES, "_") + rf"(?!{_GLUE})")
BARE_SPACED = regex.compile(_bare(SPACED, " ") + rf"(?!{_GLUE})")
BARE_OTHER = regex.compile(_bare(tuple(n for n in NAMESPACES if n not in SPACED), " ") + rf"(?!{_GLUE})")
#: What more text could still make a placeholder, or tell whether one is a host's name.
_GROWING = (regex.compile(rf"\[({_ALL})[_ ]{_INDEX}\]\.?", regex.I), regex.compile(f"(?:{_bare(NAMESPACES, '_')}|{_bare(SPACED, ' ')})[.-]?"))
#: Characters of a stream that may have to wait, at most.
HELD = max(map(len, NAMESPACES)) + len(f"[_{LAST_INDEX}]") + 1


class TooManyValues(ValueError):
    """A conversation has more values of one type than there are placeholders."""


def placeholder(namespace: str, index: int) -> str:
    if not 1 <= index <= LAST_INDEX:
        raise TooManyValues(namespace)
    return f"[{namespace}_{index}]"


@dataclass(frozen=True, slots=True)
class Mention:
    start: int
    end: int
    namespace: str
    index: int
    bracketed: bool


def mentions(text: str) -> list[Mention]:
    """Bracketed placeholders, and bare ones that touch no bracketed one, in order."""
    found = [Mention(*m.span(), m[1].upper(), int(m[2]), True) for m in BRACKETED.finditer(text)]
    inside = [False] * (len(text) + 1)
    for x in found:
        inside[x.start : x.end] = [True] * (x.end - x.start)
    for pattern in (BARE, BARE_SPACED):
        found += [Mention(*m.span(), m[1].upper(), int(m[2]), False) for m in pattern.finditer(text) if not any(inside[m.start() : m.end()])]
    return sorted(found, key=lambda x: x.start)


def undecided_from(text: str) -> int:
    """From where the end of ``text`` could still become a placeholder or change what one means."""
    for i in range(max(0, len(text) - HELD), len(text)):
        if any(p.fullmatch(text, i, partial=True) for p in _GROWING):
            return i
    return len(text)


def value_key(kind: str, surface: str) -> str:
    """What two spellings of one value share."""
    text = normalise(surface).text
    if kind in ("AADHAAR", "CARD", "NUMBER"):
        return "".join(ch for ch in text if "0" <= ch <= "9")
    if kind in ("PAN", "IFSC", "PASSPORT", "VOTER"):
        return text.upper()
    if kind in ("DOB", "PERSON"):
        return regex.sub(r"\s+", " ", text.lower())
    if kind in ("EMAIL", "UPI"):
        return text.lower()
    if kind == "IP":
        return address_key(text)
    if kind == "PHONE":
        reading = phone_number(text.replace("\r", " ").replace("\n", " "))
        return reading[0] if reading else text
    return text


@dataclass
class Numbering:
    """Index of each value of one namespace: by first appearance, past the indices that the user's own text holds."""

    by_key: dict[str, int] = field(default_factory=dict)
    values: dict[int, str] = field(default_factory=dict)
    exact_only: set[int] = field(default_factory=set)
    reserved: set[int] = field(default_factory=set)
    next: int = 1

    def index(self, key: str, value: str) -> int:
        if key not in self.by_key:
            while self.next in self.reserved:
                self.next += 1
            if self.next > LAST_INDEX:
                raise TooManyValues("no index left")
            self.by_key[key], self.values[self.next] = self.next, value
            self.next += 1
        return self.by_key[key]

    def reserve(self, index: int) -> None:
        """A loose spelling of ``index`` stands in the text: nobody gets it, or only its exact spelling is restored."""
        (self.exact_only if index in self.values else self.reserved).add(index)
