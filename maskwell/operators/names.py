"""Person names by a list and by cue words, off unless a list is given.

The list is a parameter (a file or a table of names); the words around a name decide between two thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass

import regex

#: Words that stand before or after a person's name.
CUES_BEFORE = frozenset("mr mrs ms miss dr prof shri smt sri kumari name named dear hi hello regards from contact attn attention patient customer employee श्री श्रीमती डॉ नाम".split())
CUES_AFTER = frozenset("ji sahab saheb sir madam जी साहब".split())
BEFORE, AFTER, LONGEST = 24, 10, 4
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*")


@dataclass(frozen=True)
class Scored:
    start: int
    end: int
    score: float


def has_cue(text: str, start: int, end: int) -> bool:
    """A whole cue word shortly before, or after a blank shortly behind, the span."""
    before = [m[0].lower() for m in _WORD.finditer(text, max(0, start - BEFORE), start)]
    after = [m[0].lower() for m in _WORD.finditer(text, end, min(len(text), end + AFTER))] if text[end : end + 1].isspace() else []
    return bool(CUES_BEFORE & set(before[-2:]) or CUES_AFTER & set(after[:1]))


def listed_runs(text: str, names: frozenset[str]) -> list[Scored]:
    """Runs of up to LONGEST capitalised (or caseless) words side by side that hold a listed name or follow a cue."""
    out: list[Scored] = []
    run: list = []

    def close() -> None:
        if run and (any(w[0].lower() in names for w in run) or has_cue(text, run[0].start(), run[-1].end())):
            known = any(w[0].lower() in names for w in run)
            out.append(Scored(run[0].start(), run[-1].end(), 0.9 if known and len(run) > 1 else 0.6 if known else 0.5))
        run.clear()

    for w in _WORD.finditer(text):
        if run and (len(run) == LONGEST or text[run[-1].end() : w.start()] not in (" ", ". ")):
            close()
        if w[0][0].isupper() or not w[0].isascii() and not w[0][0].islower():
            if w[0].lower() not in CUES_BEFORE:
                run.append(w)
                continue
        close()
    close()
    return out


def accepted(text: str, spans: list[Scored], high: float = 0.9, mid: float | None = 0.6) -> list[tuple[int, int]]:
    """Spans of at least ``high``, or of at least ``mid`` with a cue; overlapping or touching ones joined."""
    kept = sorted((s.start, s.end) for s in spans if s.score >= high or mid is not None and s.score >= mid and has_cue(text, s.start, s.end))
    out: list[list[int]] = []
    for a, b in kept:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def check_model_output(text: str, spans: list[tuple[int, int, float]]) -> list[Scored]:
    """A name model's spans, or an error: whole offsets in range, scores from 0 to 1, no more spans than characters."""
    if len(spans) > len(text):
        raise ValueError("more spans than characters")
    for a, b, s in spans:
        if not (isinstance(a, int) and isinstance(b, int) and 0 <= a < b <= len(text) and 0 <= s <= 1):
            raise ValueError("a span out of range")
    return [Scored(*x) for x in spans]


def find_names(text: str, names: frozenset[str]) -> list[tuple[int, int]]:
    return accepted(text, listed_runs(text, names), 0.5)
