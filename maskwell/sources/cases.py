"""Labelled cases as text files: headers, roles, and slots that are filled from a seed.

    === H002 | lookalike, shape:side
    @user
    Order {{NOT:ORD-######}} and card {{CARD@mine}}, again {{CARD@mine}} or {{EMAIL=a@example.com}}.

A slot is a type, or NOT for what must stay; ``=`` gives a literal, ``:`` a mask (# digit, A letter, other characters as they
are), ``@`` a name under which the same value comes again within the case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import regex
from pyspark.sql import DataFrame, SparkSession

from ..operators.candidates import TYPES
from ..operators.evaluation import KINDS, Random, case_seed, make_value
from .tables import ROLES

_SLOT = regex.compile(r"\{\{(?P<type>[A-Z]+)(?:@(?P<name>[a-z0-9_]+))?(?:=(?P<literal>[^}]*)|:(?P<mask>[^}]*))?\}\}")
_HEADER = regex.compile(r"=== (?P<id>[A-Za-z0-9_-]+)(?: \| (?P<tags>.*))?")
SCHEMA = "case_id string, tags array<string>, turn int, role string, text string, pieces array<struct<type:string,start:int,end:int,value_id:string>>"


class CaseError(ValueError):
    """A case file that is not well-formed; the message names the line."""


@dataclass
class RawCase:
    case_id: str
    tags: list[str]
    messages: list[tuple[str, list[str]]] = field(default_factory=list)


def parse_cases(text: str) -> Iterator[RawCase]:
    case: RawCase | None = None
    for n, line in enumerate(text.split("\n"), 1):
        if m := _HEADER.fullmatch(line):
            if case:
                yield case
            case = RawCase(m["id"], [t.strip() for t in (m["tags"] or "").split(",") if t.strip()])
        elif line.startswith("@") and line[1:] in ROLES:
            if case is None:
                raise CaseError(f"line {n}: a role before any case")
            case.messages.append((line[1:], []))
        elif case and case.messages:
            case.messages[-1][1].append(line)
        elif line.strip():
            raise CaseError(f"line {n}: text outside a message")
    if case:
        yield case


def _fill(m, r: Random) -> str:
    if m["literal"] is not None:
        return m["literal"]
    if m["mask"] is not None:
        return "".join(r.digits(1) if c == "#" else r.letters(1) if c == "A" else c for c in m["mask"])
    if m["type"] not in KINDS:
        raise CaseError(f"no generator for {m['type']}")
    return make_value(m["type"], r)


def render_case(case: RawCase, seed: int) -> Iterator[tuple[int, str, str, list[dict]]]:
    """(turn, role, text, pieces) of each message; the same seed and case give the same text."""
    r, named = Random(case_seed(seed, case.case_id)), {}
    count = 0
    for turn, (role, lines) in enumerate(case.messages):
        source, out, pieces, at = "\n".join(lines).strip("\n"), "", [], 0
        for m in _SLOT.finditer(source):
            if m["type"] != "NOT" and m["type"] not in TYPES:
                raise CaseError(f"{case.case_id}: unknown type {m['type']}")
            key = (m["type"], m["name"]) if m["name"] else None
            if key in named:
                value, value_id = named[key]
            else:
                count += 1
                value, value_id = _fill(m, r), f"{case.case_id}-{count}"
                if key:
                    named[key] = (value, value_id)
            out += source[at : m.start()]
            pieces.append({"type": m["type"], "start": len(out), "end": len(out) + len(value), "value_id": value_id})
            out, at = out + value, m.end()
        yield turn, role, out + source[at:], pieces


def read_cases(spark: SparkSession, path: str, seed: int = 20260930) -> DataFrame:
    """The messages of case files as SCHEMA rows; a file that is not well-formed fails the job."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(c.case_id, c.tags, *m) for text in pdf["value"] for c in parse_cases(text) for m in render_case(c, seed)]
            yield pd.DataFrame(rows, columns=["case_id", "tags", "turn", "role", "text", "pieces"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, SCHEMA)
