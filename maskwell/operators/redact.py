"""Detection, redaction and restoration over DataFrames.

Detection is a map over Arrow batches behind a native prefilter that passes every text that could hold a value. Redaction
numbers the values of a conversation by first appearance: messages are read in parallel, what is numbered are the distinct
values of one conversation and type (9,999 at most), and only spans, never texts, are joined. One very long conversation
therefore doesn't end in one task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.written import written
from .names import find_names
from .placeholders import BARE, BARE_OTHER, BARE_SPACED, BRACKETED, Numbering, mentions, placeholder, value_key
from .resolve import EXTRA, Detector, detect_text
from .restore import COUNTS, restore

DETECTION = "array<struct<type:string,start:int,end:int,validated:boolean,context:boolean>>"
#: Texts without any of these can't hold a value: ASCII only, no digit, "@" or ":" and no credential word.
_SIGNAL = r"[^\x00-\x7F]|[0-9@:]|(?i:pass|pwd|secret|token|bearer|api.?key|access.?key|private.?key|otp|pin|cvv|cvc|sk-|gh[pousr]_|github_pat|glpat-|akia|asia|[sr]k_|whsec_|rzp_|xox|xapp-|aiza|npm_|hf_|eyj|-----begin)"


def has_signal(text: Column) -> Column:
    """A superset of the texts in which anything can be detected (person names aside)."""
    return F.coalesce(text.rlike(_SIGNAL), F.lit(False))


_DETECTION_TYPE = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("validated", pa.bool_()), ("context", pa.bool_())]))


def _detections(extra: list[Detector], names: frozenset[str] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, signal in zip(batch.column("_text").to_pylist(), batch.column("_signal").to_pylist()):
            found = detect_text(text, find_names(text, names) if names else None, extra=extra) if signal and text else []
            out.append([{"type": s.type, "start": s.start, "end": s.end, "validated": s.validated, "context": bool(s.context)} for s in found])
        kept = [c for c in batch.schema.names if c not in ("_text", "_signal")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, _DETECTION_TYPE)], [*kept, "detections"])


def detect(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, names: frozenset[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) and detections: type, start, end (code points of the text), validated, context.

    ``names``: person names in lower case, by which PERSON is found; it travels with the tasks, so its size is the caller's
    bound. With names or registered detectors every text is looked at. A null or empty text has no detections.
    """
    kept = df.columns if keep is None else keep
    text = F.col(text_col).cast("string")
    signal = F.lit(True) if names or EXTRA else has_signal(text)
    rows = df.select(*kept, text.alias("_text"), signal.alias("_signal"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields)
    return rows.mapInArrow(partial(_detections, list(EXTRA.values()), names), f"{schema}, detections {DETECTION}")


def _outside(text: str, start: int, end: int, literals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Parts of a span outside literals; where it is cut, only letters and digits end it."""
    out, a = [], start
    for x, y in [*(s for s in literals if s[0] < end and start < s[1]), (end, end)]:
        lo, hi = a, min(x, end)
        while lo < hi and a != start and not regex.match(r"[\p{L}\p{N}]", text[lo]):
            lo += 1
        while hi > lo and x < end and not regex.match(r"[\p{L}\p{N}]", text[hi - 1]):
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
        a = max(a, y)
    return out


def message_spans(text: str, names: list[tuple[int, int]] | None = None, extra: list[Detector] | None = None) -> tuple[list[tuple[int, int, str, str, str]], list[tuple[str, int]]]:
    """(start, end, namespace, key, value) of what is replaced in a message, in order; and the indices that it reserves."""
    spans = [(*m.span(), "LITERAL", m[0], m[0]) for m in BRACKETED.finditer(text)]
    literals = [s[:2] for s in spans]
    starts = [a for a, _ in literals]

    def in_literal(a: int, b: int) -> bool:
        i = bisect_right(starts, b - 1)
        return bool(i) and literals[i - 1][1] > a

    reserved = [(m[1].upper(), int(m[2])) for p in (BARE, BARE_SPACED) for m in p.finditer(text) if not in_literal(*m.span())]
    own_names = [p for n in names or () for p in _outside(text, *n, literals)]
    for d in detect_text(text, own_names, extra=extra):
        for a, b in _outside(text, d.start, d.end, literals) if literals else [(d.start, d.end)]:
            spans.append((a, b, d.type, value_key(d.type, text[a:b]), text[a:b]))
    return sorted(spans), reserved


def replace_spans(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, new in sorted(spans):
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:]


def redact_texts(texts: list[str]) -> tuple[list[str], dict[str, Numbering]]:
    """One conversation on the driver's side: redacted messages and the mapping."""
    mapping: dict[str, Numbering] = {}
    out = []
    for text in texts:
        spans, reserved = message_spans(text)
        for namespace, index in reserved:
            mapping.setdefault(namespace, Numbering()).reserve(index)
        out.append(replace_spans(text, [(a, b, placeholder(n, mapping.setdefault(n, Numbering()).index(k, v))) for a, b, n, k, v in spans]))
    return out, mapping


def lookup_in(mapping: dict[str, Numbering]):
    def find(namespace: str, index: int):
        own = mapping.get(namespace)
        return None if own is None or index not in own.values else (own.values[index], index in own.exact_only)

    return find


_SPAN = "array<struct<start:int,end:int,namespace:string,key:string,value:string>>"
_RESERVED = "array<struct<namespace:string,idx:int>>"


def _messages(extra: list[Detector], names: frozenset[str] | None, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [message_spans(t or "", find_names(t, names) if names and t else None, extra) for t in pdf["text"]]
        yield pdf.assign(
            spans=[[dict(zip(("start", "end", "namespace", "key", "value"), s)) for s in spans] for spans, _ in found],
            reserved=[[{"namespace": n, "idx": i} for n, i in r] for _, r in found],
        )


def _number(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Indices of one conversation and namespace, from first appearances and reservations in order."""
    numbering, rows = Numbering(), []
    for r in pdf.sort_values(["turn", "mark", "kind", "place"]).itertuples():
        if r.kind == 0:
            numbering.reserve(int(r.place))
        else:
            numbering.index(r.key, r.value)
    for k, index in numbering.by_key.items():
        rows.append((key[0], key[1], index, k, numbering.values[index], index in numbering.exact_only))
    return pd.DataFrame(rows, columns=["conv_id", "namespace", "idx", "key", "value", "exact_only"])


#: Stands for a null turn where turns are ordered: before all others.
_NO_TURN = -(2**63)
_MAPPING = "conv_id long, namespace string, idx int, key string, value string, exact_only boolean"


def _replaced(text: Column, new: Column) -> Column:
    """``text`` with each (start, end, new) of an ordered array put in, left to right: what is written, and from where on."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), x["new"]).alias("out"), x["end"].alias("at"))
    return F.aggregate(new, begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def redact_conversations(df: DataFrame, names: frozenset[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, text) to the same rows with redacted texts, and the mapping (conv_id, namespace, idx, key,
    value, exact_only).

    Every row has a key of its own, whatever its ids are: rows of a null conv_id are one conversation, a null turn comes
    before all others, and rows of one turn are ordered by a hash of role and text. Null texts stay null. A row whose values
    don't all find their placeholder fails the job rather than pass, and so does a conversation of over 9,999 values of a
    type. ``names`` as in detect(). An empty table gives empty ones.
    """
    own = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("row", F.monotonically_increasing_id())
    schema = f"conv_id long, turn long, role string, text string, row long, spans {_SPAN}, reserved {_RESERVED}"
    found = written(own.mapInPandas(partial(_messages, list(EXTRA.values()), names), schema), "messages")
    place = (F.coalesce("turn", F.lit(_NO_TURN)).alias("turn"), F.xxhash64("role", "text").alias("mark"))
    spans = found.select("conv_id", "row", *place, F.explode("spans").alias("s")).select("conv_id", "row", "turn", "mark", "s.*")
    first = spans.groupBy("conv_id", "namespace", "key").agg(F.min(F.struct("turn", "mark", "start", "value")).alias("f"))
    values = first.select("conv_id", "namespace", "f.turn", "f.mark", F.lit(1).alias("kind"), F.col("f.start").alias("place"), "key", F.col("f.value").alias("value"))
    held = found.select("conv_id", *place, F.explode("reserved").alias("r")).withColumn("at", F.struct("turn", "mark"))
    held = held.groupBy("conv_id", "r.namespace", "r.idx").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    # the first mention reserves an index; the last one still marks an index that was given before it
    held = held.select("conv_id", "namespace", "idx", F.explode(F.array_distinct(F.array("low", "high"))).alias("at"))
    held = held.select("conv_id", "namespace", "at.turn", "at.mark", F.lit(0).alias("kind"), F.col("idx").alias("place"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
    mapping = written(values.unionByName(held).groupBy("conv_id", "namespace").applyInPandas(_number, _MAPPING), "mapping")
    m = mapping.select(F.col("conv_id").alias("m_conv"), F.col("namespace").alias("m_namespace"), F.col("key").alias("m_key"), "idx")
    same = F.col("conv_id").eqNullSafe(F.col("m_conv")) & (F.col("namespace") == F.col("m_namespace")) & (F.col("key") == F.col("m_key"))
    new = F.concat(F.lit("["), "namespace", F.lit("_"), "idx", F.lit("]"))
    named = spans.join(m, same).select("row", F.struct("start", "end", new.alias("new")).alias("x"))
    per_row = named.groupBy(F.col("row").alias("of_row")).agg(F.array_sort(F.collect_list("x")).alias("new"))
    joined = found.join(per_row, F.col("row") == F.col("of_row"), "left")
    complete = F.size("spans") == F.coalesce(F.size("new"), F.lit(0))
    text = F.when(F.size("spans") == 0, F.col("text")).when(complete, _replaced(F.col("text"), F.col("new"))).otherwise(F.raise_error(F.lit("a message's values did not all find their placeholders")))
    return joined.select("conv_id", "turn", "role", text.alias("text")), mapping


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(conv, row, n, i) for conv, row, text in zip(pdf["conv_id"], pdf["row"], pdf["text"]) for n, i in candidates_in(text or "")]
        yield pd.DataFrame(rows, columns=["conv_id", "row", "namespace", "idx"])


def restore_answers(answers: DataFrame, mapping: DataFrame, everywhere: bool = False) -> DataFrame:
    """(conv_id, text) with the values of its conversation, and the counts of what was restored or held back.

    An answer is joined with the entries that it mentions only. A null conv_id has the mapping of the null conversation; a
    null text is an empty one; repeated rows are restored each.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for conv, text, entries in zip(pdf["conv_id"], pdf["text"], pdf["entries"]):
                table = {(e["namespace"], e["idx"]): (e["value"], e["exact_only"]) for e in (entries if entries is not None else ())}
                out, counts = restore(text or "", lambda n, i, t=table: t.get((n, i)), everywhere)
                rows.append((conv, out, *(counts[c] for c in COUNTS)))
            yield pd.DataFrame(rows, columns=["conv_id", "text", *(c.replace("-", "_") for c in COUNTS)])

    own = written(answers.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "answers")
    asked = own.mapInPandas(_asked, "conv_id long, row long, namespace string, idx int")
    m = mapping.select(F.col("conv_id").alias("m_conv"), F.col("namespace").alias("m_namespace"), F.col("idx").alias("m_idx"), "value", "exact_only")
    same = F.col("conv_id").eqNullSafe(F.col("m_conv")) & (F.col("namespace") == F.col("m_namespace")) & (F.col("idx") == F.col("m_idx"))
    entries = asked.join(m, same).groupBy(F.col("row").alias("of_row")).agg(F.collect_list(F.struct("namespace", "idx", "value", "exact_only")).alias("entries"))
    schema = "conv_id long, text string, " + ", ".join(f"{c.replace('-', '_')} long" for c in COUNTS)
    return own.join(entries, F.col("row") == F.col("of_row"), "left").select("conv_id", "text", "entries").mapInPandas(run, schema)


def candidates_in(text: str) -> set[tuple[str, int]]:
    """Every (namespace, index) that an answer could ask for, in any spelling."""
    found = {(m.namespace, m.index) for m in mentions(text)}
    return found | {(m[1].upper(), int(m[2])) for p in (BRACKETED, BARE_OTHER) for m in p.finditer(text)}
