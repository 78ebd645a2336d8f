"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a Boolean expression over a document. Their costs and selectivities are estimated on a bounded sample and
the rules are ordered by rejections per second; the cascade is one CASE expression, so a rule runs only for rows that all
rules before it let pass. A filter computes nothing but what its rules ask for until one rejects. A report has five metrics
for every row, whatever the verdict; there the cascade skips what its rules compute beyond these (capitals, numbers of
lines). The order changes the cost and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, scratch

#: Rows on which costs and selectivities are estimated, at most, and the share of the rows by hash that they are picked from.
SAMPLE_ROWS, SAMPLE_SHARE = 1000, 4
_BLANK = r"[\x20\x09-\x0D]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once even if ``body`` uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The maximal runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array of words ``w``, the first window included."""
    n = F.size(w)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def covered(at: Column) -> Column:  # a window at p covers what the next window at q doesn't: min(3, q - p)
        return F.aggregate(F.transform(at, lambda p, k: F.coalesce(F.least(F.lit(3), F.get(at, k + 1) - p), F.lit(3))), F.lit(0), lambda a, x: a + x)

    def again(h: Column) -> Column:
        def of(s: Column) -> Column:
            twice = F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
            return bind(F.sort_array(F.transform(twice, lambda e: e["i"])), covered)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of))

    return F.coalesce(bind(windows, again), F.lit(0)).cast("long")


def lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


#: Each metric straight from a text.
_DIRECT: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(words(t)),
    "word_chars": lambda t: F.char_length(F.regexp_replace(t, _BLANK, "")),
    "n_symbols": lambda t: F.regexp_count(t, F.lit(r"[#*$%&|<>]")),
    "n_lines": lambda t: F.size(lines(t)),
    "n_dup_lines": lambda t: bind(lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))),
    "n_upper": lambda t: F.char_length(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
    "n_repeat_words": lambda t: bind(words(t), repeat_words),
}

#: What a report computes for every row; other metrics are computed where a rule asks for them.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def metrics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the REPORTED metrics, as _m (null text: none)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    of_words = bind(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
    out = df.withColumns({"_w": of_words, "_l": _DIRECT["n_dup_lines"](text).cast("long"), "_s": _DIRECT["n_symbols"](text).cast("long")})
    fields = {"n_words": "_w.n_words", "word_chars": "_w.word_chars", "n_symbols": "_s", "n_dup_lines": "_l", "n_repeat_words": "_w.n_repeat_words"}
    return out.withColumn("_m", F.struct(*(F.col(fields[m]).alias(m) for m in REPORTED))).drop("_w", "_l", "_s")


Metrics = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """``rejects``: a Boolean expression over the metrics ``uses``; ``sql``: the same for any SQL engine."""

    name: str
    uses: tuple[str, ...]
    rejects: Callable[[Metrics], Column]
    sql: str


#: Whole numbers only, so that any SQL engine gives the same verdict.
RULES = (
    Rule("few_words", ("n_words",), lambda m: m("n_words") < 50, "n_words < 50"),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda m: 100 * m("n_repeat_words") > 50 * m("n_words"), "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 100 * m("n_symbols") > 30 * m("n_words"), "100 * n_symbols > 30 * n_words"),
    Rule("duplicate_lines", ("n_lines", "n_dup_lines"), lambda m: (m("n_lines") >= 4) & (100 * m("n_dup_lines") > 50 * m("n_lines")), "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", ("n_words", "word_chars"), lambda m: (m("word_chars") > 40 * m("n_words")) | (2 * m("word_chars") < 3 * m("n_words")), "word_chars > 40 * n_words OR 2 * word_chars < 3 * n_words"),
    Rule("capitals", ("word_chars", "n_upper"), lambda m: 100 * m("n_upper") > 60 * m("word_chars"), "100 * n_upper > 60 * word_chars"),
)

def _on_text(rule: Rule, text: Column) -> Column:
    """The rule as one expression over the text: only the metrics that it uses are computed, each once."""
    fields = F.struct(*(_DIRECT[m](text).cast("long").alias(m) for m in rule.uses))
    return bind(fields, lambda m: rule.rejects(lambda name: m[name]))


def _on_metrics(rule: Rule, text: Column) -> Column:
    """The rule where the REPORTED metrics are there already: only what else it uses is computed, inside the expression."""
    return rule.rejects(lambda name: F.col(f"_m.{name}") if name in REPORTED else _DIRECT[name](text).cast("long"))


def order_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", rows: int = SAMPLE_ROWS, reported: bool = False) -> list[tuple[Rule, float, float]]:
    """The rules by falling rejections per second, with the seconds and the share of rejections measured on at most
    ``rows`` rows, which are picked by a hash of the text and written once. ``reported``: the REPORTED metrics are there
    already. Ties keep the given order; an empty table leaves it as it is."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    with scratch(df.sparkSession):
        picked = df.select(text.alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_SHARE)) == 0).limit(rows)
        sample = cut(metrics(picked) if reported else picked, "sample")
        on = _on_metrics if reported else _on_text
        measured = []
        for rule in (None, *rules):
            hit = F.lit(False) if rule is None else on(rule, F.col("text"))
            began = time.perf_counter()
            n, bad = sample.agg(F.count(F.lit(1)), F.count_if(hit)).first()
            measured.append((time.perf_counter() - began, bad / n if n else 0.0))
    floor = min(s for s, _ in measured)
    costs = [max(s - floor, 1e-3) for s, _ in measured[1:]]
    found = [(r, c, share) for r, c, (_, share) in zip(rules, costs, measured[1:])]
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(order: list[Rule], expression: Callable[[Rule], Column]) -> Column:
    """Name of the first rule in ``order`` that rejects the row, null if none does; later rules aren't evaluated."""
    out = None
    for rule in order:
        out = F.when(expression(rule), F.lit(rule.name)) if out is None else out.when(expression(rule), F.lit(rule.name))
    return out if out is not None else F.lit(None).cast("string")


def quality_filter(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that no rule rejects, all columns as they are. Each rule works on the text itself, so what a row
    costs ends with the first rule that rejects it. A null or empty text has no words; repeated rows are judged alike."""
    order = [r for r, _, _ in order_rules(df, rules, text_col)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.filter(cascade(order, lambda r: _on_text(r, text)).isNull())


def quality_report(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of every row.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows. kept: false if base_failed, else
    no rule of the cascade rejects. A null text has no words and fails; repeated rows and null ids stay; other columns are
    not read.
    """
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [r for r, _, _ in order_rules(own, rules, reported=True)]
    base = F.expr("_m.n_words < 50 OR 100 * _m.n_repeat_words > 50 * _m.n_words")
    verdict = cascade(order, lambda r: _on_metrics(r, F.col("text")))
    kept = F.when(base, F.lit(False)).otherwise(verdict.isNull())
    return metrics(own).select("doc_id", "_m.*", base.alias("base_failed"), kept.alias("kept"))


ORACLE_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
numbered AS (SELECT row_number() OVER () AS k, * FROM w),
windows AS (
  SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM numbered)),
twice AS (SELECT k, i FROM windows QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
covered AS (SELECT k, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS o(d) GROUP BY k),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper
  FROM numbered LEFT JOIN covered c USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({RULES[0].sql}) OR ({RULES[1].sql}) AS base_failed,
       NOT ({' OR '.join(f'({r.sql})' for r in RULES)}) AS kept
FROM m
"""
