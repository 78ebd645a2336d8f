"""Labelled cases: a seeded generator, scores as DataFrame aggregates, and what is left of values in redacted texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checksums import luhn_digit, verhoeff_digit

_M32 = 0xFFFFFFFF


class Random:
    """SplitMix32; integers without bias by rejection."""

    def __init__(self, seed: int):
        self.state = seed & _M32

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B9) & _M32
        z = self.state
        z = ((z ^ z >> 16) * 0x21F0AAAD) & _M32
        z = ((z ^ z >> 15) * 0x735A2D97) & _M32
        return z ^ z >> 15

    def below(self, n: int) -> int:
        limit = (1 << 32) - (1 << 32) % n
        while (x := self.next()) >= limit:
            pass
        return x % n

    def pick(self, items):
        return items[self.below(len(items))]

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(chr(65 + self.below(26)) for _ in range(n))


def case_seed(seed: int, case: str) -> int:
    """FNV-1a of "seed:case": cases are independent, so they can be made in parallel."""
    h = 0x811C9DC5
    for b in f"{seed}:{case}".encode():
        h = ((h ^ b) * 0x01000193) & _M32
    return h


def grouped(digits: str, sizes: tuple[int, ...], separator: str = " ") -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return separator.join(out)


def make_value(kind: str, r: Random) -> str:
    """A made-up value of a type that passes the type's own checks; never one of a real person."""
    if kind == "AADHAAR":
        body = str(2 + r.below(8)) + r.digits(10)
        return grouped(body + verhoeff_digit(body), (4, 4, 4), r.pick([" ", "-", ""]))
    if kind == "CARD":
        body = r.pick(["4", "51", "53"]) + r.digits(20)
        body = body[:15]
        return grouped(body + luhn_digit(body), (4, 4, 4, 4), r.pick([" ", "-", ""]))
    if kind == "PAN":
        return r.letters(3) + r.pick("PCHF") + r.letters(1) + r.digits(4) + r.letters(1)
    if kind == "IFSC":
        return r.pick(["HDFC", "SBIN", "ICIC"]) + "0" + r.digits(6)
    if kind == "PHONE":
        return r.pick(["+91 ", ""]) + grouped(r.pick("6789") + r.digits(9), (5, 5), r.pick([" ", ""]))
    if kind == "EMAIL":
        return f"user{r.digits(4)}@{r.pick(['example.com', 'example.org'])}"
    if kind == "UPI":
        return f"user{r.digits(4)}@{r.pick(['okaxis', 'ybl', 'paytm'])}"
    if kind == "IP":
        return r.pick(["192.0.2.", "198.51.100.", "203.0.113."]) + str(r.below(256))
    if kind == "SECRET":
        return "ghp_" + "".join(r.pick("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(36))
    if kind == "NUMBER":
        return r.pick("123456789") + r.digits(10)
    raise ValueError(kind)


KINDS = ("AADHAAR", "CARD", "PAN", "IFSC", "PHONE", "EMAIL", "UPI", "IP", "SECRET", "NUMBER")
#: Sentences around a value: its word, so that an unproved form counts too.
_FRAMES = {"AADHAAR": "My aadhaar is {}.", "CARD": "Charge the card {} today.", "PAN": "PAN: {}", "IFSC": "Use IFSC {} for the transfer.", "PHONE": "Call me on {} now.", "EMAIL": "Write to {} please.", "UPI": "Pay by upi to {} now.", "IP": "The ip is {} here.", "SECRET": "The key {} leaked.", "NUMBER": "Account {} is mine."}


@dataclass(frozen=True)
class Piece:
    kind: str
    start: int
    end: int


def make_case(seed: int, case: str) -> tuple[str, list[Piece]]:
    """A message with one value of each of some kinds, and where they stand."""
    r = Random(case_seed(seed, case))
    text, pieces = "", []
    for kind in sorted(KINDS, key=lambda _: r.next())[: 1 + r.below(4)]:
        value = make_value(kind, r)
        before, after = _FRAMES[kind].split("{}")
        text += ("\n" if text else "") + before
        pieces.append(Piece(kind, len(text), len(text) + len(value)))
        text += value + after
    return text, pieces


def labelled_cases(spark: SparkSession, n: int, seed: int = 20260930) -> DataFrame:
    """(case_id, text, pieces), made where the rows are."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            made = [make_case(seed, f"C{i}") for i in pdf["id"]]
            yield pd.DataFrame({"case_id": pdf["id"], "text": [t for t, _ in made], "pieces": [[{"type": p.kind, "start": p.start, "end": p.end} for p in own] for _, own in made]})

    return spark.range(n).mapInPandas(run, "case_id long, text string, pieces array<struct<type:string,start:int,end:int>>")


def score(cases: DataFrame, detections: DataFrame) -> DataFrame:
    """By type: values, redacted (wholly covered), typed (by the right type), partial, missed, detections and right_type.

    ``cases``: case_id, pieces; ``detections``: case_id, detections. Overlaps are found case by case: an equi-join with the
    interval condition behind it.
    """
    truth = cases.select("case_id", F.posexplode("pieces").alias("k", "p")).select("case_id", "k", F.col("p.type").alias("type"), F.col("p.start").alias("a"), F.col("p.end").alias("b"))
    found = detections.select("case_id", F.inline("detections")).select("case_id", F.col("type").alias("found"), F.col("start").alias("x"), F.col("end").alias("y"))
    meets = (F.col("x") < F.col("b")) & (F.col("a") < F.col("y"))
    part = F.least("b", "y") - F.greatest("a", "x")
    by_value = truth.join(found, "case_id", "left").groupBy("case_id", "k", "type", "a", "b").agg(
        F.coalesce(F.sum(F.when(meets, part)), F.lit(0)).alias("covered"), F.coalesce(F.bool_or(meets & (F.col("found") == F.col("type")) & (F.col("x") <= F.col("a")) & (F.col("b") <= F.col("y"))), F.lit(False)).alias("typed")
    )
    whole = F.col("covered") >= F.col("b") - F.col("a")
    counts = by_value.groupBy("type").agg(F.count(F.lit(1)).alias("values"), F.count_if(whole).alias("redacted"), F.count_if("typed").alias("typed"), F.count_if(~whole & (F.col("covered") > 0)).alias("partial"), F.count_if(F.col("covered") == 0).alias("missed"))
    right = found.join(truth, "case_id").filter(meets).groupBy("case_id", "found", "x", "y").agg(F.bool_or(F.col("found") == F.col("type")).alias("right"))
    seen = found.join(right, ["case_id", "found", "x", "y"], "left").groupBy(F.col("found").alias("type")).agg(F.count(F.lit(1)).alias("detections"), F.count_if(F.coalesce("right", F.lit(False))).alias("right_type"))
    return counts.join(seen, "type", "full").na.fill(0)


def sent_values(cases: DataFrame, redacted: DataFrame) -> DataFrame:
    """By type: values, and those that the redacted text still holds as written."""
    values = cases.select("case_id", "text", F.explode("pieces").alias("p")).select("case_id", F.col("p.type").alias("type"), F.substring("text", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")).alias("value"))
    return values.join(redacted.select("case_id", F.col("text").alias("sent")), "case_id").groupBy("type").agg(F.count(F.lit(1)).alias("values"), F.count_if(F.contains("sent", "value")).alias("sent"))


def truncated_percent(part, whole):
    """A share as text, cut to one decimal and never rounded up; "-" of nothing."""
    tenths = F.floor(part * 1000 / whole)
    return F.when(whole == 0, "-").otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")))


def compare_baseline(stored: DataFrame, fresh: DataFrame, keys: list[str], more_is_better: bool = True) -> DataFrame:
    """keys, stored, fresh and verdict (same, better, worse, new, gone) of counts in the column ``count``."""
    s, f = stored.select(*keys, F.col("count").alias("stored")), fresh.select(*keys, F.col("count").alias("fresh"))
    better = F.col("fresh") > F.col("stored") if more_is_better else F.col("fresh") < F.col("stored")
    verdict = F.when(F.col("stored").isNull(), "new").when(F.col("fresh").isNull(), "gone").when(F.col("stored") == F.col("fresh"), "same").when(better, "better").otherwise("worse")
    return s.join(f, keys, "full").withColumn("verdict", verdict)


def echo(cases: DataFrame) -> DataFrame:
    """Per case: redacts, sends the redacted text back as an answer and restores it; exact: the text came back as it was."""
    def run(batches):
        import pandas as pd

        from .redact import lookup_in, redact_texts
        from .restore import COUNTS, restore

        for pdf in batches:
            rows = []
            for case, text in zip(pdf["case_id"], pdf["text"]):
                hidden, mapping = redact_texts([text])
                back, counts = restore(hidden[0], lookup_in(mapping))
                rows.append((case, back == text, counts["restored"], sum(counts[c] for c in COUNTS[1:])))
            yield pd.DataFrame(rows, columns=["case_id", "exact", "restored", "held_back"])

    return cases.select("case_id", "text").mapInPandas(run, "case_id long, exact boolean, restored long, held_back long")


def rewrite_fates(sent: str, answer: str, restored: str) -> dict[str, int]:
    """What became of a request's placeholders in a model's answer: restored, held (written but not restored), rewritten
    (another spelling), dropped; and placeholders that the answer invented."""
    from .placeholders import BARE_OTHER, mentions

    own = {(m.namespace, m.index) for m in mentions(sent) if m.bracketed}
    written = {(m.namespace, m.index) for m in mentions(answer)}
    left = {(m.namespace, m.index) for m in mentions(restored)}
    loose = {(m[1].upper(), int(m[2])) for m in BARE_OTHER.finditer(answer)}
    return {
        "restored": len((own & written) - left),
        "held": len(own & written & left),
        "rewritten": len((own & loose) - written),
        "dropped": len(own - written - loose),
        "invented": len(written - own),
    }


def leak_form(text: str, value: str) -> str | None:
    """In which form a text still shows a value: raw, lower-cased, normalised or squashed (letters and digits only)."""
    from ..functions.normalise import normalise

    squash = lambda s: "".join(c for c in normalise(s).text.lower() if c.isalnum())
    if value in text:
        return "raw"
    if value.lower() in text.lower():
        return "lower"
    if normalise(value).text.lower() in normalise(text).text.lower():
        return "normalised"
    return "squashed" if len(squash(value)) >= 6 and squash(value) in squash(text) else None


def name_metrics(truth: DataFrame, found: DataFrame, words: int) -> DataFrame:
    """recall, precision, f1 and false positives a thousand words of name spans (text_id, start, end); a name counts as
    found if it is covered."""
    t = truth.select("text_id", F.col("start").alias("a"), F.col("end").alias("b"))
    f = found.select("text_id", F.col("start").alias("x"), F.col("end").alias("y"))
    hit = (F.col("x") < F.col("b")) & (F.col("a") < F.col("y"))
    covered = t.join(f, "text_id", "left").groupBy("text_id", "a", "b").agg(F.coalesce(F.bool_or((F.col("x") <= F.col("a")) & (F.col("b") <= F.col("y"))), F.lit(False)).alias("ok")).agg(F.count(F.lit(1)).alias("names"), F.count_if("ok").alias("covered"))
    right = f.join(t, "text_id", "left").groupBy("text_id", "x", "y").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("ok")).agg(F.count(F.lit(1)).alias("spans"), F.count_if("ok").alias("right"))
    both = covered.join(F.broadcast(right))  # one row each
    recall, precision = F.try_divide("covered", "names"), F.try_divide("right", "spans")
    return both.select("names", "covered", "spans", "right", recall.alias("recall"), precision.alias("precision"), F.try_divide(2 * recall * precision, recall + precision).alias("f1"), ((F.col("spans") - F.col("right")) * 1000.0 / max(words, 1)).alias("false_per_1000_words"))


def markdown_table(header: list[str], rows: list[tuple]) -> str:
    """A report's table, from aggregates that were collected."""
    width = [max(len(str(r[i])) for r in [header, *rows]) for i in range(len(header))]
    line = lambda r: "| " + " | ".join(str(x).ljust(w) for x, w in zip(r, width)) + " |"
    return "\n".join([line(header), "| " + " | ".join("-" * w for w in width) + " |", *map(line, rows)])
