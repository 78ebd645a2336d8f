"""Toxicity: a lexicon trie intersected with Levenshtein automata, and scores of the context of what they catch.

The lexicon is learned from labelled rows (a bounded sample), beside a few seed terms: words, and beginnings of words, that
toxic texts hold far more often than others, by likelihood ratio. A text's word is run through the trie; an automaton
state is a row of edit distances cut off at the limit, so that a branch ends where no completion can be within it
(substitution, insertion, deletion, swap of neighbours). A hit counts by its distance and by the words around it: within
quotation marks or after a word of reporting it is quotation, beside an address it is abuse. A small logistic model turns
these sums into a score. Language, source, id and labels are never inputs of a score.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, text_frame, texts_of

#: Labelled rows that the model is fitted on, at most: those of the smallest hash of their id.
TRAIN_ROWS = 8000
#: Characters of all texts that a model is fitted on, at most.
TRAIN_CHARS = 40_000_000
#: Plain English insults that the lexicon starts from.
SEED_TERMS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown", "imbecile", "dumbass", "bastard", "asshole")
#: Words that report what somebody said, and words that address somebody.
REPORTING = frozenset("said says say saying called calls quote quoted quotes wrote written word words term terms phrase means meaning definition slur insult insults reported according dijo dice palabra sagte sagt wort dit mot".split())
ADDRESS = frozenset("you your you're youre u yours yourself are such stupid shut du dein sie ihr tu ton ta vous votre eres usted ustedes".split())
_OPEN, _CLOSE = "\"'“”‘«»„‚`", "\"'“”’«»‘`"
_STRIP = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in "@$") + "“”‘’«»„‚…–—¿¡"
#: Words around a hit that are its context.
WINDOW = 8
#: Known words without hits that a worker remembers, in each of two generations.
SEEN_WORDS = 300_000


class Trie:
    """Terms of a lexicon; an automaton state is a row of distances, one for each prefix of the word."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.terms, self.stems = terms, stems
        self.root: dict = {}
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        self.ends: set[tuple[str, str]] = set()
        self.sizes: set[int] = set()
        self.frames: set[tuple[int, int]] = set()
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            if len(term) >= 5:  # one edit leaves one half whole, or all but the two letters that are swapped across the middle
                h = len(term) // 2
                self.heads.add(term[:h])
                self.tails.add(term[h:])
                self.ends.add((term[: h - 1], term[h + 1 :]))
                self.frames.add((h - 1, len(term) - h - 1))
        self.head_sizes = sorted({len(x) for x in self.heads})
        self.tail_sizes = sorted({len(x) for x in self.tails})
        self.stem_sizes = sorted({len(x) for x in stems})

    def _may_match(self, word: str) -> bool:
        return (
            any(word[:k] in self.heads for k in self.head_sizes)
            or any(word[-k:] in self.tails for k in self.tail_sizes)
            or any((word[:a], word[len(word) - b :]) in self.ends for a, b in self.frames)
        )

    def find(self, word: str) -> tuple[float, int]:
        """Weight and distance of the best term within the limit (1 from five letters on, else 0), or (0, 0)."""
        if word in self.terms:
            return self.terms[word], 0
        for k in self.stem_sizes:
            if word[:k] in self.stems:
                return self.stems[word[:k]], 0
        if len(word) < 4 or not self._may_match(word):
            return 0.0, 0
        best = 0.0
        limit, n = 1, len(word)
        stack = [(self.root, "", None, list(range(n + 1)))]
        while stack:
            node, last, above, row = stack.pop()
            term = node.get("")
            if term and len(term) >= 5 and row[n] <= limit:
                best = max(best, self.terms[term])
            for c, below in node.items():
                if c:
                    new = [row[0] + 1]
                    for j in range(1, n + 1):
                        d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (word[j - 1] != c))
                        if above and j > 1 and word[j - 2] == c and word[j - 1] == last:
                            d = min(d, above[j - 2] + 1)
                        new.append(min(d, limit + 1))
                    if min(new) <= limit:
                        stack.append((below, c, row, new))
        return best, int(best > 0)


class Model:
    """Lexicon, exceptions and the logistic model's coefficients."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], benign: frozenset[str] = frozenset(), coefficients: tuple[float, ...] = (-3.0, 4.0, 0.2, 1.0)):
        self.trie, self.benign, self.coefficients = Trie(terms, stems), benign, np.array(coefficients)
        self._reset()

    def _reset(self) -> None:
        self.hits: dict[str, tuple[float, int]] = {}
        self.clean: set[str] = set()
        self.older: set[str] = set()

    def __reduce__(self):
        return Model, (self.trie.terms, self.trie.stems, self.benign, tuple(self.coefficients.tolist()))

    def _learn_words(self, words: set[str]) -> None:
        for raw in words:
            core = raw.strip(_STRIP)
            weight, distance = self.trie.find(core) if len(core) >= 3 else (0.0, 0)
            if weight and not (distance and core in self.benign):
                self.hits[raw] = (weight, distance)
            else:
                self.clean.add(raw)
        if len(self.clean) > SEEN_WORDS:
            self.older, self.clean = self.clean, set()
        if len(self.hits) > SEEN_WORDS:
            self.hits = {}

    def features(self, text: str) -> tuple[float, float, float]:
        """Sums of the weights of abusive and of quoted hits, damped, and the share of words that are abusive hits."""
        words = text.lower().split()
        distinct = set(words)
        unknown = distinct - self.clean - self.older - self.hits.keys()
        if unknown:
            self._learn_words(unknown)
        if self.hits.keys().isdisjoint(distinct):
            return 0.0, 0.0, 0.0
        abuse = quoted = 0.0
        n_abuse = 0
        for i, w in enumerate(words):
            if w in self.hits:
                weight, distance = self.hits[w]
                weight *= 0.8**distance
                if self._is_quoted(words, i):
                    quoted += weight
                else:
                    near = {x.strip(_STRIP) for x in words[max(0, i - 3) : i + 4]}
                    abuse += weight * (1.5 if near & ADDRESS else 1.0)
                    n_abuse += 1
        return math.log1p(abuse), math.log1p(quoted), n_abuse / len(words)

    @staticmethod
    def _is_quoted(words: list[str], i: int) -> bool:
        """Between quotation marks that open and close within the window, or right after a word of reporting."""
        before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
        opened = words[i][0] in _OPEN
        for w in reversed(before):
            if opened or w[-1] in _CLOSE or w[-1] in ".,;:" and w[-2:-1] in _CLOSE:
                break
            opened = w[0] in _OPEN
        if opened:
            for w in [words[i], *after]:
                if w.rstrip(".,;:!?")[-1:] in _CLOSE and w.rstrip(".,;:!?"):
                    return True
        return any(w.strip(_STRIP) in REPORTING for w in before[-3:])

    def score(self, text: str) -> float:
        z = float(self.coefficients @ np.array([1.0, *self.features(text)]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _distinct_texts(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Without near copies (any of three minimal 5-word shingles seen before): their words would look like a lexicon."""
    seen, out = set(), []
    for text, label in rows:
        w = text.lower().split()
        grams = [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
        keys = {(s, min(grams, key=lambda g: hash_text(g, s))) for s in range(3)} if len(w) >= 5 else {(0, text)}
        if keys.isdisjoint(seen):
            out.append((text, label))
        seen |= keys
    return out


def hash_text(text: str, salt: int) -> int:
    """A hash that is the same in every process."""
    import zlib

    return zlib.crc32(text.encode(), salt * 0x9E3779B1 & 0xFFFFFFFF)


def learn_lexicon(rows: list[tuple[str, int]]) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and stems with weights, from (text, label) rows; seed terms stay unless the labels speak against them."""
    positive, negative = Counter(), Counter()
    n_positive = sum(y for _, y in rows)
    for text, y in rows:
        words = {w.strip(_STRIP) for w in set(text.lower().split())}
        own = {(w, True) for w in words if len(w) >= 3} | {(w[:k], False) for w in words for k in range(4, 8) if len(w) > k}
        (positive if y else negative).update(own)
    found = {}
    if n_positive and n_positive < len(rows):
        prior = n_positive / len(rows)
        bar = math.log(len(positive) + 1) + 6
        for key, p in positive.items():
            n = negative[key]
            if p >= 4 and p >= 9 * n:
                ratio = p * math.log(p / ((p + n) * prior)) + (n * math.log(n / ((p + n) * (1 - prior))) if n else 0)
                if ratio >= bar:
                    found[key] = ratio
    terms, stems = {}, {}
    for (text, whole), ratio in sorted(found.items(), key=lambda x: (-round(x[1], 6), not x[0][1], -len(x[0][0]), x[0][0])):
        chain = [r for (t, _), r in found.items() if t.startswith(text) or text.startswith(t)]
        if ratio < 0.9 * max(chain):
            continue
        if any(text.startswith(s) or s.startswith(text) for s in stems) or any(t.startswith(text) or text.startswith(t) for t in terms):
            continue
        (terms if whole else stems)[text] = 1.0
    for term in SEED_TERMS:
        if term not in terms and negative[term, True] <= positive[term, True]:
            terms[term] = 1.0
    return terms, stems


def fit(rows: list[tuple[str, int]]) -> Model:
    """The model of labelled rows; of none, or of one class only, the seed terms with fixed coefficients."""
    distinct = _distinct_texts(rows)
    terms, stems = learn_lexicon(distinct)
    model = Model(terms, stems)
    benign = Counter()
    for text, y in distinct:
        model.features(text)
        if not y:
            benign.update({c for w in set(text.lower().split()) if w in model.hits and model.hits[w][1] for c in [w.strip(_STRIP)]})
    for text, y in distinct:  # near misses of a term that clean texts hold are no misspellings
        if y:
            benign.subtract({c for w in set(text.lower().split()) if w in model.hits and model.hits[w][1] for c in [w.strip(_STRIP)]})
    model = Model(terms, stems, frozenset(w for w, n in benign.items() if n > 0))
    y = np.array([label for _, label in rows], float)
    if not 0 < y.sum() < len(y):
        return model
    x = np.array([[1.0, *model.features(t)] for t, _ in rows])
    beta, penalty = np.zeros(4), np.diag([1e-3, 0.1, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return Model(terms, stems, model.benign, tuple(beta.tolist()))


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """A model of at most ``rows`` labelled documents whose crc32(doc_id as text) mod 5 is not 0, in an order by hash until
    their texts come to ``chars`` characters: what is collected is bounded by both.

    Null labels and ids are left out; of repeated labels the largest counts, of several texts of one id the shortest, then the first in
    order;
    null texts are empty.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    own = own.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toArrow()  # ids and labels only: bounded by ``rows``
    spark = documents.sparkSession
    picked = F.broadcast(spark.createDataFrame(chosen.to_pandas().rename(columns={"doc_id": "_id"}), "_id long, toxic int"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = texts.join(picked, texts["doc_id"] == picked["_id"])
    sizes = own.groupBy("doc_id").agg(F.min(F.char_length("text").cast("long")).alias("n"), F.count(F.lit(1)).alias("times")).toArrow().to_pylist()
    order = {x: i for i, x in enumerate(chosen.column("doc_id").to_pylist())}
    within, total = [], 0
    for r in sorted(sizes, key=lambda r: order[r["doc_id"]]):
        total += r["n"]
        if within and total > chars:
            break
        within.append(r["doc_id"])
    kept = F.broadcast(spark.createDataFrame([(x,) for x in within], "_kept long"))  # at most ``rows`` ids
    found = own.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi")
    if any(r["times"] > 1 for r in sizes):
        # of several texts of one id the shortest, of these the first in order: a text's size is what was counted
        found = found.groupBy("doc_id").agg(F.min(F.struct(F.char_length("text").alias("n"), "text")).alias("x"), F.first("toxic").alias("toxic")).select("doc_id", "x.text", "toxic")
    found = found.select("doc_id", "text", "toxic").toArrow().to_pylist()
    found.sort(key=lambda r: r["doc_id"])
    return fit([(r["text"], int(r["toxic"] > 0)) for r in found])


def _scores(model: Model, batch: pa.RecordBatch):
    scores = [model.score(t) for t in texts_of(batch)]
    columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    held_out: crc32 of the id as text is a multiple of 5 (null for a null id). A null or empty text is scored as one without
    hits. Repeated rows get the same score; other columns are not read; an empty table gives no rows.
    """
    own = text_frame(df, id_col, text_col).withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return map_batches(own, partial(_scores, model), "doc_id long, held_out boolean, score double, predicted int")


def _clean(model: Model, text_col: str, limit: float, batch: pa.RecordBatch):
    yield batch.filter(pa.array([model.score(t) < limit for t in texts_of(batch, text_col)]))


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows scored below ``limit``, all columns as they are, whatever they are called. A null text is scored as an empty
    one; repeated rows are judged alike; an empty table gives no rows."""
    from pyspark.sql.types import StructType

    schema: StructType = df.schema
    return map_batches(df, partial(_clean, model, text_col, limit), schema)
