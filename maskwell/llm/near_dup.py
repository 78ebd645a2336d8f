"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles is sketched into REGISTERS registers. Register i holds floor(1 - log_b m), cut off to
[0, q + 1], where m is the minimum over the set of exponentially distributed hashes: exponentially spaced, truncated
minima. Sketches of parts merge by the elementwise maximum, and two registers are equal with a probability near the
Jaccard similarity, so that bands of register values find candidates. A candidate's similarity is then estimated from all
registers jointly by maximum likelihood with the known set sizes; a pair goes on unless the likelihood ratio excludes the
threshold at about five sigma. What goes on is verified on the full sets.

Equal sets are collapsed into one node first, so copies cost nothing more. A bucket is compared with its smallest node, not
pair by pair. Nodes that are still apart after that, though they share a bucket, are compared in blocks by their sketches,
so no link is lost to the choice of the smallest. Components are found by contraction; each step is written to the shared
folder. Nothing is collected to the driver.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, map_batches, parts, scratch, texts_of
from ._linking import link

#: Bands of ROWS registers each: at similarity 0.8 a pair shares no band with probability (1 - 0.8 ** 3) ** 24 < 4e-8.
BANDS, ROWS = 24, 3
REGISTERS = BANDS * ROWS
#: Base, rate and largest register value of the sketch.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Log-likelihood that a pair may lose by a similarity of the threshold against its best one: five sigma.
SLACK = 12.5
#: Equal registers that a pair at the threshold has: fewer with a probability under 1e-6, as they are binomial from 0.8 on.
FEWEST_EQUAL = 40
STEP_CHARS = 2_000_000

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_POLY = int(_rng.integers(1 << 62)) * 2 + 1
_POLY_INVERSE = pow(_POLY, -1, 1 << 64)
_PLACE = (_rng.integers(1 << 62, size=64).astype(_U) << _U(1)) | _U(1)
_A = (_rng.integers(1 << 62, size=REGISTERS).astype(_U) << _U(1)) | _U(1)
_B = _rng.integers(1 << 63, size=REGISTERS).astype(_U)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = np.ones(1, _U)
_inverse_powers = np.ones(1, _U)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse_powers
    if len(_powers) < n:
        for name, base in (("_powers", _POLY), ("_inverse_powers", _POLY_INVERSE)):
            steps = np.full(n, base, _U)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=_U)
    return _powers, _inverse_powers


def hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in some bytes, and where each starts. Words are runs without blank, tab, line feed, vertical
    tab, form feed and carriage return."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_GAP[data]
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], dtype=_U, out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U)), starts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and the index of each text's first word, the number of words last."""
    raw = [t.encode().lower() for t in texts]
    hashes, starts = hashed_words(np.frombuffer(b" ".join(raw) + b" ", np.uint8))
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``k`` words; fewer words are one shingle, none is empty."""
    hashes, at = word_hashes(texts)
    n = len(hashes)
    rolled = np.zeros(max(n - k + 1, 0), _U)
    for i in range(k):
        rolled += _mix(hashes[i : n - k + 1 + i] ^ _PLACE[i]) * _PLACE[i] if n >= k else _U(0)
    rolled = _mix(rolled)
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            short = sum(int(x) * int(p) for x, p in zip(_mix(hashes[a:b] ^ _PLACE[: b - a]), _PLACE)) + (b - a)
            out.append(_mix(np.array([short & (2**64 - 1)], _U)))
        else:
            out.append(hashes[:0])
    return out


def sketch(elements: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set of 64-bit hashes."""
    low = np.full(REGISTERS, 2**64 - 1, _U)
    for a in range(0, len(elements), 4096):
        low = np.minimum(low, (elements[a : a + 4096, None] * _A + _B).min(axis=0))
    least = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(least, 1e-300)) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge_sketches(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum.reduce(sketches)


_GRID = np.linspace(0.0, 1.0, 101)


def estimate(na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood similarity of pairs of sets of known sizes, where ``more`` registers of the first are larger and
    ``less`` smaller; and whether the threshold is within SLACK of the best likelihood."""
    na, nb, more, less = (np.asarray(x, np.float64)[:, None] for x in (na, nb, more, less))
    u, v = na / (na + nb), nb / (na + nb)
    scale = (BASE - 1) / BASE

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-9, 1) * scale) / np.log(BASE)

    above, below = chance(u - v * _GRID), chance(v - u * _GRID)
    value = more * np.log(above) + less * np.log(below) + (REGISTERS - more - less) * np.log(np.maximum(1 - above - below, 1e-9))
    value = np.where(np.minimum(u / v, v / u) + 1e-9 >= _GRID, value, -np.inf)
    at_threshold = value[:, _GRID >= threshold - 1e-9].max(axis=1)
    return _GRID[value.argmax(axis=1)], at_threshold >= value.max(axis=1) - SLACK


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _prints(k: int, batch: pa.RecordBatch):
    texts = texts_of(batch)
    n, f1, f2, sk = [], [], [], []
    for a, b in parts([len(t) for t in texts], STEP_CHARS):
        for s in shingle_sets(texts[a:b], k):
            n.append(len(s))
            x, y = _fingerprint(s) if len(s) else (None, None)
            f1.append(x)
            f2.append(y)
            sk.append(sketch(s).tobytes() if len(s) else None)
    columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sk, pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "f1", "f2", "sketch"])


class Shingles:
    """Documents as sets of ``k``-word shingles, linked from a Jaccard similarity of numerator / denominator on."""

    dtype, width = "<u2", REGISTERS

    def __init__(self, k: int, numerator: int, denominator: int):
        self.k, self.numerator, self.denominator = k, numerator, denominator

    def keys(self, sketches: np.ndarray) -> np.ndarray:
        r = sketches.reshape(-1, BANDS, ROWS).astype(np.int64)
        return (np.arange(BANDS, dtype=np.int64) << 48) | (r[:, :, 0] << 32) | (r[:, :, 1] << 16) | r[:, :, 2]

    def possible(self, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        return np.minimum(na, nb) * self.denominator >= np.maximum(na, nb) * self.numerator

    def likely(self, na: np.ndarray, a: np.ndarray, nb: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return estimate(na, nb, (a > b).sum(axis=1), (a < b).sum(axis=1), self.numerator / self.denominator)

    def close(self, na: np.ndarray, a: np.ndarray, nb: np.ndarray, b: np.ndarray) -> np.ndarray:
        equal = np.zeros((len(a), len(b)), np.uint8)
        for i in range(REGISTERS):
            equal += a[:, i, None] == b[None, :, i]
        return (equal >= FEWEST_EQUAL) & self.possible(na[:, None], nb[None, :])

    def links(self, left: list[bytes], right: list[bytes], open_pair) -> list[tuple[int, int]]:
        """By one matrix product over the hashes that both sides have, so that every pair gets its exact intersection."""
        a, b = ([np.frombuffer(x, _U) for x in side] for side in (left, right))
        shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
        common = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, len(shared), 4096):
            own = shared[at : at + 4096]
            ma, mb = (self._membership(side, own) for side in (a, b))
            common += ma @ mb.T
        na, nb = np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None, :]
        hit = common * self.denominator >= self.numerator * (na + nb - common.astype(np.int64))
        return [(i, j) for i, j in zip(*np.nonzero(hit)) if open_pair.join(i, j)]

    @staticmethod
    def _membership(sets: list[np.ndarray], own: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(own)), np.float32)
        for i, s in enumerate(sets):
            at = np.searchsorted(own, s)
            at[at == len(own)] = 0
            out[i, at[own[at] == s]] = 1
        return out

    def payloads(self, texts: list[str], wanted: list[list[tuple[int, int]]]) -> list[list[bytes | None]]:
        out = []
        for a, b in parts([len(t) for t in texts], STEP_CHARS):
            for s, own in zip(shingle_sets(texts[a:b], self.k), wanted[a:b]):
                found = _fingerprint(s) if len(s) else None
                out.append([s.tobytes() if x == found else None for x in own])
        return out

    def linked(self, hub: bytes, other: bytes) -> bool:
        h, s = np.frombuffer(hub, _U), np.frombuffer(other, _U)
        if min(len(s), len(h)) * self.denominator < self.numerator * max(len(s), len(h)):
            return False
        both = np.sort(np.concatenate([h, s]), kind="stable")  # two sorted runs
        common = int((both[1:] == both[:-1]).sum())
        return common * self.denominator >= self.numerator * (len(s) + len(h) - common)


def _nodes(prints: DataFrame) -> DataFrame:
    """One node for each distinct set, with its smallest doc_id."""
    own = prints.filter("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("doc"), F.min("n").alias("n"), F.first("sketch").alias("sketch"))
    return cut(own.withColumn("node", F.monotonically_increasing_id()), "nodes")


def near_duplicates(df: DataFrame, k: int = 5, numerator: int = 80, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents are linked if denominator * |intersection| >= numerator * |union| of their sets of ``k``-word shingles.
    component_id is the smallest doc_id that links reach, itself included; kept marks the row whose id that is. Empty texts
    and nulls have no shingles and stand alone. Repeated rows get the same answer each; rows of one id with different texts
    are judged each by its text. A null id can be linked but never names a component unless all its ids are null.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scratch(df.sparkSession) as keep:
        prints = cut(map_batches(docs, partial(_prints, k), "doc_id long, n long, f1 long, f2 long, sketch binary"), "prints")
        nodes = _nodes(prints)
        comps = link(Shingles(k, numerator, denominator), docs, nodes)
        of_node = nodes.select("node", "f1", "f2", "doc").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = cut(of_node.groupBy("comp").agg(F.min("doc").alias("component_id")), "least")
        named = keep(cut(of_node.join(least, "comp").select("f1", "f2", "component_id"), "named"))
        keep(prints)
    rows = prints.select("doc_id", "n", "f1", "f2")
    linked = rows.filter("n > 0").join(named, ["f1", "f2"]).select("doc_id", "n", "component_id")
    alone = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(df: DataFrame, k: int = 5, numerator: int = 80, denominator: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, all columns as they are.

    Repeated rows of one id and text become one. Rows of a null id stay only if their group has no id at all.
    """
    with scratch(df.sparkSession) as keep:
        verdict = near_duplicates(df, k, numerator, denominator, id_col, text_col).filter("kept").select("doc_id").distinct()
        verdict = keep(cut(verdict, "kept")).toDF("_kept_id")
    kept = df.join(verdict, F.col(id_col).cast("long").eqNullSafe(F.col("_kept_id")), "left_semi")
    return kept.dropDuplicates([id_col, text_col])


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT k, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS g
  FROM w),
nodes AS (SELECT list_sort(g) AS g, min(doc_id) AS doc, len(any_value(g)) AS n FROM s WHERE len(g) > 0 GROUP BY list_sort(g)),
e AS (SELECT doc, n, unnest(g) AS x FROM nodes),
links AS (
  SELECT p.doc AS a, q.doc AS b FROM e p JOIN e q ON p.x = q.x AND p.doc <> q.doc
  GROUP BY p.doc, q.doc, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach(a, b) AS (SELECT doc, doc FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS doc, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, coalesce(c.component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN nodes n ON list_sort(s.g) = n.g LEFT JOIN comp c ON c.doc = n.doc
"""
