"""Fuzzy line deduplication over a whole corpus.

Lines are normalised (lower case, ASCII punctuation as blanks, unspaced scripts as single characters) and equal ones become
one node with parities of its words. Two lines are linked from an edit similarity of SIMILARITY on: one minus
the edits of words over the words of the longer line. Each connected group keeps its first occurrence, by document id and
line; all others are removed from their texts.

Candidates come by the pigeonhole principle on words: lines meet by runs of two words, of which one line alone has to give a
share. An edit destroys two at most, so that more than 0.4 n of the runs of a line of n words can't all be destroyed. Each line
gives those that come first in one order of all runs, rare ones first. Of two linked lines take the one whose runs end first in
that order: one of its runs is left in the other, and stands among the other's own. So no link is lost, whatever the order is.
How few lines meet by chance hangs on the order: a run counts as frequent as its two words make likely, or as it is seen to be
where its counter stands out. Counters of runs alone don't tell rare runs apart once there are more runs than counters.
Blocks of SimHash bits can't do that: at this similarity a fifth of the bits differs, so that a block that is wide enough to tell
lines apart is hardly ever equal.

Of the pairs that meet those are verified which the parities of their words can't rule out: each edit changes two of the
PARITIES bits at most, so that no link is lost. A SimHash of BITS bits says in which order: first the nearest pair of each line,
and of all others only those whose lines are not in one group by then.

Keys travel as packed arrays. Up to SMALL lines of one key all pairs whose sizes and places allow a link leave the task; in larger
groups a forest of the likely ones, and after that, among the lines of pairs that the forest left out, all likely pairs that
are still in different components.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, discard, give_back, map_batches, narrow_batches, parts, release, scratch, texts_of
from ._linking import FILTER_BUCKETS, Roots, apart, components, united
from .near_dup import _mix
from .quality import bind

#: Shorter lines are similar by chance: only equal ones may be one group.
MIN_WORDS = 4
#: Edit similarity of two lines of one group: 1 - edits / words of the longer line. Not below 0.8, which the runs need.
SIMILARITY = 0.8
BITS = 128
#: Bits that linked lines differ in, at most: four sigma above the mean of lines at the threshold.
FAR = 44
#: Bits of a line of which each says whether the number of words that fall to it is odd.
PARITIES = 256
#: Words of a run, and runs of a line that are its keys.
RUN, RUNS = 3, 16
#: Words of the shortest line that may be linked with a different one: of fewer words, 0.8 leaves no edit.
LEAST = 4
#: A place or a number of words that 16 bits can't hold, or that isn't known.
OPEN = 65535
#: Counters of runs, and as many of words, by their hash. What shares one counts together, which changes only the order that
#: runs are taken in. Each kind travels in CHUNKS rows.
COUNTERS = 1 << 20
CHUNKS = 64
#: A run is frequent if its counter is beyond both this number and so many times the mean counter.
FREQUENT, FREQUENT_SHARE = 64, 8
#: Characters that are normalised and hashed together.
STEP_CHARS = 400_000
#: Keys of one packed array, of all that a task holds before it sends them, and of one part, about.
BLOB, HELD, PART = 5_000, 1 << 20, 1 << 23
#: Lines of one key of which all pairs may be verified, and lines that are compared in one group.
SMALL, BLOCK = 32, 2048
_U = np.uint64
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], _U)
_ODD = 0x9E3779B97F4A7C15
#: Longer words are hashed one by one, shorter ones eight bytes at a time for all words at once.
_LONG = 64
#: What is left of eight bytes for a word of so many.
_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)
_ZSTD = pa.Codec("zstd", compression_level=1)
_BLANK = bytes(32 if 32 < c < 127 and not chr(c).isalnum() else c for c in range(256))
_LOWER = _BLANK.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
_LATIN_LOWER = _LOWER[:128] + bytes(range(128, 256)).decode("latin-1").lower().encode("latin-1")

#: Each byte's bits as eight counters of one byte, the highest bit first.
_COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(_U).ravel()

#: Characters of scripts that are written without blanks: Thai to Tibetan, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("([฀-࿿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff])")


def normalised(text: str) -> bytes:
    """The text with the same \\n-split lines, words in lower case and between blanks."""
    if text.isascii():
        return text.encode().translate(_LOWER)
    try:  # Latin-1 has one byte a character, and no unspaced script
        return text.encode("latin-1").translate(_LATIN_LOWER).decode("latin-1").encode()
    except UnicodeEncodeError:
        return _UNSPACED.sub(r" \1 ", text).lower().encode(errors="replace").translate(_LOWER)


def edits(n, similarity: float):
    """Edits that a line of ``n`` words may be away from one that isn't longer."""
    return np.floor((1 - similarity) * np.asarray(n) + 1e-9).astype(np.int64)


def edit_distance(a: list, b: list, limit: int) -> int:
    """Edits (insert, delete, replace) that turn ``a`` into ``b``, or limit + 1 if more. Work grows with the edits found
    and not with the product of the lengths: for each number of edits the furthest place on each diagonal."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    n, m = len(a), len(b)
    far = {0: 0}
    if n == m == 0:
        return 0
    for d in range(1, limit + 1):
        new = {}
        for k in range(-d, d + 1):
            x = max(far.get(k, -2) + 1, far.get(k - 1, -2) + 1, far.get(k + 1, -2))
            x = min(x, n, m + k) if x >= 0 else x
            if x < 0 or x - k < 0:
                continue
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            new[k] = x
            if x == n and y == m:
                return d
        far = new
    return limit + 1


class Line:
    """The words of a line, prepared for comparisons."""

    __slots__ = ("words", "_distinct")

    def __init__(self, payload: bytes):
        self.words, self._distinct = payload.split(), None

    @property
    def distinct(self) -> set[bytes]:
        if self._distinct is None:
            self._distinct = set(self.words)
        return self._distinct

    @property
    def repeats(self) -> int:
        return len(self.words) - len(self.distinct)


def _few_edits(a: list, b: list, most: int) -> bool:
    """Whether one pass from left to right turns ``a`` into ``b`` by ``most`` edits: if so they are no further apart."""
    n, m, i, j, spent = len(a), len(b), 0, 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        spent += 1
        if spent > most:
            return False
        if i + 1 < n and a[i + 1] == b[j] and not (j + 1 < m and a[i + 1] == b[j + 1]):
            i += 1
        elif j + 1 < m and a[i] == b[j + 1] and not (i + 1 < n and a[i + 1] == b[j + 1]):
            j += 1
        else:
            i, j = i + 1, j + 1
    return spent + n - i + m - j <= most


def similar(a: Line, b: Line, similarity: float) -> bool:
    """Whether two lines are linked."""
    longest = max(len(a.words), len(b.words))
    most = int((1 - similarity) * longest + 1e-9)
    if abs(len(a.words) - len(b.words)) > most:
        return False
    # most of those that meet are linked, and that is seen at once
    if len(a.words) == len(b.words) and sum(map(bytes.__ne__, a.words, b.words)) <= most or _few_edits(a.words, b.words, most):
        return True
    # words in common, at most: distinct ones, and repeats on both sides
    if len(a.distinct & b.distinct) + min(a.repeats, b.repeats) < longest - most:
        return False
    return (Counter(a.words) & Counter(b.words)).total() >= longest - most and edit_distance(a.words, b.words, most) <= most


def _hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words in some bytes, where each starts, and the places of line feeds. Words are runs without blank,
    tab, line feed, vertical tab, form feed and carriage return. Work follows the words and not their bytes."""
    data = np.frombuffer(raw, np.uint8)
    word = np.zeros(len(data) + 2, bool)
    np.logical_and(data != 32, data - np.uint8(9) > 4, out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    aligned = np.frombuffer(raw + bytes(24 - len(raw) % 8), "<u8")

    def eight(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Eight bytes from each place on, zeros for those beyond what is left of the word."""
        own, shift = at >> 3, (at & 7).astype(_U) << _U(3)
        return (aligned[own] >> shift | aligned[own + 1] << _U(1) << (_U(63) - shift)) & _BYTES[np.minimum(left, 8)]

    hashes = _mix(eight(starts, sizes) + sizes.astype(_U) * _U(_ODD))
    here = np.flatnonzero(sizes > 8)
    for i in here[sizes[here] > _LONG].tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : starts[i] + sizes[i]], digest_size=8).digest(), "little")
    here = here[sizes[here] <= _LONG]
    done = 8
    while len(here):
        hashes[here] = _mix(hashes[here] * _U(_ODD) + eight(starts[here] + done, sizes[here] - done))
        done += 8
        here = here[sizes[here] > done]
    return hashes, starts, np.flatnonzero(data == 10)


def _counter(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` counters each hash falls to."""
    return (hashes & _U(n - 1) if n & (n - 1) == 0 else hashes % _U(n)).astype(np.int64)


class Words:
    """The words of normalised texts: 64-bit hashes, and line by line where they start. Lines without words are left out."""

    def __init__(self, raw: bytes):
        self.hashes, starts, self.breaks = _hashed_words(raw)
        sizes = np.diff(np.searchsorted(starts, self.breaks), prepend=0, append=len(starts))
        self.lines = np.flatnonzero(sizes)
        self.sizes = sizes[self.lines]
        self.at = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(starts)) - np.repeat(self.at, self.sizes)

    def fingerprints(self, number: int = 2) -> tuple[np.ndarray, ...]:
        """Two 64-bit hashes of each line's words in their order, or the first one."""
        powers = np.full(int(self.sizes.max(initial=0)) + 1, _ODD, _U)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=_U)[self.place]
        return tuple(_mix(np.add.reduceat(_mix(self.hashes ^ s) * powers, self.at) + self.sizes.astype(_U)).view(np.int64) for s in _SALT[:number])

    def simhashes(self) -> np.ndarray:
        """BITS bits of each line, as rows of 64-bit numbers."""
        out = np.empty((len(self.at), BITS // 8), np.uint8)
        for a, b in parts(self.sizes.tolist(), 20_000):
            sizes, own = self.sizes[a:b], self.hashes[self.at[a] : self.at[b - 1] + self.sizes[b - 1]]
            counters = _COUNTERS[_mix(own[:, None] ^ _SALT).view(np.uint8)]
            # counters hold up to 255 words; longer lines are summed in pieces
            pieces = -(-sizes // 255)
            line_of = np.repeat(np.arange(b - a), pieces)
            starts = (self.at[a:b] - self.at[a])[line_of] + 255 * (np.arange(len(line_of)) - (np.cumsum(pieces) - pieces)[line_of])
            ones = np.add.reduceat(counters, starts, axis=0).view(np.uint8)
            if len(line_of) > b - a:
                ones = np.add.reduceat(ones, np.cumsum(pieces) - pieces, axis=0, dtype=np.int64)
            out[a:b] = np.packbits(2 * ones.astype(np.int64) > sizes[:, None], axis=1)
        return out.view(_U)

    def parities(self) -> np.ndarray:
        """PARITIES bits of each line, as rows of 64-bit numbers."""
        own = _mix(self.hashes ^ _SALT[1])
        which, bit = own >> _U(32) & _U(PARITIES // 64 - 1), _U(1) << (own & _U(63))
        return np.stack([np.bitwise_xor.reduceat(np.where(which == _U(i), bit, _U(0)), self.at) for i in range(PARITIES // 64)], axis=1)

    def runs(self, k: int, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lines, of those that fit, and the hashes of all runs of ``k`` words."""
        own, line = self._starts(k, fits)
        return line, self._hashed(k, own)

    def _starts(self, k: int, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.repeat(fits, self.sizes)
        for i in range(k - 1):  # none starts at the last words of a line
            start[(self.at + self.sizes - 1 - i)[self.sizes > i]] = False
        own = np.flatnonzero(start)
        return own, np.repeat(np.arange(len(self.at)), self.sizes)[own]

    def _hashed(self, k: int, own: np.ndarray) -> np.ndarray:
        key = np.full(len(own), k, _U)
        for i in range(k):
            key = _mix(key * _U(_ODD) + self.hashes[own + i])
        return key

    def prefixes(self, rarity: np.ndarray, min_words: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the lines of LEAST words or more, and the runs of two words that each needs: more than 0.4 n of them,
        the first in the order of all runs, and where they stand in their line. ``words`` has the shares of words in a run's
        rank, by their hash."""
        fits = self.sizes >= max(LEAST, min_words)
        own, line = self._starts(2, fits)
        if not len(own):
            return line, self.hashes[:0], line
        key = self._hashed(2, own)
        rank = rarity[_counter(key, len(rarity))]
        if words is not None:
            share = words[_counter(self.hashes, len(words))]
            rank = np.maximum(rank, np.clip(share[own] + share[own + 1], 0, 255).astype(np.uint8))
        # line, rank, bits of the key and place in one number: sorting numbers takes half the time of sorting places by them.
        # Fewer bits of the key only make more runs tie, and those that tie are all kept, so the order is one for all lines
        low = len(own).bit_length()
        bits = min(32, 56 - low - len(self.at).bit_length())
        at = ((line.astype(_U) << _U(8) | rank) << _U(max(bits, 0))) | key >> _U(64 - max(bits, 1))
        if bits >= 12:
            at = np.sort(at << _U(low) | np.arange(len(own), dtype=_U))
            order, at = (at & _U((1 << low) - 1)).astype(np.int64), at >> _U(low)
        else:
            at = line.astype(_U) << _U(40) | rank.astype(_U) << _U(32) | key >> _U(32)
            order = np.argsort(at)
            at = at[order]
        # runs that tie with the last one belong to it
        sizes = self.sizes[fits]
        last = at[np.cumsum(sizes - 1) - (sizes - 1) + 2 * sizes // 5]
        order = order[at <= np.repeat(last, sizes - 1)]
        return line[order], _mix(key[order] ^ _SALT[0]), self.place[own[order]]

    def keys(self, ranks: np.ndarray, min_words: int, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the lines (of up to ``longest`` words), and a key for each: RUNS runs by hash, frequent ones last."""
        places, keys = [], []
        most = self.sizes.max(initial=0) if longest is None else longest
        for k, fits in ((RUN, (self.sizes >= max(RUN, min_words)) & (self.sizes <= most)), (2, (self.sizes >= max(2, min_words)) & (self.sizes <= RUN + 2))):
            line, key = self.runs(k, fits)
            rank = ranks[_counter(key, len(ranks))]
            order = np.argsort(line.astype(_U) << _U(40) | rank.astype(_U) << _U(32) | key >> _U(32))
            line = line[order]
            keep = np.arange(len(line)) - np.searchsorted(line, line) < RUNS
            places.append(line[keep])
            keys.append(key[order][keep])
        return np.concatenate(places), np.concatenate(keys)


_LINES = [("doc_id", pa.int64()), ("mark", pa.int64()), ("line", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("n", pa.int32()), ("p0", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("p3", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())]
#: The parities of a line, and its SimHash, which only lines of pairs have.
_SKETCH, _SIMHASH = ["p0", "p1", "p2", "p3"], ["s0", "s1"]


def _table(fields: list, columns: dict, rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[n] if n in columns else pa.nulls(rows, t) for n, t in fields], [n for n, _ in fields])


def _words(batches):
    """Batches piece by piece: the batch, its rows a to b, their normalised texts in one, and the words of these."""
    for batch in batches:
        texts = [normalised(t) for t in texts_of(batch)]
        for a, b in parts([len(t) for t in texts], STEP_CHARS):
            raw = b"\n".join(texts[a:b]) + b"\n"
            w = Words(raw)
            if len(w.at):
                yield batch, a, b, texts[a:b], raw, w
    give_back()


def _line_rows(batches):
    """A row for each line that has words, and at the end the counters of all runs and words, in CHUNKS rows each."""
    counts = np.zeros((2, COUNTERS), np.uint32)
    held: list[list[np.ndarray]] = [[], []]

    def count():
        for i, own in enumerate(held):
            if own:
                counts[i] += np.bincount(np.concatenate(own), minlength=COUNTERS).astype(np.uint32)
            own.clear()

    for batch, a, b, texts, _, w in _words(batches):
        ids, marks = (batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
        missing = batch.column("doc_id").slice(a, b - a).is_null().to_numpy(zero_copy_only=False)
        for own, counted in zip(held, (w.runs(2, w.sizes >= LEAST)[1], w.hashes)):
            own.append(_counter(counted, COUNTERS))
        if sum(map(len, held[1])) > 2 * COUNTERS:
            count()
        ends = np.cumsum([t.count(b"\n") + 1 for t in texts])
        doc = np.searchsorted(ends, w.lines, side="right")
        f1, f2 = w.fingerprints()
        sketches = w.parities().view(np.int64)
        yield _table(_LINES, {
            "doc_id": pa.array(ids[doc].astype(np.int64), mask=missing[doc]), "mark": pa.array(marks[doc]), "line": pa.array((w.lines - np.append(0, ends)[doc]).astype(np.int32)),
            "f1": pa.array(f1), "f2": pa.array(f2), "n": pa.array(w.sizes.astype(np.int32)), **{c: pa.array(sketches[:, i]) for i, c in enumerate(_SKETCH)},
        }, len(w.at))
    count()
    if counts.any():
        yield _table(_LINES, {"chunk": pa.array(np.arange(2 * CHUNKS, dtype=np.int32)), "counts": pa.array([x.tobytes() for x in np.split(counts.ravel(), 2 * CHUNKS)], pa.binary())}, 2 * CHUNKS)


def _payloads(min_words: int, wanted: np.ndarray, batches):
    """The nodes of lines, their sizes and their normalised words, of nodes that fall into a bucket that is wanted (packed bits)."""
    wanted = np.unpackbits(wanted).astype(bool)
    for _, _, _, _, raw, w in _words(batches):
        # a line's payload goes up to the next line that has words; what is between are blanks
        offsets = np.append(np.append(0, w.breaks + 1)[w.lines], len(raw)).astype(np.int32)
        payload = pa.Array.from_buffers(pa.binary(), len(w.at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
        node = w.fingerprints(1)[0]
        keep = pa.array((w.sizes >= min_words) & wanted[node & (FILTER_BUCKETS - 1)])
        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (pa.array(node), pa.array(w.sizes.astype(np.int32)), payload)], ["node", "n", "payload"])


def _sketched(batch: pa.RecordBatch):
    """The nodes with the SimHash of their payloads."""
    sims = Words(b"\n".join(x.replace(b"\n", b" ") for x in batch.column("payload").to_pylist()) + b"\n").simhashes().view(np.int64)
    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sims[:, 0]), pa.array(sims[:, 1])], [*batch.schema.names, *_SIMHASH])


def _summed(batches):
    """The sum of each chunk's counters; rows are sorted by chunk."""
    now, total = None, None
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            if chunk != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])
                now, total = chunk, np.zeros(COUNTERS // CHUNKS, np.uint64)
            total += np.frombuffer(counts, np.uint32)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])


def frequency_ranks(counts: np.ndarray) -> np.ndarray:
    """0 for counters up to FREQUENT and FREQUENT_SHARE times their mean, then one more with each doubling."""
    usual = max(FREQUENT, FREQUENT_SHARE * counts.mean())
    return np.clip(np.ceil(np.log2(np.maximum(counts, 1) / usual)), 0, 100).astype(np.uint8)


def rarity(counts: np.ndarray) -> np.ndarray:
    """Ranks of runs by their counters, four for each doubling, rare ones first. Only a counter that stands out, by twice the mean
    of all, says something about its run; the others are 0."""
    mean = counts.mean()
    return np.where(counts > 2 * mean, np.clip(np.ceil(4 * np.log2(np.maximum(counts - mean, 1))) + 48, 0, 255), 0).astype(np.uint8)


def shares(counts: np.ndarray) -> np.ndarray:
    """What each word adds to a run's rank: two shares together rank the number of such runs among independent words, as
    rarity() does, from 2 ** -12 on."""
    return np.round(4 * np.log2(np.maximum(counts, 1)) - 2 * np.log2(max(counts.sum(), 1)) + 24).astype(np.int16)


def _counts(lines: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often runs and words stand in the corpus: COUNTERS numbers each, whatever the data."""
    dealt = lines.filter("chunk is not null").select("chunk", "counts").repartition(CHUNKS, "chunk").sortWithinPartitions("chunk")
    counts = np.zeros((2 * CHUNKS, COUNTERS // CHUNKS), np.uint64)
    for row in dealt.mapInArrow(_summed, "chunk int, counts binary").toArrow().to_pylist():
        counts[row["chunk"]] = np.frombuffer(row["counts"], np.uint64)
    runs, words = counts.reshape(2, -1).astype(np.float64)
    return runs, words


def _blob(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> bytes:
    """Sorted 32-bit keys, 64-bit nodes and 16-bit sizes and places; all but the nodes as planes of bytes, compressed."""
    planes = [x.view(np.uint8).reshape(len(keys), -1).T.tobytes() for x in (np.diff(keys, prepend=keys[:1]), sizes, at)]
    small = _ZSTD.compress(b"".join(planes), asbytes=True)
    return np.array([len(keys), len(small), keys[0]], "<u4").tobytes() + small + nodes.tobytes()


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, small, first = np.frombuffer(blob, "<u4", 3).tolist()
    planes = np.frombuffer(_ZSTD.decompress(blob[12 : 12 + small], 8 * n, asbytes=True), np.uint8).reshape(8, n)
    keys, sizes, at = (np.ascontiguousarray(planes[i:j].T).view(t).ravel() for i, j, t in ((0, 4, "<u4"), (4, 6, "<u2"), (6, 8, "<u2")))
    return np.cumsum(keys, dtype=np.uint32) + np.uint32(first), np.frombuffer(blob, "<i8", n, 12 + small), sizes, at


def _packed(order_of: np.ndarray, of_words: np.ndarray, min_words: int, n_parts: int, batches):
    """The keys of lines as arrays for each part: 32-bit keys, 64-bit nodes, and the lines' words and the runs' places in 16 bits."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def sent():
        keys, nodes, sizes, at = (np.concatenate(x) for x in zip(*held))
        held.clear()
        both = sizes.astype("<u4") << np.uint32(16) | at.astype("<u4")
        part = ((keys >> _U(32)).astype(np.uint32) % np.uint32(n_parts)).astype(_U)
        low = len(keys).bit_length()  # the lowest bits of a key give way to its place: order within a part only serves compression
        order = (np.sort((part << _U(32) | keys & _U(0xFFFFFFFF)) >> _U(max(0, low + n_parts.bit_length() - 32)) << _U(low) | np.arange(len(keys), dtype=_U)) & _U((1 << low) - 1)).astype(np.int64)
        keys, nodes, both, part = keys.astype("<u4")[order], nodes[order], both[order], part.astype(np.int32)[order]
        sizes, at = (both >> np.uint32(16)).astype("<u2"), both.astype("<u2")
        ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)).tolist()
        places = [(x, min(x + BLOB, j)) for i, j in zip([0, *ends], ends) for x in range(i, j, BLOB)]
        blobs = [_blob(keys[a:b], nodes[a:b], sizes[a:b], at[a:b]) for a, b in places]
        return pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a, _ in places], pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    for _, _, _, _, _, w in _words(batches):
        places, keys, at = w.prefixes(order_of, min_words, of_words)
        if len(keys):
            held.append((keys, w.fingerprints(1)[0][places], np.minimum(w.sizes[places], OPEN), np.minimum(at, OPEN)))
        if sum(len(x[0]) for x in held) > HELD:
            yield sent()
    if held:
        yield sent()


def _fitting(n, m, i, j, similarity: float) -> np.ndarray:
    """Whether lines of ``n`` and ``m`` words, n <= m, may be linked that have the run in common which stands at ``i`` and
    ``j``: what is before and what is behind it differ by so many words at least."""
    known = (i < OPEN) & (j < OPEN) & (m < OPEN)
    return ~known | (np.abs(i - j) + np.abs((n - i) - (m - j)) <= edits(m, similarity))


def _sorted_places(keys: np.ndarray) -> np.ndarray:
    """The places of 32-bit keys in the order of these; sorting numbers that hold both takes a fraction of an argsort()."""
    return (np.sort(keys.astype(_U) << _U(32) | np.arange(len(keys), dtype=_U)) & _U(0xFFFFFFFF)).astype(np.int64)


def _shared(similarity: float, batches):
    """Of sorted parts, what meets by a key. Rows (a, b) of nodes whose sizes and places allow a link, and for a key of more than
    SMALL rows its nodes, as rows (a, key, m) with the number of them."""
    now, held = None, []

    def met():
        keys, nodes, sizes, at = (np.concatenate(x) for x in zip(*held))
        order = _sorted_places(keys)
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        keep = np.append(same, False) | np.append(False, same)
        order, keys = order[keep], keys[keep]
        nodes, sizes, at = nodes[order], sizes[order].astype(np.int64), at[order].astype(np.int64)
        # copies of a line count once; what stands between two of them by chance only leaves one in
        order = np.argsort(keys.astype(_U) << _U(32) | _mix(nodes.view(_U) + at.astype(_U) * _U(_ODD)) >> _U(32))
        keys, nodes, sizes, at = keys[order], nodes[order], sizes[order], at[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]) | (at[1:] != at[:-1]))[: len(keys)]
        keys, nodes, sizes, at = keys[new], nodes[new], sizes[new], at[new]
        order = np.argsort(keys.astype(np.int64) << 16 | sizes)
        keys, nodes, sizes, at = keys[order], nodes[order], sizes[order], at[order]
        ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))[: len(keys)]
        counts = np.diff(np.append(0, ends))
        end, large = np.repeat(ends, counts), np.repeat(counts > SMALL, counts)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        here, d = np.flatnonzero(~large), 1
        while len(here):
            here = here[here + d < end[here]]
            here = here[sizes[here] >= similarity * sizes[here + d] - 1e-9]  # partners only get longer
            own = here[_fitting(sizes[here], sizes[here + d], at[here], at[here + d], similarity) & (nodes[here] != nodes[here + d])]
            a.append(np.minimum(nodes[own], nodes[own + d]))
            b.append(np.maximum(nodes[own], nodes[own + d]))
            d += 1
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.argsort(_mix(a.view(_U) * _U(_ODD) + b.view(_U)))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        yield _meeting(a[new], b[new], None, None)
        keys, nodes = keys[large], nodes[large]
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))[: len(keys)]
        keys, nodes = keys[new], nodes[new]
        _, of, counts = np.unique(keys, return_inverse=True, return_counts=True)
        yield _meeting(nodes, None, keys.astype(np.int64) | np.int64(now) << 32, counts[of].astype(np.int64))

    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist()):
            if part != now:
                if held:
                    yield from met()
                now, held = part, []
            held.append(_unblob(blob))
    if held:
        yield from met()
    held.clear()
    give_back()


def _meeting(*columns: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), pa.int64()) if c is None else pa.array(c) for c in columns], ["a", "b", "key", "m"])


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16) > FAR


def _unlike(n: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether parities, the last columns, rule a link out for certain, ``n`` being the words of the longer line."""
    odd = np.bitwise_count(a[..., -len(_SKETCH) :] ^ b[..., -len(_SKETCH) :]).sum(axis=-1, dtype=np.int64)
    return odd > 2 * edits(n, similarity)


def _differing(names: list[str]) -> Column:
    """In how many bits the sketches of two lines differ, in a row with both."""
    return sum((F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in names), F.lit(0))


def _not_unlike(similarity: float) -> Column:
    """The opposite of _unlike() by native columns."""
    return _differing(_SKETCH) <= 2 * F.floor((1 - similarity) * F.greatest("x_n", "y_n") + 1e-9)


class _Lines:
    """Lines of payloads, each prepared once it is asked for."""

    def __init__(self, payloads: pd.Series):
        self.payloads, self.known = payloads.tolist(), {}

    def __getitem__(self, i: int) -> Line:
        if i not in self.known:
            self.known[i] = Line(self.payloads[i])
        return self.known[i]


def _blocks_of(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, sizes and parities; where rows have payloads these give the parities."""
    if "payload" in rows:
        sketches = Words(b"\n".join(x.replace(b"\n", b" ") for x in rows["payload"]) + b"\n").parities()
    else:
        sketches = rows[_SKETCH].to_numpy(np.int64).view(_U)
    return rows["node"].to_numpy(), rows["n"].to_numpy(), sketches


def _within(rows: pd.DataFrame, similarity: float) -> tuple[list[tuple[np.ndarray, np.ndarray, bool]], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Pairs of whole groups, sorted by key and n, of one side. Likely ones: all in small groups, a forest in larger ones, and
    (key, node, tree) of the likely pairs that the forest left out. If rows have payloads, a forest of the links between different
    components."""
    node, n, sims = _blocks_of(rows)
    exact = "payload" in rows
    words = _Lines(rows["payload"]) if exact else None
    small = np.zeros(len(node), bool) if exact else rows["m"].to_numpy() <= SMALL
    at = rows[["key", "x", "y"]].to_numpy()
    ends = np.append(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, len(at))
    end = np.repeat(ends, np.diff(np.append(0, ends)))
    ids, root = np.unique(rows["comp" if exact else "node"].to_numpy(), return_inverse=True)
    forest = Roots(len(ids))
    label = forest.flat()
    out, flags = [], []
    here, d = np.arange(len(at)), 1
    while len(here):
        here = here[here + d < end[here]]
        here = here[n[here] >= similarity * n[here + d] - 1e-9]  # partners only get longer
        test = here[label[root[here]] != label[root[here + d]]] if exact else here
        test = test[~_unlike(n[test + d], sims[test], sims[test + d], similarity)]
        own = test[small[test]]
        out.append((node[own], node[own + d], False))
        if not exact:
            united = ~small[test] & (label[root[test]] == label[root[test + d]])
            flags += [test[united], test[united] + d]
            test = test[~united]
        kept, skipped = [], []
        for i in test[~small[test]].tolist():
            if forest.root(root[i]) == forest.root(root[i + d]):
                skipped += [i, i + d]
            elif not exact or similar(words[i], words[i + d], similarity):
                forest.join(root[i], root[i + d])
                kept.append(i)
        if not exact:
            flags.append(np.array(skipped, np.int64))
        if kept:
            own = np.array(kept)
            out.append((node[own], node[own + d], True))
            label = forest.flat()
        d += 1
    own = np.unique(np.concatenate(flags or [np.zeros(0, np.int64)]))
    if not len(own):
        return out, []
    # in a group of several blocks a tree may go on in another block: all of the group is one
    tree = np.where(rows["m"].to_numpy()[own] > BLOCK, -1, ids[label[root[own]]])
    return out, [(at[own, 0], node[own], tree)]


def _across(rows: pd.DataFrame, similarity: float) -> tuple[list[tuple[np.ndarray, np.ndarray, bool]], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The same for two blocks of one large group."""
    exact, side, key = "payload" in rows, rows["side"].to_numpy(), rows["key"].iloc[0]
    left, right = rows[side == 0], rows[side == 1]
    (ia, na, a), (ib, nb, b) = _blocks_of(left), _blocks_of(right)
    wa, wb = (_Lines(r["payload"]) if exact else None for r in (left, right))
    label = "comp" if exact else "node"
    ids, root = np.unique(np.concatenate([left[label].to_numpy(), right[label].to_numpy()]), return_inverse=True)
    forest, kept, flagged = Roots(len(ids)), [], set()
    for i in range(len(ia)):
        near = (np.minimum(na[i], nb) >= similarity * np.maximum(na[i], nb) - 1e-9) & ~_unlike(np.maximum(na[i], nb), a[i], b, similarity)
        for j in np.flatnonzero(near).tolist():
            x, y = root[i], root[len(ia) + j]
            if forest.root(x) == forest.root(y):
                flagged |= {ia[i], ib[j]}
            elif not exact or similar(wa[i], wb[j], similarity):
                forest.join(x, y)
                kept.append((i, j))
    i, j = np.array(kept, np.int64).reshape(-1, 2).T
    # whatever lies in two blocks has to be looked at again: a tree of one block may reach into another
    flagged |= set(ia[i].tolist()) | set(ib[j].tolist())
    return [(ia[i], ib[j], True)], [] if exact else [(np.full(len(flagged), key), np.array(sorted(flagged), np.int64), np.full(len(flagged), -1))]


def _compared(similarity: float, batches):
    """Pairs (a, b) of groups that come one after the other, and (a, key, tree) of nodes whose likely pairs under that
    key, all within a tree, are not all among them; a group may go on in the next batch."""
    def found(rows: pd.DataFrame):
        apart = rows["x"].to_numpy() != rows["y"].to_numpy()
        pairs, flags = _within(rows[~apart], similarity) if not apart.all() else ([], [])
        for _, group in rows[apart].groupby(["key", "x", "y"]):
            more, more_flags = _across(group, similarity)
            pairs, flags = pairs + more, flags + more_flags
        if (~apart).any() and (rows["m"].to_numpy()[~apart] > BLOCK).any():  # of a group of several blocks, all its pairs
            own = rows[~apart & (rows["m"].to_numpy() > BLOCK)]
            inside = np.concatenate([np.concatenate(p[:2]) for p in pairs if p[2]] or [np.zeros(0, np.int64)])
            own = own[np.isin(own["node"].to_numpy(), inside)]
            flags.append((own["key"].to_numpy(), own["node"].to_numpy(), np.full(len(own), -1)))
        none = np.zeros(0, np.int64)
        a, b = (np.concatenate([p[i] for p in pairs] or [none]) for i in (0, 1))
        keys, nodes, trees = (np.concatenate([f[i] for f in flags] or [none]) for i in (0, 1, 2))
        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "key": pd.array([None] * len(a), dtype="Int64"), "tree": pd.array([None] * len(a), dtype="Int64")})
        if len(keys):
            yield pd.DataFrame({"a": nodes, "b": pd.array([None] * len(nodes), dtype="Int64"), "key": keys, "tree": trees}).drop_duplicates(["a", "key", "tree"])

    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        at = pdf[["key", "x", "y"]].to_numpy()
        starts = np.append(0, np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1)
        rest = pdf.iloc[starts[-1] :]
        if starts[-1]:
            yield from found(pdf.iloc[: starts[-1]])
    if rest is not None and len(rest):
        yield from found(rest)


def _pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs of nodes that share a key, out of rows of key, node, n, m and sketches, or payload and comp in their place if links are meant. Groups
    of more than BLOCK nodes are compared block by block."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    # block x meets block y for x <= y; within x = y a block meets itself, so its rows come once
    place = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), F.lit(side).alias("side"))
    first = F.transform(F.sequence(own, blocks - 1), lambda y: place(own, y, 0))
    second = F.when(own > 0, F.transform(F.sequence(F.lit(0), F.greatest(own - 1, F.lit(0))), lambda x: place(x, own, 1))).otherwise(F.slice(first, 1, 0))
    one = F.array(place(F.lit(0), F.lit(0), 0))
    places = F.when(blocks > 1, F.concat(first, second)).otherwise(one)
    rest = [c for c in rows.columns if c != "key"]
    placed = rows.select("key", F.explode(places).alias("p"), *rest).select("key", "p.*", *rest)
    dealt = placed.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "n", "node")
    found = dealt.mapInPandas(partial(_compared, similarity), "a long, b long, key long, tree long")
    return found.distinct()


def _between(flagged: DataFrame, texts: DataFrame, comps: DataFrame, similarity: float) -> DataFrame | None:
    """What the forests of large groups hide: links between components among the flagged nodes of a key's tree, which is
    what ``key`` means here (None: none has two components)."""
    rows = flagged.join(comps, "node", "left")
    rows = cut(rows.withColumn("comp", F.coalesce("comp", "node")), "labelled")
    mixed = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m"))
    mixed = cut(mixed.filter("low <> high").select("key", "m"), "mixed")
    if mixed.isEmpty():
        return None
    whole = rows.join(mixed, "key").join(texts.select("node", "n", "payload"), "node")
    return cut(_pairs(whole, similarity).filter("b is not null").select("a", "b"), "between")


def _verified(similarity: float, batch: pa.RecordBatch):
    left, right = (batch.column(c).to_pylist() for c in ("pa", "pb"))
    lines = {x: Line(x) for x in {*left, *right}}
    keep = pa.array([similar(lines[x], lines[y], similarity) for x, y in zip(left, right)], pa.bool_())
    yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])


def _links(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that are linked; ``pairs`` and ``texts`` are cuts. Where there are more pairs than texts they come
    slice by slice, so that no more payloads than about twice the texts are on the disks at once."""
    slices, links = 1 + pairs.count() // max(texts.count(), 1), None
    for i in range(slices):
        some = pairs.filter(F.pmod(F.xxhash64("a"), F.lit(slices)) == i) if slices > 1 else pairs
        paired = some.join(texts.select(F.col("node").alias("a"), F.col("payload").alias("pa")).hint("shuffle_hash"), "a").join(texts.select(F.col("node").alias("b"), F.col("payload").alias("pb")).hint("shuffle_hash"), "b")
        own = cut(map_batches(paired, partial(_verified, similarity), "a long, b long"), "links")
        links = own if links is None else links.unionByName(own)
        del paired, some
        release(pairs.sparkSession)
    return links


def linked_lines(docs: DataFrame, lines: DataFrame, nodes: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """(node, comp) of every node that is linked with another; comp is the smallest node of its group.

    ``docs``: text, read twice. ``lines``: the counters of its runs. ``nodes``: node, n, sketches. The latter two are cuts.
    """
    spark = lines.sparkSession
    release(spark)
    n_keys = nodes.select(F.sum(F.col("n") * 0.4 + 1)).first()[0] or 0
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_keys) // PART))
    runs, words = _counts(lines)
    packed = docs.select("text").mapInArrow(partial(_packed, rarity(runs), shares(words), min_words, n_parts), "part int, blob binary")
    shared = cut(packed.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(partial(_shared, similarity), "a long, b long, key long, m long"), "shared")
    release(spark)
    # pairs of small groups come once each, before anything is joined
    met = shared.filter("b is not null").select("a", "b").distinct()
    for side, end in (("x", "a"), ("y", "b")):
        met = met.join(nodes.select(F.col("node").alias(end), *(F.col(c).alias(f"{side}_{c}") for c in ["n", *_SKETCH])).hint("shuffle_hash"), end)
    met = cut(met.filter(_not_unlike(similarity)).select("a", "b"), "met")
    release(spark)
    large = shared.filter("b is null").select("key", F.col("a").alias("node"), "m")
    compared = cut(_pairs(large.join(nodes.hint("shuffle_hash"), "node"), similarity), "pairs")
    found = compared.filter("b is not null").select("a", "b")
    pairs = cut(met.unionByName(found).distinct(), "likely")
    discard(shared)
    discard(met)
    del packed, large, found
    # lines have many runs in common, so one tree comes under many keys: trees of one smallest node are one
    whole = F.when(F.col("tree") != -1, F.xxhash64("tree")).otherwise(F.xxhash64("key", "tree"))
    flagged = compared.filter("b is null").select(whole.alias("key"), F.col("a").alias("node")).distinct()
    release(spark)
    # only lines whose node falls into a wanted bucket are dealt out: the filter has FILTER_BUCKETS bits, so it travels
    # whatever the data; what it lets through beyond the wanted is one shuffle of all lines at most
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    buckets = np.zeros(FILTER_BUCKETS, bool)
    buckets[wanted.select(F.col("node").bitwiseAND(F.lit(FILTER_BUCKETS - 1).cast("long")).cast("int").alias("bucket")).distinct().toArrow().column(0).to_numpy()] = True
    near = docs.select("text").mapInArrow(partial(_payloads, min_words, np.packbits(buckets)), "node long, n int, payload binary")
    near = near.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("payload").alias("payload"))
    texts = cut(map_batches(near, _sketched, "node long, n int, payload binary, s0 long, s1 long"), "texts")
    del near, wanted
    release(spark)
    # the nearest pair of each line by SimHash; then what is still in different groups
    ordered = pairs
    for side, end in (("x", "a"), ("y", "b")):
        ordered = ordered.join(texts.select(F.col("node").alias(end), *(F.col(c).alias(f"{side}_{c}") for c in _SIMHASH)).hint("shuffle_hash"), end)
    ordered = ordered.select("a", "b", _differing(_SIMHASH).alias("far"))
    first = cut(ordered.groupBy("a").agg(F.min(F.struct("far", "b")).alias("best")).select("a", F.col("best.b").alias("b")), "first")
    comps = components(_links(first, texts, similarity))
    rest = cut(apart(pairs.join(first, ["a", "b"], "left_anti").select("a", "b"), comps), "rest")
    if not rest.isEmpty():
        comps = united(comps, _links(rest, texts, similarity))
    release(spark)
    more = _between(flagged, texts, comps, similarity)
    return comps if more is None else united(comps, more)


def _without(text: Column, drop: Column) -> Column:
    """``text`` without the lines of the given numbers."""
    def keep(x: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), drop)
        return F.array_join(F.transform(numbers, lambda i: F.get(x, i)), "\n")

    return F.when(F.size(drop) > 0, bind(F.split(text, "\n"), keep)).otherwise(text)


def repeated_lines(df: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", exact_words: int | None = None) -> DataFrame:
    """doc_id, mark (hash of the text) and drop (numbers, from 0, of the lines to remove) of texts that have such lines."""
    if not 0.8 <= similarity <= 1:
        raise ValueError("runs of three words find lines from a similarity of 0.8 on")
    narrow_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked = docs.withColumn("mark", F.xxhash64("text"))
    schema = "doc_id long, mark long, line int, f1 long, f2 long, n int, p0 long, p1 long, p2 long, p3 long, chunk int, counts binary"
    lines = cut(marked.mapInArrow(_line_rows, schema), "lines", compression="zstd")
    exact_words = min_words if exact_words is None else exact_words
    found = lines.filter(F.col("n") >= exact_words).select("doc_id", "mark", "line", "f1", "f2")
    first = F.min(F.struct("doc_id", "mark", "line")).alias("first")
    groups = cut(lines.filter(F.col("n") >= exact_words).groupBy("f1", "f2").agg(first, F.min("n").alias("n"), *(F.min(c).alias(c) for c in _SKETCH), F.count(F.lit(1)).alias("times")), "groups")
    comps = linked_lines(marked, lines, groups.filter(F.col("n") >= min_words).select(F.col("f1").alias("node"), "n", *_SKETCH), min_words, similarity)
    grouped = groups.select(F.col("f1").alias("node"), "f1", "f2", "first", "times").join(comps.hint("shuffle_hash"), "node", "left")
    grouped = cut(grouped.filter("comp is not null or times > 1").select("f1", "f2", "first", "comp"), "grouped")
    leaders = cut(grouped.filter("comp is not null").groupBy("comp").agg(F.min("first").alias("leader")), "leaders")
    many = grouped.join(leaders.hint("shuffle_hash"), "comp", "left")
    many = cut(many.select("f1", "f2", F.coalesce("leader", "first").alias("leader")), "many")
    release(df.sparkSession)
    extra = found.join(many.hint("shuffle_hash"), ["f1", "f2"]).filter(~F.struct("doc_id", "mark", "line").eqNullSafe(F.col("leader")))
    return extra.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("line")).alias("drop"))


def dedup_lines(df: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", exact_words: int | None = None) -> DataFrame:
    """``df`` with repeated lines removed from ``text_col``, and the columns _n_lines and _n_removed.

    Lines of fewer than ``exact_words`` words (``min_words`` if it is None) stay, and of lines of fewer than ``min_words`` words
    only equal ones are a group. Of each group of equal or similar lines the occurrence of the smallest
    (id, hash of the text, line) stays. Every row stays, an emptied text as ''. Null texts stay null and have no lines;
    repeated rows of one id and text are one document and keep the same lines; a null id counts as the smallest. An empty
    table gives an empty one. Columns of ``df`` keep their names and values, whatever they are called, but for _n_lines and
    _n_removed, which are replaced.
    """
    with scratch(df.sparkSession) as keep:
        drops = keep(cut(repeated_lines(df, min_words, similarity, id_col, text_col, exact_words), "drops"))
    release(df.sparkSession)
    df = df.drop("_n_lines", "_n_removed")
    taken = {c.lower() for c in df.columns}
    own_id, own_mark, own_drop = (next(x for i in range(len(taken) + 1) if (x := f"_{c}{i}") not in taken) for c in ("id", "mark", "drop"))
    drops = drops.toDF(own_id, own_mark, own_drop)
    text = F.col(text_col).cast("string")
    on = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(own_mark))
    joined = df.join(drops.hint("shuffle_hash"), on, "left").withColumn(own_drop, F.coalesce(own_drop, F.array().cast("array<int>")))
    counted = joined.withColumn("_n_lines", F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1).cast("long")).withColumn("_n_removed", F.size(own_drop).cast("long"))
    return counted.withColumn(text_col, _without(text, F.col(own_drop))).drop(own_id, own_mark, own_drop)
