"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression. Every code point gets a class, refined by what follows it (a contraction's
apostrophe, the last white space before a word), and each class is a function from automaton state to automaton state.
The functions generate a small monoid; its multiplication table turns "which state is the automaton in here?" into an
associative scan over bytes of numpy. Where a prefix product is constant the state is known, and nearly all become so
after two doublings. A boundary before a character is a function of the state before it and of its class.

The slices found that way feed a bounded cache of merged pieces. Offsets of pieces and tokens are kept, so a token can be
traced to its place in the text and ids decode to the same bytes.

Null and empty texts have no tokens. Nothing is cut, dropped or normalised: any string is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Callable
from functools import cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from ._common import map_batches, parts, text_frame, texts_of

#: Characters handled at once.
STEP_CHARS = 100_000
#: Pieces that a cache holds, about.
CACHE_PIECES = 400_000
_U = np.uint64
#: The lowest bytes of a word, by how many.
_LOW = np.array([256**i - 1 for i in range(9)], _U)

# Classes of a character: letter, number, other, contraction of one or two letters, white space that more white space or
# the end follows, a blank that a word follows, other white space that a word follows.
_L, _N, _O, _A1, _A2, _W, _P, _Q = range(8)
# States: at a boundary, in letters, in numbers, in others, in white space, after a leading blank, one or two letters of a
# contraction to come.
_E, _SL, _SN, _SO, _SW, _SP, _C1, _C2 = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a character and whether a piece starts at it."""
    if kind == _L and state in (_C2, _C1):
        return (_C1 if state == _C2 else _E), False
    if kind in (_L, _N, _O):
        own = {_L: _SL, _N: _SN, _O: _SO}[kind]
        return own, state not in (own, _SP)
    if kind in (_A1, _A2):
        if state in (_SO, _SP):
            return _SO, False
        return (_C1 if kind == _A1 else _C2), True
    if kind == _W:
        return _SW, state != _SW
    return (_SP if kind == _P else _E), True


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The monoid: function of each class, of each class at a text's start, multiplication, whether constant, its value
    (or 255), and the boundary table [class, state before]."""
    per_class = [tuple(_step(s, k)[0] for s in range(8)) for k in range(8)]
    at_start = [tuple([f[_E]] * 8) for f in per_class]
    found = list(dict.fromkeys([*per_class, *at_start]))
    index = {f: i for i, f in enumerate(found)}
    products: dict[tuple[int, int], int] = {}
    done = 0
    while done < len(found):  # closure; small, as most products are constant
        done = len(found)
        for i in range(done):
            for j in range(done):
                if (i, j) not in products:
                    f = tuple(found[j][found[i][s]] for s in range(8))
                    if f not in index:
                        index[f] = len(found)
                        found.append(f)
                    products[i, j] = index[f]
    n = len(found)
    times = np.array([[products[i, j] for j in range(n)] for i in range(n)], np.uint8)
    constant = np.array([f[0] if len(set(f)) == 1 else 255 for f in found], np.uint8)
    cuts = np.array([[_step(s, k)[1] for s in range(8)] for k in range(8)])
    return np.array([index[f] for f in per_class], np.uint8), np.array([index[f] for f in at_start], np.uint8), times, constant != 255, constant, cuts


@cache
def _classes() -> np.ndarray:
    """Class of every code point; white space is _W until its neighbour is known."""
    out = np.full(0x110000, _O, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", _L), (r"\p{N}+", _N), (r"\p{White_Space}+", _W)):
        for m in regex.finditer(pattern, everything):
            a, b = m.span()
            for s, e in ((a, min(b, 0xD800)), (max(a, 0xD800), b)):
                if s < e:
                    shift = 0 if s < 0xD800 else 0x800
                    out[s + shift : e + shift] = kind
    return out


def piece_starts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined; where each piece starts, with the total length last; the index of each text's first piece, with
    the number of pieces last."""
    joined = "".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(texts) else 0
    if not n:
        return joined, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = _classes()[codes]
    first = np.unique((ends - sizes)[sizes > 0])
    last = np.unique(ends[sizes > 0]) - 1
    space = kind == _W
    before_word = np.zeros(n, bool)
    before_word[:-1] = space[:-1] & ~space[1:]
    before_word[last] = False
    before_word = np.flatnonzero(before_word)
    kind[before_word] = np.where(codes[before_word] == 32, _P, _Q)
    quotes = np.flatnonzero(codes == 39)
    if len(quotes):
        stop = last[np.searchsorted(last, quotes)]
        one = np.where(quotes + 1 <= stop, codes[np.minimum(quotes + 1, n - 1)], 0)
        two = np.where(quotes + 2 <= stop, codes[np.minimum(quotes + 2, n - 1)], 0)
        kind[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = _A1
        kind[quotes[((np.isin(one, [ord("r"), ord("v")])) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))]] = _A2
    own, fresh, times, fixed, value, cuts = _tables()
    product = own[kind]
    product[first] = fresh[kind[first]]
    flat, m, width = times.ravel(), times.shape[0], 1
    pending = np.flatnonzero(~fixed[product])
    while len(pending):  # doubling: the product of 2 * width functions up to each place
        again = flat[product[pending - width].astype(np.intp) * m + product[pending]]
        product[pending] = again
        pending = pending[~fixed[again]]
        width *= 2
    state = value[product]
    before = np.empty(n, np.uint8)
    before[0] = _E
    before[1:] = state[:-1]
    before[first] = _E
    cut = cuts.ravel()[(kind << 3) | before]
    cut[first] = True
    starts = np.flatnonzero(cut)
    return joined, np.append(starts, n), np.searchsorted(starts, np.append(ends - sizes, n))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_NONE = np.int32(2**31 - 1)


class Merges:
    """Which pairs of ids merge, in which order, and into which id; ``bytes_id`` are the ids of the 256 bytes.

    ``compiled``, if given, merges a piece by itself. Without it pieces are merged many at a time: a row for each piece, a slot for each byte, neighbours by linked lists. Each round
    merges every row's pair of lowest rank, the leftmost first, and looks up the two pairs that this makes.
    """

    def __init__(self, bytes_id: np.ndarray, pairs: dict[tuple[int, int], tuple[int, int]], width: int, compiled: Callable[[bytes], list[int]] | None = None):
        self.compiled = compiled
        self.bytes_id, self.width, self.pairs = bytes_id.astype(np.int32), width, pairs
        keys = np.array([a * width + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        values = np.array(list(pairs.values()), np.int32).reshape(-1, 2)[order]
        self.keys, self.rank, self.into = np.append(keys[order], 2**62), np.append(values[:, 0], _NONE), np.append(values[:, 1], 0)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], _NONE), self.into[at]

    def _matrix(self, pieces: list[bytes], size: int) -> list[bytes]:
        rows = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        ids = np.full((rows, size + 1), -1, np.int32)
        where = np.arange(size + 1)[None, :] < lengths[:, None]
        ids[where] = self.bytes_id[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((rows, size + 1), _NONE, np.int32)
        into = np.zeros((rows, size + 1), np.int32)
        rank[:, :-1], into[:, :-1] = self._look(ids[:, :-1], ids[:, 1:])
        ahead = np.tile(np.arange(1, size + 2, dtype=np.int16), (rows, 1))
        ahead[:, size] = size
        behind = np.tile(np.arange(-1, size, dtype=np.int16), (rows, 1))
        live = np.arange(rows)
        while len(live):
            low = rank[live].argmin(axis=1)
            some = rank[live, low] != _NONE
            live, low = live[some], low[some]
            if not len(live):
                break
            ids[live, low] = into[live, low]
            gone = ahead[live, low]
            after = ahead[live, gone]
            ids[live, gone], rank[live, gone] = -1, _NONE
            ahead[live, low], behind[live, after] = after, low
            rank[live, low], into[live, low] = self._look(ids[live, low], np.where(after < size, ids[live, after], -1))
            has = behind[live, low] >= 0
            rows_b, low_b = live[has], low[has]
            prior = behind[rows_b, low_b]
            rank[rows_b, prior], into[rows_b, prior] = self._look(ids[rows_b, prior], ids[rows_b, low_b])
        kept = ids >= 0
        flat, ends = ids[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1)) * 4
        ends = ends.tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _long(self, piece: bytes) -> bytes:
        """A heap over a linked list: n log n for a piece of any length."""
        at = self.bytes_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(at)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r[0], i, at[i], at[i + 1]) for i in range(n - 1) if (r := self.pairs.get((at[i], at[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if at[i] != a or j < 0 or at[j] != b:
                continue
            at[i], at[j] = self.pairs[a, b][1], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -1
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (r := self.pairs.get((at[p], at[q]))):
                    heapq.heappush(heap, (r[0], p, at[p], at[q]))
        return np.array([x for x in at if x >= 0], "<u4").tobytes()

    def merge(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has."""
        if self.compiled:
            lists = list(map(self.compiled, raw))
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter(chain.from_iterable(lists), np.uint32, int(n.sum())), n
        out: list[bytes] = [b""] * len(raw)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(raw):
            groups.setdefault((len(p) + 3) // 4 if len(p) <= 48 else 0, []).append(i)
        for g, members in groups.items():
            for a in range(0, len(members), 20_000):
                own = members[a : a + 20_000]
                got = self._matrix([raw[i] for i in own], 4 * g) if g else [self._long(raw[i]) for i in own]
                for i, ids in zip(own, got):
                    out[i] = ids
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) // 4


def merges_of_ranks(ranks: dict[bytes, int]) -> Merges:
    """Any two tokens merge whose bytes together are a token, the lowest rank first."""
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                pairs[a, b] = (rank, rank)
    return Merges(np.array([ranks[bytes([i])] for i in range(256)]), pairs, max(ranks.values()) + 1)


class PieceTable:
    """The ids of pieces, found for many at a time. Pieces of up to 16 bytes stand in a hash table under their own bytes, so
    that a hit is exact; longer ones in a dictionary. Both are emptied when they hold ``most`` pieces."""

    SLOTS = 1 << 20

    def __init__(self, most: int = CACHE_PIECES):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros((self.SLOTS, 2), _U)
        self.sizes, self.at, self.n = (np.zeros(self.SLOTS, t) for t in (np.uint8, np.int64, np.int32))
        self.pool, self.used, self.held = np.zeros(1 << 16, np.uint32), 0, 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def _add(self, ids: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        ends = self.used + np.cumsum(n)
        self.used += len(ids)
        self.held += len(n)
        return list(zip((ends - n).tolist(), n.tolist()))

    def _slots(self, keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, or the free slot where it belongs; and whether it is there."""
        mixed = (keys[:, 0] * _U(0x9E3779B97F4A7C15) ^ (keys[:, 1] + _U(0x632BE59BD9B4E019)) * _U(0xC2B2AE3D27D4EB4F)) * _U(0xD6E8FEB86659FD93)
        slot = (mixed >> _U(44)).astype(np.int64)
        there = np.zeros(len(keys), bool)
        rest = np.arange(len(keys))
        while len(rest):
            own = slot[rest]
            hit = (self.sizes[own] == sizes[rest]) & (self.keys[own] == keys[rest]).all(axis=1)
            there[rest[hit]] = True
            rest = rest[~hit & (self.sizes[own] > 0)]
            slot[rest] = (slot[rest] + 1) % self.SLOTS
        return slot, there

    def find(self, raw: bytes, starts: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece of ``raw`` has, and the ids of all; ``starts`` ends with the length of ``raw``.
        ``encode(list of distinct pieces)`` gives the ids of pieces that are new, and how many each has."""
        if self.held > self.most:
            self._clear()
        begin, sizes = starts[:-1], np.diff(starts)
        at, n = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        short = np.flatnonzero(sizes <= 16)
        words = np.ndarray((len(raw) + 9,), "<u8", raw + bytes(16), strides=(1,))
        own, size = begin[short], sizes[short]
        keys = np.stack([words[own] & _LOW[np.minimum(size, 8)], words[np.minimum(own + 8, len(raw))] & _LOW[np.maximum(size - 8, 0)]], axis=1)
        slot, there = self._slots(keys, size)
        missed = np.flatnonzero(~there)
        long = np.flatnonzero(sizes > 16)
        pieces = [raw[a : a + m] for a, m in zip(own[missed].tolist(), size[missed].tolist())]
        long_pieces = [raw[a : a + m] for a, m in zip(begin[long].tolist(), sizes[long].tolist())]
        new = dict.fromkeys([*pieces, *(x for x in long_pieces if x not in self.long)])
        if new:
            spans = dict(zip(new, self._add(*encode(list(new)))))
            if len(long):
                self.long |= {x: v for x, v in spans.items() if len(x) > 16}
            first = dict(zip(reversed(pieces), reversed(missed.tolist())))
            rest, own_spans = np.array(list(first.values()), np.int64), np.array([spans[x] for x in first], np.int64).reshape(-1, 2)
            while len(rest):  # of several that belong in one slot the first takes it, and the others look on
                where, _ = self._slots(keys[rest], size[rest])
                where, taken = np.unique(where, return_index=True)
                self.keys[where], self.sizes[where] = keys[rest[taken]], size[rest[taken]]
                self.at[where], self.n[where] = own_spans[taken].T
                rest, own_spans = np.delete(rest, taken), np.delete(own_spans, taken, axis=0)
            slot[missed], _ = self._slots(keys[missed], size[missed])
        at[short], n[short] = self.at[slot], self.n[slot]
        if len(long):
            at[long], n[long] = np.array([self.long[x] for x in long_pieces], np.int64).T
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return n, self.pool[np.repeat(at - (ends - n), n) + np.arange(total)]


def merges_of_json(model: dict) -> Merges:
    """The merges of a tokenizers file, whose tokens spell bytes with printable characters."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    spelt = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab, pairs = model["vocab"], {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
    bytes_id = np.array([vocab[spelt[i]] for i in range(256)])
    made = [into for _, into in pairs.values()]
    compiled = None
    if made == sorted(made) and bytes_id.max() < made[0]:  # ids are ranks, which is what the compiled merger goes by
        known = {*made, *bytes_id.tolist()}
        back = {v: k for k, v in spelt.items()}
        ranks = {bytes(map(back.__getitem__, t)): i for t, i in vocab.items() if i in known}
        compiled = tiktoken.Encoding("merges", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    return Merges(bytes_id, pairs, max(vocab.values()) + 1, compiled)


class Encoder:
    """Encodes whole texts: pieces by the automaton, then cached merges. ``special`` strings become their own ids."""

    def __init__(self, merges: Merges, special: dict[str, int] | None = None):
        self.merges, self.table = merges, PieceTable()
        self.special = special or {}
        self._split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.longest_special = max(map(len, self.special), default=0)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        joined, starts, firsts = piece_starts(texts)
        raw, at = joined.encode(), starts
        if len(raw) > len(joined):
            codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            before = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF), out=before[1:])
            at = before[starts]
        return starts, *self.table.find(raw, at, self.merges.merge), firsts

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each piece starts (in the texts joined, the total length last), how many ids each has, the ids of all, and
        the index of each text's first piece (the number of pieces last)."""
        if not self._split or not any(x in t for x in self.special for t in texts):
            return self._plain(texts)
        segments, owners = [], [0]
        for t in texts:
            segments += [x for x in self._split.split(t) if x]
            owners.append(len(segments))
        marked = np.array([x in self.special for x in segments])
        # special strings are left out of the joined text, and put in again as one piece each
        starts, n, ids, firsts = self._plain(["" if m else x for x, m in zip(segments, marked)])
        shift = np.cumsum([0] + [len(x) if m else 0 for x, m in zip(segments, marked)])
        where = np.flatnonzero(marked)
        of = np.repeat(np.arange(len(segments)), np.diff(firsts))
        begin = np.insert(starts[:-1] + shift[of], firsts[where], starts[firsts[where]] + shift[where])
        ids = np.insert(ids, np.concatenate([[0], np.cumsum(n)])[firsts[where]], [self.special[segments[i]] for i in where])
        first = firsts + np.concatenate([[0], np.cumsum(marked)])
        return np.append(begin, starts[-1] + shift[-1]), np.insert(n, firsts[where], 1), ids, first[owners]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit bytes."""
        out: list[bytes] = []
        for a, b in parts([len(t) for t in texts], STEP_CHARS):
            _, n, ids, firsts = self.pieces(texts[a:b])
            flat, ends = ids.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(n)])[firsts]).tolist()
            out += [flat[i:j] for i, j in zip(ends, ends[1:])]
        return out


class BytePairEncoder(Encoder):
    """Encodes by ranks, each piece separately, without special tokens, and decodes ids."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        super().__init__(merges_of_ranks(ranks))

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of every token, in bytes of the text's UTF-8."""
        at, out = 0, []
        for token in np.frombuffer(self.encode_batch([text])[0], "<u4").tolist():
            out.append((token, at, at := at + len(self.tokens[token])))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids (little-endian unsigned 32-bit)."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def json_encoder(path: str) -> Encoder:
    """The encoder of a tokenizers file: byte-level BPE with the usual pre-tokeniser and no normaliser."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["model"]["type"] != "BPE":
        raise ValueError(f"{path}: only byte-level BPE without normaliser and prefix space is known here")
    if spec["model"].get("ignore_merges") or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
        raise ValueError(f"{path}: ignore_merges and added tokens that take in neighbours are not known here")
    return Encoder(merges_of_json(spec["model"]), {x["content"]: x["id"] for x in spec["added_tokens"]})


@cache
def encoder(path: str) -> BytePairEncoder:
    """One encoder for each worker process and file."""
    return BytePairEncoder(path)


def _digests(path: str, keep_ids: bool, batch: pa.RecordBatch):
    enc, texts = encoder(path), texts_of(batch)
    n, ids_hash, text_hash, kept = [], [], [], []
    for a, b in parts([len(t) for t in texts], STEP_CHARS):
        for ids in enc.encode_batch(texts[a:b]):
            n.append(len(ids) // 4)
            ids_hash.append(hashlib.sha256(ids).hexdigest())
            text_hash.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            if keep_ids:
                kept.append(np.frombuffer(ids, "<u4").astype(np.int32))
    columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if keep_ids:
        columns.append(pa.array(kept, pa.list_(pa.int32())))
        names.append("ids")
    yield pa.RecordBatch.from_arrays(columns, names)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and the ids if ``keep_ids``.

    ``path``: ranks as base64 tokens, readable on every executor. One row out for each row in, repeated rows included; a
    null text counts as empty, a null id stays null. No shuffle; other columns are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_batches(text_frame(df, id_col, text_col), partial(_digests, path, keep_ids), schema)


def _decode(path: str, batch: pa.RecordBatch):
    enc = encoder(path)
    texts = [None if x is None else enc.decode(np.array(x, "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode_documents(df: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give a null text, bytes that are no UTF-8 U+FFFD."""
    return map_batches(df.selectExpr("cast(doc_id as long) doc_id", "ids"), partial(_decode, path), "doc_id long, text string")
