"""Packing of documents into sequences of a fixed number of tokens, by bounded-space online best-fit.

A first pass encodes the texts and keeps a short row for each piece (never the text), written to the shared folder. A
second pass deals those rows evenly to packers. A packer keeps a fixed number of open bins; a bitset says which amounts of
free space they have, so that the tightest bin for a piece is one shift and one lowest bit. If a new bin is needed and all
are open, the fullest closes. Rows meet a packer in an order by hash, which mixes lengths and is the same if a task runs
again.
"""

from __future__ import annotations

import zlib
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, map_batches, parts, text_frame, texts_of
from .bpe import STEP_CHARS, json_encoder

#: Open bins of one packer.
OPEN_BINS = 256
#: Pieces for one packer.
PIECES_PER_TASK = 50_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, size: int, end_id: int, batch: pa.RecordBatch):
    enc, texts, ids_of = json_encoder(path), texts_of(batch), batch.column("doc_id").to_pylist()
    last, rows = end_id.to_bytes(4, "little"), []
    for a, b in parts([len(t) for t in texts], STEP_CHARS):
        for doc, ids in zip(ids_of[a:b], enc.encode_batch(texts[a:b])):
            ids += last
            n = len(ids) // 4
            bounds = [0, *range((n - 1) % size + 1, n + 1, size)]
            rows += [(doc, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(bounds, bounds[1:]))]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "piece", "start", "length", "ids_crc32"])


class BestFit:
    """Bounded-space online best-fit: ``place`` gives (bin, offset) of a piece."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins, self.made, self.n_open = size, open_bins, 0, 0
        self.free_bits = 0  # bit f: some open bin has f free
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        found = own.pop()
        if not own:
            self.free_bits &= ~(1 << free)
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fit = self.free_bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            found = self._take(free)
        else:
            free, found = self.size, self.made
            self.made += 1
            if length < self.size and self.n_open >= self.open_bins:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)  # the fullest closes
        if left := free - length:
            self.by_free.setdefault(left, []).append(found)
            self.free_bits |= 1 << left
            self.n_open += 1
        return found, self.size - free


def _pack(size: int, open_bins: int, batches):
    packer, base = BestFit(size, open_bins), TaskContext.get().partitionId() << 40
    for pdf in batches:
        placed = [packer.place(n) for n in pdf["length"].tolist()]
        yield pdf.assign(sequence_id=pd.Series([base + b for b, _ in placed], dtype="int64"), offset=pd.Series([o for _, o in placed], dtype="int64"))


def pack_documents(df: DataFrame, path: str, size: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A document is its ids by the tokenizers file at ``path``, special strings as the library reads them, then ``end_id``.
    Only documents of more than ``size`` tokens are cut, and their first piece takes what is left over. A null or empty
    text is the end id alone; repeated rows are packed each for itself; a null id stays null; an empty table gives no rows.
    """
    spark = df.sparkSession
    pieces = cut(map_batches(text_frame(df, id_col, text_col), partial(_pieces, path, size, end_id), _PIECE), "pieces")
    tasks = max(1, -(-pieces.count() // PIECES_PER_TASK))
    mixed = pieces.repartition(tasks).sortWithinPartitions(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), "doc_id", "piece", "length")
    return mixed.mapInPandas(partial(_pack, size, open_bins), _PIECE + ", sequence_id long, offset long")
