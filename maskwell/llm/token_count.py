"""Token counts of whole texts, huge ones included, by overlap resynchronisation.

A text longer than CHUNK characters is encoded in overlapping chunks. Two neighbours are spliced at a boundary that is
proven stable: a place in the overlap where both start a piece. The pre-tokeniser looks ahead but never back, so from such
a place on both must go on alike, and what the left chunk has before it is final, as it lies further from that chunk's end
than any lookahead or special string reaches. Where the overlap has no such place, as inside one enormous word, the left
chunk and the overlap are doubled until there is one or the text ends.

Counts equal those of encoding the whole text at once; memory follows the chunk and not the text.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_batches, text_frame, texts_of
from .bpe import Encoder, json_encoder

CHUNK = 1 << 16
OVERLAP = 256
#: Characters that the pre-tokeniser looks ahead at most.
LOOKAHEAD = 3


def _bounds(enc: Encoder, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece boundaries of text[start:end] (both ends included), and the tokens before each."""
    starts, n, _, _ = enc.pieces([text[start:end]])
    return starts + start, np.concatenate([[0], np.cumsum(n)])


def count_spliced(enc: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text, by chunks. Where two chunks have no common boundary the left one and the overlap double, so that
    the work stays in proportion to the text, whatever it holds."""
    n, margin = len(text), enc.longest_special + LOOKAHEAD
    total, stable = 0, 0  # tokens before ``stable``, a piece boundary of the whole text
    left, counts = _bounds(enc, text, 0, min(n, chunk + overlap))
    size, wide = chunk + overlap, overlap
    while (edge := int(left[-1])) < n:
        begin = max(edge - wide, stable)
        right, right_counts = _bounds(enc, text, begin, min(n, begin + wide + chunk))
        common = np.intersect1d(left[(left >= begin) & (left > stable) & (left <= edge - margin)], right)
        if len(common):
            at = int(common[0])
            total += int(counts[np.searchsorted(left, at)] - counts[np.searchsorted(left, stable)])
            stable, left, counts = at, right, right_counts
            size, wide = chunk + overlap, overlap
        else:
            size, wide = 2 * size, 2 * wide
            left, counts = _bounds(enc, text, stable, min(n, stable + size))
    return total + int(counts[-1] - counts[np.searchsorted(left, stable)])


def _counts(path: str, limit: int, batch: pa.RecordBatch):
    enc, texts = json_encoder(path), texts_of(batch)
    short = [i for i, t in enumerate(texts) if len(t) <= CHUNK]
    n = [0] * len(texts)
    for i, ids in zip(short, enc.encode_batch([texts[i] for i in short])):
        n[i] = len(ids) // 4
    for i, t in enumerate(texts):
        if len(t) > CHUNK:
            n[i] = count_spliced(enc, t)
    columns = [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])]
    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row.

    ``path``: a byte-level BPE file of the tokenizers library, readable on every executor; special strings inside a text
    count as their one token, as the library does by default. One row out for each row in, repeated rows included; a null
    text counts as empty (0 bytes, 0 tokens), a null id stays null. No shuffle; other columns are not read.
    """
    return map_batches(text_frame(df, id_col, text_col), partial(_counts, path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
