"""Approximate nearest neighbours by inner product: score-aware anisotropic product quantisation.

Codebooks of 16 centroids for each pair of dimensions are fitted on a bounded sample. The loss of a reconstruction weighs
the residual that is parallel to the vector more than the orthogonal one, as only that one moves large inner products;
assignment goes by coordinate descent over the subspaces, and a centroid solves the weighted least squares of its points.
Codes are four bits; two share a byte. A scan looks up, for each query, a table of 256 sums for each byte and adds them. The
best by that are ranked again by exact inner products in double precision, and after them all others whose code score and
largest error (the residual's norm by the query's) reach the best k + 1 so far: no cut loses one of them. For a block of queries
these others are multiplied as one matrix; only what reaches the best but for rounding is summed again in the exact order.

Equal vectors are one entry with their smallest ids, so copies can't crowd out others. Entries are dealt into slots; the
stated queries, in blocks, are scanned against every slot, and each slot returns its exact best. A slot, a block and what
they return have a fixed size whatever the data.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

#: Vectors that the codebooks are fitted on, at most: those of the smallest hash of their id.
TRAIN_ROWS = 10_000
#: Entries of one slot, queries of one block, and candidates of a slot that are ranked again for each query at once.
SLOT, BLOCK, RERANK = 8192, 1024, 192
#: Queries that are scanned together.
SCAN = 128
#: Inner products of a unit vector from which errors matter; it sets the weight of the parallel residual.
SCORE_THRESHOLD = 0.2
CENTROIDS = 16


class Codebooks:
    """``centres``: (subspaces, 16, dimensions of a subspace)."""

    def __init__(self, centres: np.ndarray, eta: float):
        self.centres, self.eta = centres, eta

    @staticmethod
    def _split(x: np.ndarray) -> np.ndarray:
        """(rows, subspaces, 2); an odd last dimension is paired with zero."""
        if x.shape[1] % 2:
            x = np.concatenate([x, np.zeros((len(x), 1), x.dtype)], axis=1)
        return x.reshape(len(x), -1, 2)

    def encode(self, x: np.ndarray, sweeps: int = 2, start: np.ndarray | None = None) -> np.ndarray:
        """Codes (rows, subspaces) that minimise the anisotropic loss, by coordinate descent."""
        parts = self._split(x.astype(np.float64))
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        rows, m = np.arange(len(x)), parts.shape[1]
        plain = np.stack([((parts[:, i, None, :] - self.centres[i]) ** 2).sum(axis=2) for i in range(m)], axis=1)
        along = np.stack([((parts[:, i, None, :] - self.centres[i]) * unit[:, i, None, :]).sum(axis=2) for i in range(m)], axis=1)
        codes = plain.argmin(axis=2) if start is None else start.copy()
        total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
        for _ in range(sweeps):
            for i in range(m):
                rest = total - along[rows, i, codes[:, i]]
                codes[:, i] = (plain[:, i] + (self.eta - 1) * (rest[:, None] + along[:, i]) ** 2).argmin(axis=1)
                total = rest + along[rows, i, codes[:, i]]
        return codes

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = 8, threshold: float = SCORE_THRESHOLD) -> Codebooks:
        """Codebooks of a sample of non-zero vectors."""
        d = x.shape[1]
        eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        x = x.astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        parts = cls._split(x)
        rng = np.random.Generator(np.random.PCG64(7))
        picks = rng.choice(len(x), size=CENTROIDS, replace=len(x) < CENTROIDS)
        books = cls(np.transpose(parts[picks], (1, 0, 2)).copy(), eta)
        codes = None
        for r in range(rounds):
            codes = books.encode(x, 1 if r else 0, codes)
            along = np.stack([((parts[:, i] - books.centres[i][codes[:, i]]) * parts[:, i]).sum(axis=1) for i in range(parts.shape[1])], axis=1)
            total = along.sum(axis=1)
            for i in range(parts.shape[1]):
                target = total - along[:, i] + (parts[:, i] ** 2).sum(axis=1)
                for k in range(CENTROIDS):
                    own = codes[:, i] == k
                    if own.any():
                        p = parts[own, i]
                        left = own.sum() * np.eye(2) + (eta - 1) * p.T @ p
                        books.centres[i, k] = np.linalg.solve(left, p.sum(axis=0) + (eta - 1) * (target[own, None] * p).sum(axis=0))
        return books

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes a byte."""
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), codes.dtype)], axis=1)
        return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def residuals(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Norms of what the codes leave of the vectors."""
        back = np.stack([self.centres[i][codes[:, i]] for i in range(codes.shape[1])], axis=1)
        return np.linalg.norm((self._split(x.astype(np.float64)) - back).reshape(len(x), -1), axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): what each byte of a code adds to the inner product."""
        t = np.einsum("qmd,mkd->qmk", self._split(q.astype(np.float64)), self.centres).astype(np.float32)
        if t.shape[1] % 2:
            t = np.concatenate([t, np.zeros((len(q), 1, CENTROIDS), np.float32)], axis=1)
        return (t[:, 1::2, :, None] + t[:, ::2, None, :]).reshape(len(q), -1, 256)


def _inner(q: np.ndarray, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, dimension by dimension: of each query of q (queries, d) with its own rows
    (queries, n) of the vectors that are the columns of x (d, vectors)."""
    out = np.zeros(rows.shape)
    for i in range(len(x)):
        out += q[:, i, None] * x[i].take(rows)
    return out


def _encoded(books: Codebooks, slots: int, dim: int, batches):
    """Entries in packed blocks of one slot each; the slot goes by the entry's smallest id."""
    for pdf in batches:
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(x, axis=1)
        unit = x / norm[:, None]
        codes = books.encode(unit)
        packed, left = books.pack(codes), books.residuals(unit, codes)
        for slot, own in pdf.groupby("slot").indices.items():
            ids = pdf["ids"].to_numpy()[own]
            yield pd.DataFrame({"slot": [slot], "ids": [np.concatenate(ids).astype(np.int64).tobytes()], "counts": [np.array([len(i) for i in ids], np.int32).tobytes()], "norms": [norm[own].tobytes()], "residuals": [left[own].tobytes()], "codes": [packed[own].tobytes()], "vectors": [x[own].tobytes()]})


def _scan(books: Codebooks, dim: int, k: int, rerank: int, queries: pd.DataFrame, slot: pd.DataFrame) -> pd.DataFrame:
    """The best ``k`` + 1 entries of a slot for each query of a block, by exact scores."""
    out_q, out_ids, out_scores = [], [], []
    if len(queries) and len(slot):
        counts = np.concatenate([np.frombuffer(c, np.int32) for c in slot["counts"]])
        ids = np.concatenate([np.frombuffer(c, np.int64) for c in slot["ids"]])
        norms, left = (np.concatenate([np.frombuffer(x, np.float64) for x in slot[c]]) for c in ("norms", "residuals"))
        vectors = np.concatenate([np.frombuffer(c, np.float64) for c in slot["vectors"]]).reshape(-1, dim)
        codes = np.concatenate([np.frombuffer(c, np.uint8) for c in slot["codes"]]).reshape(len(counts), -1)
        first = np.cumsum(counts) - counts
        smallest = ids[first]
        order = np.argsort(smallest)  # of equal scores the smallest id comes first
        codes, norms, left, first, counts, vectors = np.ascontiguousarray(codes[order].T), norms[order], left[order], first[order], counts[order], vectors[order]
        n, keep = len(counts), min(len(counts), max(rerank, k + 1))
        columns = np.ascontiguousarray(vectors.T)
        names, every = queries["query_id"].to_numpy(), np.stack(queries["embedding"].to_numpy()).astype(np.float64)
        for a in range(0, len(every), SCAN):
            q = every[a : a + SCAN]
            tables = books.tables(q)
            scores = np.zeros((len(q), n), np.float32)
            for j in range(codes.shape[0]):
                scores += tables[:, j].take(codes[j], axis=1)
            # what a score may be at most; the last term is for the rounding of the tables' sums
            size = np.linalg.norm(q, axis=1)
            top = (scores + size[:, None] * left + np.abs(tables).max(axis=2).sum(axis=1)[:, None] * 1e-5) * norms
            scores = scores * norms
            near = np.argpartition(-scores, keep - 1, axis=1)[:, :keep] if keep < n else np.tile(np.arange(n), (len(q), 1))
            exact = _inner(q, columns, near)
            least = np.partition(exact, -k - 1, axis=1)[:, -k - 1] if keep > k else np.full(len(q), -np.inf)
            reach = top >= least[:, None]
            reach[np.arange(len(q))[:, None], near] = False
            some = np.flatnonzero(reach.any(axis=0))
            if len(some):
                # the product's sums and the exact ones are rounded in another order
                rounding = dim * 1e-15 * size[:, None] * norms[some]
                product = q @ (vectors if len(some) == n else vectors[some]).T
                reach = reach[:, some] & (product >= least[:, None] - rounding)
            for row, own in enumerate(near):
                score = exact[row]
                if len(some) and len(more := some[reach[row]]):
                    own, score = np.append(own, more), np.append(score, _inner(q[row : row + 1], columns, more[None])[0])
                by = np.lexsort((own, -score))[: k + 1]
                best, score = own[by], score[by]
                found = np.concatenate([ids[first[b] : first[b] + counts[b]] for b in best])
                score = np.repeat(score, counts[best])
                other = found != names[a + row]
                found, score = found[other], score[other]
                best = np.lexsort((found, -score))[:k]
                out_q.append(np.full(len(best), names[a + row]))
                out_ids.append(found[best])
                out_scores.append(score[best])
    columns = (np.concatenate(x or [np.zeros(0, t)]).astype(t) for x, t in ((out_q, np.int64), (out_ids, np.int64), (out_scores, np.float64)))
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))


def nearest(df: DataFrame, every: int = 20, k: int = 20, rerank: int = RERANK, id_col: str = "vec_id", vector_col: str = "embedding", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` nearest by inner product.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but those of the query's own id. Nearest
    first, ties to the smaller id; fewer if there are fewer candidates. Vectors that are null, empty, zero or hold null or
    non-finite components, rows of a null id, and vectors of another length than the most frequent one take no part.
    Repeated rows of one id and vector count once; of one id with several vectors the lexically smallest counts.
    """
    v = F.col(vector_col).cast("array<double>")
    own = df.select(F.col(id_col).cast("long").alias("id"), v.alias("embedding")).filter("id is not null and embedding is not null and size(embedding) > 0")
    own = own.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    own = own.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))  # no negative zeros
    lengths = own.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["dim"]
    own = own.filter(F.size("embedding") == dim).groupBy("id").agg(F.min("embedding").alias("embedding"))
    own = cut(own, "vectors")
    # only the k + 1 smallest ids of equal vectors can be among k nearest, as their scores are the same
    few = own.withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("id"))).filter(F.col("r") <= k + 1)
    entries = cut(few.groupBy("embedding").agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    sample = own.orderBy(F.xxhash64("id"), "id").limit(train_rows).select("embedding").toArrow()
    books = Codebooks.fit(sample.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dim))
    n, n_queries = entries.count(), own.filter(F.col("id") % every == 0).count()
    slots, blocks = max(1, -(-n // SLOT)), max(1, -(-n_queries // BLOCK))
    slotted = entries.withColumn("slot", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(slots)).cast("int"))
    binary = "slot int, ids binary, counts binary, norms binary, residuals binary, codes binary, vectors binary"
    index = cut(slotted.select("slot", "ids", "embedding").mapInPandas(partial(_encoded, books, slots, dim), binary), "index")
    queries = own.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "embedding", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    left = queries.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    right = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("slot", "block").cogroup(right.groupBy("slot", "block")).applyInPandas(partial(_scan, books, dim, k, rerank), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_sql(every: int = 20, k: int = 20) -> str:
    """The exact nearest in DuckDB's SQL, by brute force."""
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {k}
"""
