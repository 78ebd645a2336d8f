"""What the corpus operators share: the shared folder, lineage cuts and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch at most. Texts are up to a few hundred kB, so a batch stays well below a worker's memory.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only where none is set and everything runs on this machine, as
    in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="maskwell-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The scopes of this thread's calls: each thread deletes its own cuts only.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("_scopes", default=())


def cut(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: later jobs, and tasks run again after a lost
    executor, start from these files rather than from the plan above them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/maskwell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    if _scopes.get():
        _scopes.get()[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a cut that no plan reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of plans that nobody holds any more; without a collection on the driver they stay on
    the executors' disks for half an hour."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Cuts made inside are deleted at the end, but for those passed to what this yields. What is kept must not be planned
    on the others any more."""
    own: list[str] = []
    kept: list[str] = []
    token = _scopes.set((*_scopes.get(), own))

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._cut_path)
        return df

    try:
        yield keep
    finally:
        _scopes.reset(token)
        for path in own:
            if path not in kept:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if _scopes.get():
            _scopes.get()[-1].extend(kept)


def narrow_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch to BATCH_ROWS rows if it is larger (texts are long)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Gives free memory back to the system. Spark keeps a Python worker for later tasks, and what one stage has freed would
    count beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def _each_batch(fn, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from fn(batch)
    give_back()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over each Arrow batch of ``df``."""
    narrow_batches(df.sparkSession)
    return df.mapInArrow(partial(_each_batch, fn), schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def parts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of ``most`` characters together; a longer row is a range of its own."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def text_frame(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, as doc_id and text: other columns can't clash with its own."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
