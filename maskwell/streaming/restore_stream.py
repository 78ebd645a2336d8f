"""Piecewise restoration of answers in Structured Streaming.

Input rows are (stream_id, kind, seq, text, last); a stream's kinds (content, refusal) have one restorer each. Pieces may
arrive in any order and more than once: each is held until those before it are there. The state of a stream is its
restorer (plain data, pickled), the next number and the pieces that wait.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.restore import Restorer

OUTPUT = "stream_id string, kind string, seq long, text string, done boolean, error string"
COLUMNS = ["stream_id", "kind", "seq", "text", "done", "error"]
STATE = "restorer binary, next long, waiting binary, done boolean"


class TableLookup:
    """The mapping of the streams' conversations; a plain class, so that it can be pickled with a restorer."""

    def __init__(self, entries: dict[tuple[str, int], tuple[str, bool]]):
        self.entries = entries

    def __call__(self, namespace: str, index: int):
        return self.entries.get((namespace, index))


def step(restorer: Restorer | None, next_seq: int, waiting: dict[int, tuple[str, bool]], pieces: list[tuple[int, str, bool]]) -> tuple[list[tuple[int, str, bool]], int, bool]:
    """Takes pieces in (without a restorer before the first of them), gives out what is in order: (seq, text, done) rows, the next number, whether the stream is over."""
    for seq, text, last in pieces:
        if seq >= next_seq:
            waiting.setdefault(seq, (text, last))
    out, over = [], False
    while next_seq in waiting and not over:
        text, over = waiting.pop(next_seq)
        released = restorer.push(text or "")
        out.append((next_seq, released + (restorer.end() if over else ""), over))
        next_seq += 1
    return out, next_seq, over


ENTRIES = "array<struct<namespace:string,idx:int,value:string,exact_only:boolean>>"


def _table(entries) -> dict[tuple[str, int], tuple[str, bool]]:
    return {(e["namespace"], int(e["idx"])): (e["value"], bool(e["exact_only"])) for e in (entries if entries is not None else ())}


def restore_stream(pieces: DataFrame, mapping: DataFrame | dict[tuple[str, int], tuple[str, bool]], timeout_ms: int = 600_000, everywhere: bool = False) -> DataFrame:
    """A streaming DataFrame of OUTPUT rows.

    ``mapping``: a table (conv_id, namespace, idx, value, exact_only), by which each stream has the values of its own
    conversation (``pieces`` then has conv_id, a null one meaning the null conversation), or the entries of the one
    conversation of all streams. A conversation's entries, bounded by its numbering, come with the first piece of a stream
    and are kept with its restorer until it is over; after that only a mark is left, until the timeout. A stream that is
    silent for ``timeout_ms`` before its last piece is flushed as far as it is whole, with an error.
    """
    if isinstance(mapping, DataFrame):
        tables = mapping.groupBy(F.col("conv_id").alias("_of")).agg(F.collect_list(F.struct("namespace", "idx", "value", "exact_only")).cast(ENTRIES).alias("entries"))
        whole = pieces.join(tables, F.col("conv_id").eqNullSafe(F.col("_of")) & (F.col("seq") == 0), "left")
        fixed = None
    else:
        whole, fixed = pieces.withColumn("entries", F.lit(None).cast(ENTRIES)), mapping
    whole = whole.select("stream_id", "kind", "seq", "text", "last", "entries")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        restorer, next_seq, waiting, done = None, 0, {}, False
        if state.exists:
            raw, next_seq, kept, done = state.get
            restorer, waiting = pickle.loads(bytes(raw)), pickle.loads(bytes(kept))
        if state.hasTimedOut:
            rest = "" if done or restorer is None else restorer.end()
            state.remove()
            if not done:
                yield pd.DataFrame([(*key, next_seq, rest, True, "timeout")], columns=COLUMNS)
            return
        rows = []
        for f in frames:
            for s, t, last, entries in zip(f["seq"], f["text"], f["last"], f["entries"]):
                rows.append((int(s), t, bool(last)))
                if restorer is None and s == 0:
                    restorer = Restorer(TableLookup(_table(entries) if fixed is None else fixed), everywhere)
        out = []
        if not done:
            out, next_seq, done = step(restorer, next_seq, waiting, rows)
        state.update((pickle.dumps(None if done else restorer), next_seq, pickle.dumps({} if done else waiting), done))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([(*key, *r, None) for r in out], columns=COLUMNS)

    return whole.groupBy("stream_id", "kind").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_available(writer: DataStreamWriter, spark: SparkSession) -> None:
    """Runs a stream of restore_stream() over what is there and ends it. Batches without data, which look for timeouts for as
    long as a stream runs, are off for this one; else it would never end."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        query = writer.trigger(availableNow=True).start()  # takes its own copy of the settings
    finally:
        spark.conf.set(key, before)
    query.awaitTermination()
