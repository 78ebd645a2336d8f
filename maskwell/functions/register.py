"""The engine in SQL: a table function ``detect_spans(text)`` and scalar functions over values and texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.placeholders import value_key
from ..operators.redact import redact_texts
from ..operators.resolve import detect_text


class DetectSpans:
    def eval(self, text: str):
        for s in detect_text(text or ""):
            yield s.type, s.start, s.end, s.validated, bool(s.context)


def register(spark: SparkSession) -> None:
    """Registers detect_spans (a table function), value_key(type, surface) and redact_text(text)."""
    spark.udtf.register("detect_spans", F.udtf(DetectSpans, returnType="type string, start int, end int, validated boolean, context boolean"))

    @F.pandas_udf("string")
    def key(kind: pd.Series, surface: pd.Series) -> pd.Series:
        return pd.Series([None if k is None or s is None else value_key(k, s) for k, s in zip(kind, surface)])

    @F.pandas_udf("string")
    def redacted(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redact_texts([t])[0][0] for t in text])

    spark.udf.register("value_key", key)
    spark.udf.register("redact_text", redacted)
