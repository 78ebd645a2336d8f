"""Every query of the engine by name, with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.register import register
from ..operators import evaluation, redact
from ..sources.tables import table
from ..sources.written import shared_folder, spread
from ..streaming.restore_stream import restore_stream, run_available
from . import native

FLAGSHIP = "detections_by_type"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detection in the documents: type, place, proof and context."""
    found = redact.detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), keep=["doc_id"])
    return found.select("doc_id", F.inline("detections"))


def detections_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections by language and type."""
    found = redact.detect(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), keep=["doc_id", "lang"])
    d = found.select("doc_id", "lang", F.inline("detections"))
    return d.groupBy("lang", "type").agg(F.count(F.lit(1)).alias("n"), F.count_if("validated").alias("n_validated"), F.count_if("context").alias("n_context"), F.countDistinct("doc_id").alias("docs"))


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, each message with one of three addresses of its conversation at its end; PLANTED says it in SQL."""
    own = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    address = F.concat(F.lit(" write to u"), F.col("conv_id"), F.lit("n"), F.pmod("turn", F.lit(3)), F.lit("@example.org now"))
    return own.withColumn("text", F.concat(F.coalesce("text", F.lit("")), address))


#: The same messages, the address of each, and its number by first appearance.
PLANTED = """
WITH own AS (
  SELECT conv_id, turn, role, coalesce(text, '') || ' write to ' AS head, 'u' || conv_id || 'n' || (turn % 3) || '@example.org' AS value
  FROM conversations),
first AS (SELECT conv_id, value, min(turn) AS since FROM own GROUP BY conv_id, value),
numbered AS (SELECT conv_id, value, row_number() OVER (PARTITION BY conv_id ORDER BY since) AS idx FROM first)
"""


def redacted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, with planted addresses, with placeholders for their values."""
    return redact.redact_conversations(_planted(spark, sf_dir))[0]


def conversation_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which placeholder stands for which value, in the conversations with planted addresses."""
    return redact.redact_conversations(_planted(spark, sf_dir))[1]


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with a planted address redacted and restored again, and how many placeholders were."""
    hidden, mapping = redact.redact_conversations(_planted(spark, sf_dir))
    back = redact.restore_answers(hidden, mapping, everywhere=True)
    return back.select("conv_id", "text", F.col("restored").cast("long").alias("restored"))


def restore_stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted conversations with planted addresses sent as streams, each message in two pieces, and restored piecewise."""
    hidden, mapping = redact.redact_conversations(_planted(spark, sf_dir))
    order = Window.partitionBy("conv_id").orderBy("turn")
    numbered = hidden.withColumn("n", F.row_number().over(order)).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    half = F.floor(F.length("text") / 2).cast("int")
    both = F.array(F.struct((2 * F.col("n") - 2).cast("long").alias("seq"), F.substring("text", F.lit(1), half).alias("text")), F.struct((2 * F.col("n") - 1).cast("long").alias("seq"), F.substring("text", half + 1, F.length("text")).alias("text")))
    pieces = numbered.select(F.col("conv_id").cast("string").alias("stream_id"), F.lit("content").alias("kind"), "conv_id", "of", F.explode(both).alias("p"))
    pieces = pieces.select("stream_id", "kind", "conv_id", "p.seq", "p.text", (F.col("p.seq") == 2 * F.col("of") - 1).alias("last"))
    folder = f"{shared_folder(spark)}/maskwell/stream-{uuid.uuid4().hex}"
    pieces.write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema(pieces.schema).parquet(f"{folder}/in")
    run_available(restore_stream(arriving, mapping, everywhere=True).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state"), spark)
    out = spark.read.parquet(f"{folder}/out")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return out.groupBy("stream_id").agg(joined.alias("text"), F.count_if("done").alias("done"), F.count("error").alias("errors"))


def generated_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of detection over 500 generated cases, by type."""
    cases = evaluation.labelled_cases(spark, 500)
    return evaluation.score(cases, redact.detect(cases, keep=["case_id"]))


def generated_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of 500 generated cases that are still in the redacted text as written, by type."""
    cases = evaluation.labelled_cases(spark, 500)
    as_messages = cases.select(F.col("case_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), "text")
    hidden = redact.redact_conversations(as_messages)[0]
    return evaluation.sent_values(cases, hidden.select(F.col("conv_id").alias("case_id"), "text"))


def generated_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 generated cases redacted and sent back: messages that return exactly, placeholders restored and held back."""
    own = evaluation.echo(evaluation.labelled_cases(spark, 500))
    return own.agg(F.count(F.lit(1)).alias("messages"), F.count_if("exact").alias("exact"), F.sum("restored").alias("restored"), F.sum("held_back").alias("held_back"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function and the scalar functions from SQL."""
    register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("maskwell_documents")
    return spark.sql("SELECT d.doc_id, s.type, s.start, s.`end`, value_key(s.type, substring(d.text, s.start + 1, s.`end` - s.start)) AS key FROM maskwell_documents d, LATERAL detect_spans(d.text) s")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {f.__name__: f for f in (detections_by_type, detections, redacted_conversations, conversation_mapping, round_trip, restore_stream_equals_batch, generated_score, generated_sent, generated_echo, sql_functions)}
    return own | native.QUERIES


def oracle_sql() -> dict[str, str]:
    return native.SQL | {
        "redacted_conversations": PLANTED + "SELECT o.conv_id, o.turn, o.role, o.head || '[EMAIL_' || n.idx || '] now' AS text FROM own o JOIN numbered n USING (conv_id, value)",
        "conversation_mapping": PLANTED + "SELECT conv_id, 'EMAIL' AS namespace, idx::INTEGER AS idx, value AS key, value, false AS exact_only FROM numbered",
        "restore_stream_equals_batch": PLANTED + "SELECT conv_id::VARCHAR AS stream_id, string_agg(head || value || ' now', '' ORDER BY turn) AS text, 1::BIGINT AS done, 0::BIGINT AS errors FROM own GROUP BY conv_id",
        "round_trip": PLANTED + "SELECT conv_id, head || value || ' now' AS text, 1::BIGINT AS restored FROM own",
    }
