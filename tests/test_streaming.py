from maskwell.operators.redact import redact_texts
from maskwell.streaming.restore_stream import restore_stream, run_available


def test_pieces_of_two_streams_are_restored(spark, tmp_path):
    _, mapping = redact_texts(["mail a@example.com pan ABCPE1234F"])
    entries = {(n, i): (v, i in m.exact_only) for n, m in mapping.items() for i, v in m.values.items()}
    schema = "stream_id string, kind string, seq long, text string, last boolean"
    rows = [("s1", "content", 1, "IL_1]!", True), ("s1", "content", 0, "to [EMA", False), ("s2", "content", 0, "[PAN", False), ("s2", "content", 1, "_1] http://x/[PAN_1]", False), ("s2", "content", 1, "again", False), ("s2", "content", 2, " end", True), ("s2", "refusal", 0, "no", True)]
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    pieces = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run_available(restore_stream(pieces, entries).writeStream.format("memory").queryName("restored").outputMode("append").option("checkpointLocation", f"{tmp_path}/state"), spark)
    got = {}
    for r in spark.table("restored").orderBy("stream_id", "kind", "seq").collect():
        got[r.stream_id, r.kind] = got.get((r.stream_id, r.kind), "") + r.text
    assert got == {("s1", "content"): "to a@example.com!", ("s2", "content"): "ABCPE1234F http://x/[PAN_1] end", ("s2", "refusal"): "no"}


def test_each_stream_has_the_values_of_its_own_conversation(spark, tmp_path):
    schema = "stream_id string, kind string, conv_id long, seq long, text string, last boolean"
    rows = [("s1", "content", 1, 1, "IL_1]!", True), ("s1", "content", 1, 0, "to [EMA", False), ("s2", "content", 2, 0, "to [EMAIL_1]!", True), ("s3", "content", None, 0, "to [EMAIL_1]!", True), ("s4", "content", 4, 0, "[EMAIL_1]", True)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    mapping = spark.createDataFrame([(1, "EMAIL", 1, "a@x.org", False), (2, "EMAIL", 1, "b@x.org", False), (None, "EMAIL", 1, "n@x.org", False)], "conv_id long, namespace string, idx int, value string, exact_only boolean")
    pieces = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    run_available(restore_stream(pieces, mapping).writeStream.format("memory").queryName("own_values").outputMode("append").option("checkpointLocation", f"{tmp_path}/state"), spark)
    got = {}
    for r in spark.table("own_values").orderBy("stream_id", "seq").collect():
        got[r.stream_id] = got.get(r.stream_id, "") + r.text
    assert got == {"s1": "to a@x.org!", "s2": "to b@x.org!", "s3": "to n@x.org!", "s4": "[EMAIL_1]"}
