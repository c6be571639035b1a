"""Repeated questions on a table that has some, and first-seen rows of a stream."""

import datetime as dt

from corvane.plans import dialog
from corvane.streaming import limits


def test_repeated_questions(spark, tmp_path):
    turns = [(1, 0, "user", "What is  A?"), (1, 1, "assistant", "x"), (1, 2, "user", "what is a? [1]"), (1, 3, "user", "What is B?"), (1, 4, "user", "WHAT IS A?"), (2, 0, "user", "what is a?"), (2, 1, "user", "What is a?"), (2, 2, "assistant", "y"), (3, 0, "user", None), (3, 1, "user", None)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, dialog.repeated_questions(spark, str(tmp_path)).collect()))
    # a text that is null has no question, but two of them are equal
    assert got == [(1, 2, 0, True), (1, 4, 2, False), (2, 1, 0, False), (3, 1, 0, False)]


def test_first_seen_stream(spark, tmp_path):
    schema, start = "event_id bigint, ts timestamp, user_id bigint", dt.datetime(2024, 1, 1)
    batches = [[(1, 0, 7), (2, 5, 7), (3, 6, 8)], [(4, 30, 7), (5, 31, 9)], [(6, 200, 10)], [(7, 205, 7), (8, 206, 10)]]
    out = str(tmp_path / "out")
    for n, batch in enumerate(batches):
        spark.createDataFrame([(i, start + dt.timedelta(minutes=m), u) for i, m, u in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = limits.first_seen(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["user_id"], "1 hour")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    seen = sorted(r.event_id for r in spark.read.parquet(out).collect())
    # within the hour a user counts once, in one batch and over batches; the watermark of the third batch forgets user 7
    assert seen in ([1, 3, 5, 6, 7], [2, 3, 5, 6, 7])
