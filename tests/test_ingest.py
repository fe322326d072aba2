"""Streams and batches give the same ledger; transcripts and traces the same event model."""

import json

from pyspark.sql import functions as F

from meterloom.operators.canonical import winner
from meterloom.sources import sessions
from meterloom.streaming import ingest

SCHEMA = "key string, hash string, calls bigint, observed_at timestamp"
ROWS = [("a", "h1", 1, "2024-01-01 00:00:00"), ("a", "h2", 3, "2024-01-01 01:00:00"), ("b", "h3", 2, "2024-01-01 00:30:00"), ("a", "h1", 1, "2024-01-01 00:00:00"), ("c", "h9", 1, "2999-01-01 00:00:00"), (None, "h8", 1, "2024-01-01 00:00:00")]


def test_stream_is_the_batch_whatever_the_order(spark, tmp_path):
    found = []
    for turn, rows in enumerate((ROWS, ROWS[::-1])):
        base = tmp_path / str(turn)
        for i, row in enumerate(rows):
            spark.createDataFrame([row], "key string, hash string, calls bigint, observed_at string").withColumn("observed_at", F.col("observed_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{base}/in")
        append = ingest.appender(f"{base}/bronze", f"{base}/bad", revision=["key", "hash"], required=["key"], time="observed_at")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
        for _ in range(2):
            ingest.start(stream, append, f"{base}/check").awaitTermination()
        found.append(sorted(map(tuple, ingest.winners(spark, f"{base}/bronze", ["key"], ["calls", "observed_at", "hash"]).collect())))
        assert spark.read.parquet(f"{base}/bronze").count() == 3
        assert sorted(r.reason for r in spark.read.parquet(f"{base}/bad").collect()) == ["clock_ahead", "missing_key"]
    later = ingest.released(spark, f"{base}/bad", F.lit("3000-01-01").cast("timestamp"), time="observed_at", required=["key"])
    assert [(r.key, r.hash) for r in later.collect()] == [("c", "h9")]
    batch = spark.createDataFrame(ROWS[:3], "key string, hash string, calls bigint, observed_at string").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    assert found[0] == found[1] == sorted(map(tuple, winner(batch, ["key"], ["calls", "observed_at", "hash"]).collect()))


def _line(kind, second, message, **more):
    return json.dumps({"type": kind, "sessionId": "s", "timestamp": f"2024-01-01T00:00:{second:02}Z", "isSidechain": False, "message": message} | more)


def test_sessions(spark, tmp_path):
    use = {"type": "tool_use", "id": "t1", "name": "read", "input": {"path": "x"}}
    lines = [
        _line("assistant", 1, {"id": "m1", "model": "m", "content": [use], "usage": {"input_tokens": 5, "output_tokens": 1}}),
        _line("assistant", 2, {"id": "m1", "model": "m", "content": [], "usage": {"input_tokens": 5, "output_tokens": 9}}),
        _line("user", 3, {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "twelve bytes", "is_error": True}]}),
        _line("assistant", 4, {"id": "m2", "model": "m", "content": []}, isSidechain=True, agentId="side"),
        '{"type": "assistant", "sess',
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    rows, problems = sessions.parsed(sessions.lines(spark, str(tmp_path), ("assistant", "tool_result")), sessions.SESSION_LINE)
    found = {r.event_id: r for r in sessions.session_events(rows).collect()}
    assert problems.count() == 1 and set(found) == {"m1", "m2", "t1"}
    assert (found["m1"].tokens_in, found["m1"].tokens_out, found["m2"].run_id) == (5, 9, "s/side")
    assert (found["t1"].name, found["t1"].status, found["t1"].result_bytes, found["t1"].end_ms - found["t1"].start_ms) == ("read", "error", 12, 2000)


def test_a_ledger_that_cannot_be_read_is_an_error(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException

    (tmp_path / "bronze").mkdir()
    (tmp_path / "bronze" / "x.parquet").write_text("no parquet")
    append = ingest.appender(str(tmp_path / "bronze"), str(tmp_path / "bad"), revision=["key"], required=["key"], time="observed_at")
    rows = spark.createDataFrame([("a", "h", 1, None)], SCHEMA)
    with pytest.raises(Exception) as raised:
        append(rows, 0)
    assert not isinstance(raised.value, AnalysisException) or raised.value.getCondition() != "PATH_NOT_FOUND"


def test_a_failure_outweighs_a_later_result(spark, tmp_path):
    use = {"type": "tool_use", "id": "t1", "name": "read", "input": {}}
    result = lambda error: {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "x", "is_error": error}]}
    lines = [_line("assistant", 1, {"id": "m1", "model": "m", "content": [use]}), _line("user", 2, result(True)), _line("user", 3, result(False))]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    rows, _ = sessions.parsed(sessions.lines(spark, str(tmp_path)), sessions.SESSION_LINE)
    assert {r.event_id: r.status for r in sessions.session_events(rows).collect()}["t1"] == "error"
