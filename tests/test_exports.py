"""Bundles, tables of observations and what a file's beginning tells."""

import json

from pyspark.sql import functions as F

from meterloom.plans import traces
from meterloom.sources import exports

GOOD = {"id": "a", "kind": "tool_call", "status": "ok", "seq": 1, "name": "grep", "args_fingerprint": {"hash": "0a", "representation": "full"}, "scope": {"app": {"b": 1, "a": 2}}, "included_result_ids": ["x"]}


def frame(spark, *documents):
    return spark.createDataFrame([(f"f{i}", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)], "file string, value string")


def test_bundles(spark):
    records = [GOOD, {**GOOD, "id": "b", "nam": "x"}, {**GOOD, "id": "c", "tokens_in": "5"}, {"id": "d", "kind": "tool_call"}, {**GOOD, "id": "e", "kind": "dance"}, {**GOOD, "id": "f", "args_fingerprint": {"hash": "0a", "representation": "most"}}, {"id": "g", "kind": "model_call", "status": "ok", "tokens_in": 7}]
    whole = {"schema_version": "1", "run_id": "r", "records": records}
    events, problems = exports.bundles(frame(spark, whole, {**whole, "schema_version": "9"}, "{", {"schema_version": "1", "records": []}))
    assert {(r.event_id, r.kind, r.name, r.args_hash, r.args_label, r.scope, r.tokens_in, tuple(r.included)) for r in events.collect()} == {
        ("a", "tool", "grep", "0a", "full", '{"app":{"a":2,"b":1}}', None, ("x",)),
        ("g", "model", None, None, None, "{}", 7, ()),
    }
    assert {(r.file, r.pointer, r.problem) for r in problems.collect()} == {
        ("f0", "/records/1", "unknown:nam"),
        ("f0", "/records/2", "type:tokens_in"),
        ("f0", "/records/3", "missing:status"),
        ("f0", "/records/4", "kind"),
        ("f0", "/records/5", "fingerprint:args"),
        ("f1", "", "unknown_version"),
        ("f2", "", "not_json"),
        ("f3", "", "no_run_id"),
    }


def test_a_bundle_of_events_gives_the_same_events(spark):
    events = traces.fixture(spark, "/root/testdata/sf0.001").where("run_id IN ('u1', 'u2')")
    events = events.withColumns({c: F.sha2(c, 256) for c in ("args_hash", "result_hash")})
    again, problems = exports.bundles(exports.as_bundle(events).withColumn("file", F.lit("f")))
    columns = [c for c in events.columns if c != "tags"]
    assert problems.count() == 0 and events.count() > 20
    assert sorted(map(str, again.select(columns).collect())) == sorted(map(str, events.select(columns).collect()))


def test_tables_of_observations(spark, tmp_path):
    (tmp_path / "o.csv").write_text('id,traceId,type,usageDetails.input,usageDetails.cached_tokens,metadata,startTime,level\no1,t,GENERATION,12,3,,2024-01-01T00:00:00Z,\no2,t,SPAN,,,"{""tool_name"": ""x"", ""tool_call_id"": ""c9""}",2024-01-01T00:00:01Z,ERROR\n,t,SPAN,,,,,\n')
    events, problems = exports.observations(exports.csv_parts(spark, str(tmp_path / "o.csv")))
    found = {r.event_id: (r.kind, r.tokens_in, r.cache_read, r.tool_call_id, r.status, r.start_ms) for r in events.collect()}
    assert found == {"o1": ("model", 12, 3, None, "unknown", 1704067200000), "o2": ("tool", None, None, "c9", "error", 1704067201000)}
    assert problems.count() == 1


def test_pages_that_are_broken(spark):
    pages = frame(spark, {"data": [{"starting_at": "x", "results": []}, {"starting_at": "2024-01-01T00:00:00Z"}, {"starting_at": "2024-01-01T00:00:00Z", "results": [{"model": "m"}]}]}, {"error": 1}, "[")
    rows, problems = exports.usage_page(pages, "anthropic")
    assert [(r.model, r.input_fresh, str(r.bucket_end)) for r in rows.collect()] == [("m", None, "2024-01-01 01:00:00")]
    assert sorted(r.problem for r in problems.collect()) == ["bad_bucket", "bad_bucket", "no_data", "no_data"]


def test_formats_by_their_beginning(spark):
    span, session = '{"resourceSpans": []}', '{"type": "user", "sessionId": "s"}'
    heads = [(span, "json", "otlp-json"), (span + "\n" + span, "jsonl", "otlp-jsonl"), ("{\n " + span[1:], "json", "otlp-json"), ('[{"traceId": "t", "startTime": "x"}]', "json", "observations"), ('"id",traceId,type,usage.input\n1,2,3,4', "csv", "observations"), ('{"schema_version": "1", "run_id": "r", "records": []}', "json", "record-bundle"), (session + "\n" + session, "jsonl", "session"), ("hello", "txt", None), ("", "json", None)]
    rows = spark.createDataFrame([(h, s) for h, s, _ in heads], "head string, suffix string").select(exports.sniffed(F.col("head"), F.col("suffix")).alias("f"))
    assert [r.f for r in rows.collect()] == [f for _, _, f in heads]


def test_pages_are_read_in_one_pass(spark):
    """Odd elements stand alone, and no plan asks a text for one path after another."""
    start, results = "2024-01-01T00:00:00Z", [5, None, {"model": {"a": 1}, "requests": "7", "output_tokens": 5.0, "cache_creation": 5, "cache_creation_input_tokens": 9}]
    pages = frame(spark, {"data": [7, {"starting_at": start, "results": results}], "usageEvents": [5, {"timestamp": start, "tokenUsage": 7, "input_tokens": 8}]})
    rows, problems = exports.usage_page(pages, "anthropic")
    assert [tuple(r)[2:] for r in rows.where("model IS NOT NULL").collect()] == [('{"a":1}', None, None, 7, None, None, 9, 5)]
    assert rows.count() == 3 and [r.problem for r in problems.collect()] == ["bad_bucket"]
    events, odd = exports.event_page(pages)
    assert [(r.input_fresh, r.total) for r in events.collect()] == [(8, 8)] and odd.count() == 1
    for found in (rows, events, exports.cost_page(pages, "anthropic"), exports.observations(frame(spark, {"id": "a", "traceId": "t"}))[0]):
        assert "get_json_object" not in found._jdf.queryExecution().optimizedPlan().toString()
