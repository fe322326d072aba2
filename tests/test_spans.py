"""Spans of whole documents and lines, older names, nested attributes, kinds, runs and problems."""

import hashlib
import json

from meterloom.sources import spans


def at(k, v):
    kind = "stringValue" if isinstance(v, str) else "boolValue" if isinstance(v, bool) else "intValue" if isinstance(v, int) else "doubleValue" if isinstance(v, float) else None
    return {"key": k, "value": {kind: str(v) if kind == "intValue" else v} if kind else v}


def span(i, parent=None, trace="t", start=0, attrs=(), **more):
    held = {"traceId": trace, "spanId": i, "name": f"n{i}", "startTimeUnixNano": str(1_704_067_200_000_000_000 + start * 10**6), "endTimeUnixNano": str(1_704_067_200_500_999_999 + start * 10**6), "attributes": [at(*a) for a in attrs]}
    return held | ({"parentSpanId": parent} if parent else {}) | more


def envelope(*found, resource=(), older=False):
    name = "instrumentationLibrarySpans" if older else "scopeSpans"
    return {"resourceSpans": [{"resource": {"attributes": [at(*a) for a in resource]}, name: [{"spans": list(found)}]}]}


def events(spark, *documents, **options):
    rows = [(f"f{i}", 0, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    found, problems = spans.span_events(spark.createDataFrame(rows, "file string, pos bigint, value string"), **options)
    return {(r.run_id, r.event_id): r for r in found.collect()}, sorted((r.file, r.pointer, r.problem) for r in problems.collect())


MODEL = [("gen_ai.operation.name", "chat"), ("gen_ai.request.model", "asked"), ("gen_ai.response.model", "m"), ("gen_ai.usage.prompt_tokens", 7), ("gen_ai.usage.completion_tokens", 2)]
SHA = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_kinds_fields_and_runs(spark):
    args = {"path": "a long enough path", "n": [1, 2.5, True]}
    kvlist = {"kvlistValue": {"values": [{"key": "path", "value": {"stringValue": "a long enough path"}}, {"key": "n", "value": {"arrayValue": {"values": [{"intValue": "1"}, {"doubleValue": 2.5}, {"boolValue": True}]}}}]}}
    reasons = {"arrayValue": {"values": [{"stringValue": "stop"}, {"stringValue": "length"}]}}
    first = envelope(
        span("root", attrs=[("gen_ai.conversation.id", "c")]),
        span("agent", "root", attrs=[("gen_ai.request.model", "m")]),
        span("one", "agent", attrs=[*MODEL, ("gen_ai.response.finish_reasons", reasons)]),
        span("two", "agent", attrs=[*MODEL, ("gen_ai.usage.input_tokens", 9)], status={"code": 2}),
        span("call", "one", start=5, attrs=[("gen_ai.tool.name", "grep"), ("gen_ai.tool.call.id", "id1"), ("gen_ai.tool.call.arguments", kvlist), ("gen_ai.tool.call.result", "é twelve bytes!!")]),
        span("plain", "one", attrs=[("gen_ai.operation.name", "execute_tool"), ("gen_ai.tool.call.arguments", json.dumps(args))], events=[{"name": "gen_ai.tool.message", "attributes": [at("content", "from the event itself")]}]),
        span("idle", "one", attrs=[("gen_ai.tool.name", "wait")]),
    )
    second = envelope(span("x", trace="u", attrs=MODEL), span("y", "x", trace="u"), resource=[("app.run", "app-1")], older=True)
    third = envelope(span("p", trace="w"), span("q", trace="w", attrs=[("gen_ai.conversation.id", "only")]), span("r", "gone", trace="v", attrs=MODEL[:2], status={"code": "STATUS_CODE_OK"}))
    got, problems = events(spark, first, second, third, run_attribute="app.run", token_basis="basis")
    assert problems == []
    assert {k: r.kind for k, r in got.items()} == {("c", "root"): "aggregate", ("c", "agent"): "aggregate", ("c", "one"): "model", ("c", "two"): "model", ("c", "call"): "tool", ("c", "plain"): "tool", ("c", "idle"): "tool", ("app-1", "x"): "model", ("app-1", "y"): "other", ("only", "p"): "other", ("only", "q"): "other", ("v", "r"): "model"}
    one, two, call = got["c", "one"], got["c", "two"], got["c", "call"]
    assert (one.model, one.tokens_in, one.tokens_out, one.finish_reason, one.token_basis, one.status) == ("m", 7, 2, "stop,length", "basis", "ok")
    assert (two.tokens_in, two.status, got["v", "r"].status, got["c", "idle"].status) == (9, "error", "ok", "unknown")
    assert (call.name, call.tool_call_id, call.result_bytes, call.duration_ms, call.args_hash) == ("grep", "id1", 17, 500, SHA(args))
    assert got["c", "plain"].args_hash == call.args_hash and got["c", "plain"].result_bytes == 21 and got["c", "plain"].status == "ok"
    assert call.scope == '{"otlp":{"trace_id":"t"}}' and got["app-1", "y"].token_basis is None


def test_problems_are_told_and_the_rest_is_read(spark):
    bad = {"resourceSpans": [7, {"scopeSpans": {}}, {"scopeSpans": [{"spans": None}, {"spans": [{"spanId": "a"}, {"traceId": "t"}, 3, span("good"), span("odd", attrs=[("a", {"intValue": "1.5"}), ("b", "x")])]}]}]}
    got, problems = events(spark, bad, "{", "[]", {}, {"resourceSpans": 1})
    assert set(got) == {("t", "good"), ("t", "odd")}
    assert problems == [
        ("f0", "/resourceSpans/0", "not_an_object"),
        ("f0", "/resourceSpans/1/scopeSpans", "not_an_array"),
        ("f0", "/resourceSpans/2/scopeSpans/0", "no_spans"),
        ("f0", "/resourceSpans/2/scopeSpans/1/spans/0", "no_trace_id"),
        ("f0", "/resourceSpans/2/scopeSpans/1/spans/1", "no_span_id"),
        ("f0", "/resourceSpans/2/scopeSpans/1/spans/2", "not_an_object"),
        ("f0", "/resourceSpans/2/scopeSpans/1/spans/4", "attributes"),
        ("f1", "", "not_json"),
        ("f2", "", "not_an_object"),
        ("f3", "", "no_resource_spans"),
        ("f4", "", "not_an_array"),
    ]


def test_files_and_lines(spark, tmp_path):
    (tmp_path / "doc.json").write_text("﻿" + json.dumps(envelope(span("a"), span("a2")), indent=2))
    (tmp_path / "lines.jsonl").write_text(json.dumps(envelope(span("b"))) + "\n\nnot json\n" + json.dumps(envelope(span("c", "b"))) + "\n")
    whole, _ = spans.span_events(spans.files(spark, f"{tmp_path}/doc.json", lines=False))
    each, problems = spans.span_events(spans.files(spark, f"{tmp_path}/lines.jsonl", lines=True))
    assert {r.event_id for r in whole.collect()} == {"a", "a2"} and {r.event_id for r in each.collect()} == {"b", "c"} and problems.count() == 1


def test_plain_and_nested_values_are_read_alike(spark):
    values = [{"stringValue": 'q"é\\'}, {"intValue": "-7"}, {"intValue": 8}, {"intValue": "9223372036854775807"}, {"doubleValue": 1.5}, {"boolValue": False}, {"bytesValue": "QQ=="}, {"stringValue": 1}, {"intValue": 1.5}, {"intValue": True}, {"boolValue": "no"}, {}, 3, None]
    listed = [{"key": f"k{i}", "value": v} for i, v in enumerate(values)] + [{"key": "k0", "value": {"stringValue": "again"}}, {"value": {"stringValue": "no key"}}, {"key": 5, "value": {"stringValue": "x"}}]
    df = spark.createDataFrame([(json.dumps(listed),), (json.dumps([*listed, {"key": "list", "value": {"arrayValue": {"values": []}}}]),)], "t string")
    from pyspark.sql import functions as F

    plain, nested = (r.a for r in df.select(spans.attributes(F.try_variant_get(F.parse_json("t"), "$", "array<variant>")).alias("a")).collect())
    loads = lambda held: {k: json.loads(v) for k, v in held.items()}
    assert loads(plain.held) | {"list": []} == loads(nested.held) and plain.faults == nested.faults
    assert loads(plain.held) == {"k0": 'q"é\\', "k1": -7, "k2": 8, "k3": 2**63 - 1, "k4": 1.5, "k5": False, "k6": "QQ=="}
