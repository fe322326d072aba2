"""Rules and merging against cases made by hand."""

import hashlib

import pytest

from meterloom.operators.components import components
from meterloom.plans import traces
from meterloom.sources.sessions import EVENT_COLUMNS, shaped


SCHEMA = (
    "run_id string, event_id string, kind string, name string, model string, status string, start_ms bigint, end_ms bigint, seq bigint, parent_id string, tool_call_id string, tokens_in bigint, tokens_out bigint, "
    "result_hash string, result_bytes bigint, args_hash string, token_basis string, scope string, tags array<string>, included array<string>, args_label string, result_label string"
)


def events(spark, *rows):
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return shaped(spark.createDataFrame([tuple({"run_id": "r", **row}.get(n) for n in names) for row in rows], SCHEMA))


def tool(i, start, end, **more):
    return {"event_id": f"t{i}", "kind": "tool", "name": "grep", "args_hash": "a", "result_hash": "h", "result_bytes": 10, "start_ms": start, "end_ms": end, "seq": i, "status": "ok", **more}


def call(i, start, tokens, **more):
    return {"event_id": f"m{i}", "kind": "model", "name": "chat", "model": "x", "token_basis": "input", "tokens_in": tokens, "start_ms": start, "end_ms": start + 1, "seq": 100 + i, **more}


def judged(spark, cases, **limits):
    """Findings of cases (a list of rows each), all at once, each case being a run of its own."""
    rows = [{**row, "run_id": str(i)} for i, case in enumerate(cases) for row in case]
    findings, _ = traces.run_rules(events(spark, *rows), limits=limits)
    found = [set() for _ in cases]
    for r in findings.collect():
        found[int(r.run_id)].add((r.rule, tuple(r.evidence)))
    return found


def check(spark, *cases, **limits):
    assert judged(spark, [rows for rows, _ in cases], **limits) == [expected for _, expected in cases]


def test_no_progress(spark):
    chain = [tool(i, i * 10, i * 10 + 5) for i in range(3)]
    aside = [tool(0, 0, 20), tool(1, 10, 15), tool(2, 20, 25), tool(3, 30, 35)]  # one overlaps and stands aside
    check(
        spark,
        ([*chain], {("no_progress", ("t0", "t1", "t2"))}),
        ([*[tool(i, 0, 5) for i in range(3)]], set()),
        ([*[tool(i, i * 10, i * 10 + 5, result_hash=f"h{i}") for i in range(3)]], set()),
        ([*aside], {("no_progress", ("t0", "t2", "t3"))}),
        ([*[{**row, "scope": f'{{"n":{i}}}'} for i, row in enumerate(chain)]], set()),
        ([*[{**row, "tags": ["polling"]} for row in chain]], set()),
        ([*[{**row, "result_label": "redacted"} for row in chain]], set()),
        ([*[{**row, "start_ms": None, "end_ms": None} for row in chain]], {("no_progress", ("t0", "t1", "t2"))}),  # by seq
    )


def test_retry_after_failure(spark):
    failed = [tool(i, i * 10, i * 10 + 5, status="error", result_hash=None, tool_call_id=f"c{i}") for i in range(5)]
    between = {"event_id": "m", "kind": "model", "start_ms": 7, "end_ms": 8, "seq": 9}
    again = {**between, "event_id": "n", "start_ms": 37, "end_ms": 38}
    later = {**between, "event_id": "o", "start_ms": 27, "end_ms": 28}
    check(
        spark,
        ([*failed[:2]], set()),
        ([failed[0], between, failed[1]], {("retry_after_failure", ("t0", "t1", "m"))}),
        ([*failed[:3]], {("retry_after_failure", ("t0", "t1", "t2"))}),
        ([*failed, between, again, later], {("retry_after_failure", ("t0", "t1", "t2", "t3", "t4")), ("retry_after_failure", ("t2", "t3", "t4", "o", "n"))}),  # the longest chain alone
        ([failed[0], between, {**failed[1], "scope": '{"a":1}'}], set()),
        ([failed[0], between, {**failed[1], "tags": ["backoff"]}], set()),
        ([failed[0], between, {**failed[1], "tool_call_id": "c0"}], set()),
        ([*[{**row, "status": "unknown"} for row in failed]], set()),
    )
    check(spark, ([*failed, between, again, later], set()), retry_after_failure={"strong": 4, "weak": 9})


def test_context_growth(spark):
    check(
        spark,
        ([call(0, 0, 1000), tool(7, 2, 3), call(1, 5, 12_000)], {("context_growth", ("m0", "m1", "t7"))}),
        ([call(0, 0, 1000), call(1, 5, 12_000, token_basis="other")], set()),
        ([call(0, 0, 1000), call(1, 5, 12_000, model="y")], set()),
        ([call(0, 0, 30_000), call(1, 5, 39_000)], set()),
        ([call(0, 0, 1000), call(1, 5, 90_000, name="Query Router"), call(2, 9, 1200)], set()),
        ([call(0, 0, 1000), call(1, 5, 90_000, tags=["compaction"]), call(2, 9, 12_000)], {("context_growth", ("m0", "m2"))}),
        ([call(0, 0, 1000), call(1, 5, 90_000, token_basis=None), call(2, 9, 12_000)], set()),
        ([tool(3, 0, 1), call(0, 2, 1000), call(1, 5, 12_000, included=["t3"])], {("context_growth", ("m0", "m1", "t3"))}),
    )


def test_large_and_repeated_results(spark):
    big = [tool(i, 0, 5, result_bytes=70_000, args_hash=f"a{i}") for i in range(3)]
    check(
        spark,
        ([*big], {("repeated_result", ("t0", "t1", "t2")), *[("oversized_result", (f"t{i}",)) for i in range(3)]}),
        ([*[{**row, "tags": ["large_read", "reread"]} for row in big]], set()),
        ([call(0, 0, 1000), big[0], call(1, 6, 1500), call(2, 8, 1600)], {("oversized_result", ("t0", "m1"))}),
    )
    check(spark, (big[:2], {("repeated_result", ("t0", "t1"))}), repeated_result={"times": 2}, oversized_result={"bytes": 10**6})
    with pytest.raises(ValueError):
        judged(spark, [big], repeated_result={"tims": 2})


def test_coverage_and_exit(spark):
    findings, coverage = traces.run_rules(events(spark, {"event_id": "m", "kind": "model", "tokens_in": 4, "start_ms": 1}))
    assert {r.state for r in coverage.collect()} == {"abstained"}  # no basis, no model, no tool
    assert traces.exit_code(findings, coverage) == 3
    findings, coverage = traces.run_rules(events(spark, call(0, 1, 5), call(1, 2, 6, token_basis=None)))
    assert {r.rule: (r.state, r.missing) for r in coverage.collect()}["context_growth"] == ("partial", [])
    assert traces.exit_code(findings, coverage) == 0


def test_evidence_has_to_be_in_the_run(spark):
    rows = events(spark, tool(0, 0, 5))
    findings = spark.createDataFrame([("r", "x", "p", 1, ["t0"]), ("r", "x", "q", 1, ["t0", "lost"])], "run_id string, rule string, pattern string, size bigint, evidence array<string>")
    good, errors = traces.cited(findings, rows)
    assert [r.pattern for r in good.collect()] == ["p"] and [r.pattern for r in errors.collect()] == ["q"]


def test_conflicts(spark):
    rows = events(spark, tool(1, 1, 4, tool_call_id="c"), tool(2, 1, 9, tool_call_id="c", name="find"), tool(3, 1, 2))
    assert [(r.event_id, r.fields) for r in traces.conflicts(rows).collect()] == [("t1", ["name", "end_ms", "seq"])]


def test_merging_is_transitive_and_fills_gaps(spark):
    rows = [tool(1, 1, None, tool_call_id="c", name=None), {**tool(2, None, 9, tool_call_id="c"), "args_hash": None}, {**tool(2, 2, None, tool_call_id="d")}, tool(3, 3, 4, tool_call_id="d"), tool(5, 7, 8)]
    merged = traces.merged(events(spark, *rows)).collect()
    assert len(merged) == 2 and sorted(r.end_ms for r in merged) == [4, 8]
    assert len(traces.merged(events(spark, *rows[:2])).collect()) == 1
    again = traces.merged(traces.merged(events(spark, *rows)))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, merged), key=str) and again.columns == list(EVENT_COLUMNS)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(50, 60), (60, 70), (80, 80)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 60: 50, 70: 50}


def test_duplicates_are_folded_pairwise(spark):
    base = {"event_id": "e", "kind": "tool", "tool_call_id": "c", "name": "grep"}
    rows = [
        {**base, "status": "ok", "start_ms": 1, "scope": '{"a":{"x":1,"y":"1"},"b":{"z":[2]}}', "included": ["q", "p"]},
        {**base, "status": "unknown", "start_ms": 2, "end_ms": 9, "seq": 4, "error_type": None, "model": "m", "result_hash": "h", "result_bytes": 3, "args_hash": "k", "tokens_in": 1, "tokens_out": 2, "scope": '{"a":{"x":"own"},"c":{}}', "included": ["p", "r"]},
        {**base, "status": "unknown", "start_ms": 2, "end_ms": 9, "seq": 4, "error_type": None, "model": "m", "result_hash": "h", "result_bytes": 3, "args_hash": "k", "tokens_in": 1, "tokens_out": 2, "scope": '{"a":{"x":"own"},"c":{}}', "included": ["p", "r"]},
        {**base, "event_id": "late", "name": "other", "status": "error", "start_ms": None},
    ]
    (found,) = traces.merged(events(spark, *rows)).collect()
    # The second row is the richest and unknown, so the first one's status stands; its own names win in both levels.
    assert (found.event_id, found.status, found.start_ms, found.end_ms, found.name) == ("e", "ok", 2, 9, "grep")
    assert found.scope == '{"a":{"x":"own","y":"1"},"b":{"z":[2]},"c":{}}' and found.included == ["p", "r", "q"]
    (told,) = traces.conflicts(events(spark, *rows)).collect()
    assert set(told.fields) == {"name", "start_ms", "status"}


def test_findings_of_one_pattern_unite_their_evidence(spark):
    rows = [tool(i, i * 10, i * 10 + 5) for i in range(5)]
    one = lambda *ids: spark.createDataFrame([("r", "rule", "p", len(ids), list(ids))], "run_id string, rule string, pattern string, size bigint, evidence array<string>")
    (found,) = traces.collapsed(one("t3", "t1").unionByName(one("t0", "t3", "gone")), events(spark, *rows)).collect()
    assert found.evidence == ["t0", "t1", "t3", "gone"] and found.size == 3
    prints = {r.fingerprint for ids in (("t1", "t3"), ("t3", "t1")) for r in traces.fingerprinted(one(*ids)).collect()}
    payload = '{"evidence":["t1","t3"],"rule_id":"rule","run_id":"r","thresholds":{}}'
    assert prints == {hashlib.sha256(payload.encode()).hexdigest()}
