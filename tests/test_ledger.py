"""Batches, windows, nested calls, residuals, series and projects against cases made by hand."""

from pyspark.sql import functions as F

from meterloom.plans import ledger


def test_batch_verdicts(spark):
    schema = "id int, k string, calls double, tokens double"
    held = spark.createDataFrame([(1, "a", 2.0, 5.0), (2, "a", 1.0, 9.0)], schema)
    rows = [(1, "a", 2.0, 5.0), (3, "a", 2.0, 6.0), (4, "a", 2.0, 5.0), (5, "b", 3.0, 1.0), (6, None, 4.0, 1.0)]
    judged = ledger.batch_verdicts(spark.createDataFrame(rows, schema), held, ["k"], revision="id", order=["calls", "tokens"])
    assert {(r.id, r.verdict, r.gain) for r in judged.collect()} == {(1, "duplicate", 0.0), (3, "advancing", 0.0), (4, "superseded", 0.0), (5, "new_key", 3.0), (6, "new_key", 4.0)}
    nothing = ledger.batch_verdicts(held, held.where("false"), ["k"], revision="id", order=["calls", "tokens"])
    assert {r.verdict for r in nothing.collect()} == {"new_key"}


def test_window_states(spark):
    rows = [
        ("one", "12:00", 10.0), ("pace", "10:00", 10.0), ("pace", "12:00", 30.0), ("fell", "11:00", 40.0), ("fell", "12:00", 30.0),
        ("gap", "08:00", 1.0), ("gap", "12:00", 2.0), ("old", "01:00", 2.0), ("over", "12:00", 101.0), ("null", "12:00", None), ("tie", "12:00", 5.0), ("tie", "12:00", 5.0),
    ]
    readings = spark.createDataFrame([(k, f"2024-01-01 {t}:00", v, i) for i, (k, t, v) in enumerate(rows)], "k string, t string, v double, i int")
    readings = readings.withColumn("t", F.col("t").cast("timestamp")).withColumn("until", F.lit("2024-01-02").cast("timestamp"))
    of = lambda now: {r.k: (r.state, r.reason, r.rate) for r in ledger.window_states(readings, ["k"], value="v", time="t", tie="i", reset="until", now=F.lit(now)).collect()}
    assert of("2024-01-01 12:30:00") == {
        "one": ("usable", None, None), "pace": ("usable", None, 10.0), "fell": ("discontinuous", None, None), "gap": ("discontinuous", None, None),
        "old": ("stale", "too_old", None), "over": ("insufficient", None, None), "null": ("insufficient", None, None), "tie": ("usable", None, 0.0),
    }
    assert of("2024-01-03 00:00:00")["pace"] == ("stale", "reset_passed", None)


def test_nested_calls(spark):
    rows = [(1, None, "exec", 0), (2, None, "exec", 5), (3, 1, "read", 6), (4, 2, "read", 6), (5, 99, "mcp", 6), (6, 99, "read", 6), (7, 3, "read", 7)]
    calls = spark.createDataFrame(rows, "id int, parent int, name string, t int")
    found = ledger.nested_calls(calls, F.col("t") >= 5, key="id", parent="parent", name="name", wrapper="exec", nestable=F.col("name") == "mcp")
    assert {(r.name, r.place, r.calls) for r in found.collect()} == {("exec", "top", 1), ("read", "orphan", 1), ("read", "child", 1), ("mcp", "orphan", 1), ("read", "top", 2)}


def test_residuals(spark):
    rows = [("a", 2.0, 30.0), ("a", 2.0, 0.0), ("b", 1.0, 0.0), ("c", 5.0, 90.0), ("d", None, 1.0), ("e", 4.0, None)]
    found = ledger.residuals(spark.createDataFrame(rows, "k string, p double, l double"), ["k"], points="p", local="l", rate=10.0)
    assert {(r.k, r.reason, r.unobserved) for r in found.collect()} == {("a", None, 10.0), ("b", "too_few_points", None), ("c", "local_exceeds_total", None), ("d", "too_few_points", None), ("e", None, 40.0)}


def test_comparable_series(spark):
    rows = [(0, "in", "x", 1.0), (1, "in", "x", 2.0), (2, None, "x", 9.0), (3, "in", "x", 3.0), (4, "in", "y", 4.0), (5, "in", None, 5.0), (6, "in", None, 6.0)]
    calls = spark.createDataFrame([("k", *row) for row in rows], "k string, at int, basis string, model string, v double")
    found = ledger.comparable_series(calls, ["k"], ["at"], basis="basis", model="model", value="v")
    assert sorted((r.since, r.calls, r.first_value, r.last_value) for r in found.collect()) == [(0, 2, 1.0, 2.0), (3, 1, 3.0, 3.0), (4, 1, 4.0, 4.0), (5, 2, 5.0, 6.0)]


def test_project_states(spark):
    rows = [("i", "s1", "working_directory", "d1"), ("i", "s0", "working_directory", "d1"), ("i", "s0", "remote", "d1"), ("i", "s2", "working_directory", "d1"), ("i", "s3", "none", "d1"), ("j", "s1", "working_directory", "d1")]
    members = [("i", "session", "s1", "project", "p"), ("i", "session", "s2", "project", "gone"), ("i", "working_directory", "d1", "outside_roots", None)]
    found = ledger.project_states(
        spark.createDataFrame(rows, "install string, session string, basis string, directory string"),
        spark.createDataFrame(members, "install string, kind string, member string, resolution string, project string"),
        spark.createDataFrame([("i", "p", "P")], "install string, project string, project_id string"),
        spark.createDataFrame([("i",)], "install string"),
    )
    assert {(r.install, r.session, r.basis, r.state, r.reason, r.project_id) for r in found.collect()} == {
        ("i", "s1", "working_directory", "project", "project", "P"), ("i", "s0", "working_directory", "unassigned", "outside_roots", None), ("i", "s0", "remote", "unknown", "unknown", None),
        ("i", "s2", "working_directory", "unassigned", "missing_project", None), ("i", "s3", "none", "no_project", "no_project", None), ("j", "s1", "working_directory", "not_reported", "not_reported", None),
    }


def test_callers(spark):
    calls = spark.createDataFrame([("a", "r"), ("b", "r"), ("b", None), ("c", None), (None, None), (None, "r"), (None, None)], "caller string, request string")
    agents = spark.createDataFrame([("a", "A", "x"), ("b", None, "B")], "caller string, group_id string, label string")
    requests = spark.createDataFrame([("r", "R")], "request string, request_group string")
    assert {tuple(r) for r in ledger.callers(calls, agents, requests).select("state", "who", "calls").collect()} == {
        ("group", "A", 1), ("group", "R", 2), ("label", "B", 1), ("outside_range", None, 1), ("none", None, 2),
    }
