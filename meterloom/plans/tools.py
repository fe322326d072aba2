"""Calls of tools by twelve keys, by tool and by caller, with nested calls under the call that made them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.operators.joins import null_safe_join
from meterloom.plans.registry import query, table

#: What calls are counted by, each combination once.
KEYS = ("account", "source", "install", "provider", "tool", "namespace", "class", "outcome", "caller_agent", "caller_group", "has_caller_request", "nesting")
#: The tool whose calls of this provider hold nested ones, and the class of those.
WRAPPER, WRAPPER_PROVIDER, NESTABLE = "exec", "codex", "mcp"


def tool_rows(invocations: DataFrame, scope: Column, requests: DataFrame, matches: Column | None = None) -> DataFrame:
    """KEYS and n of the invocations in scope (account, invocation, source, install, provider, tool, namespace, class,
    outcome, caller_agent, caller_request, parent), a row for each combination.

    A call is nested only under a call of WRAPPER: a child if that is in scope, an orphan if it isn't or never came;
    any other parent leaves it on top. caller_group is that of its request (account, request, group, and what
    `matches` asks for), one row each: with `matches`, calls whose request doesn't match it are left out."""
    parents = invocations.select("account", F.col("invocation").alias("parent"), F.col("tool").alias("_tool"), F.col("provider").alias("_provider"), scope.alias("_inside")).dropDuplicates(["account", "parent"])
    asked = requests.select("account", F.col("request").alias("caller_request"), F.col("group").alias("caller_group"), (F.lit(True) if matches is None else matches).alias("_matches"))
    joined = invocations.where(scope).join(parents, ["account", "parent"], "left").join(asked, ["account", "caller_request"], "left")
    held = (F.col("_tool") == WRAPPER) & (F.col("_provider") == WRAPPER_PROVIDER)
    lost = F.col("_tool").isNull() & (F.col("provider") == WRAPPER_PROVIDER) & (F.col("class") == NESTABLE)
    nesting = F.when(F.col("parent").isNull(), "top").when(held, F.when(F.col("_inside"), "child").otherwise("orphan")).when(lost, "orphan").otherwise("top")
    told = joined.withColumns({"nesting": nesting, "has_caller_request": F.col("caller_request").isNotNull()})
    told = told if matches is None else told.where("_matches")
    return told.groupBy(*KEYS).agg(F.count("*").alias("n"))


def by_tool(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows by install, provider, tool, namespace, class, nesting and outcome with invocations, how many have a caller,
    and labels (install, kind, key, label; one a key): they are joined to sums, not to calls."""
    keys = ["install", "provider", "tool", "namespace", "class", "nesting", "outcome"]
    called = F.col("caller_agent").isNotNull() | F.col("has_caller_request")
    sums = rows.groupBy(*keys).agg(F.sum("n").alias("invocations"), F.coalesce(F.sum(F.when(called, F.col("n"))), F.lit(0)).alias("with_caller"))
    of = lambda kind, key: labels.where(F.col("kind") == kind).select("install", F.col("key").alias(key), F.col("label").alias(f"{key}_label"))
    return null_safe_join(null_safe_join(sums, of("tool", "tool"), ["install", "tool"]), of("tool_namespace", "namespace"), ["install", "namespace"])


def listing(tools: DataFrame) -> DataFrame:
    """What a page lists of each install, in its order: tools by invocations, then by the calls nested under them, then by
    name. Calls on top stand for themselves; children and orphans stand under WRAPPER's call, orphans under a row of
    its own name outside of the range, which has no invocations itself."""
    name = F.coalesce("tool_label", "tool", F.lit("(unnamed)"))
    lost = F.lit(f"{WRAPPER} (outside range)")
    shown = tools.select("install", F.when(F.col("nesting") == "top", name).when(F.col("nesting") == "child", WRAPPER).otherwise(lost).alias("name"), F.when(F.col("nesting") == "top", F.col("invocations")).otherwise(0).alias("own"), F.when(F.col("nesting") != "top", F.col("invocations")).otherwise(0).alias("under"), F.when(F.col("outcome").isin("failed", "denied", "cancelled"), F.col("invocations")).otherwise(0).alias("bad"))
    sums = shown.groupBy("install", "name").agg(F.sum("own").alias("invocations"), F.sum("under").alias("children"), F.sum("bad").alias("not_done"))
    order = Window.partitionBy("install").orderBy(F.desc("invocations"), F.desc("children"), "name")
    return sums.withColumn("place", F.row_number().over(order))


_FIXTURE = {
    "account": "concat('a', event_id % 3)",
    "invocation": "event_id",
    "source": "concat('s', user_id % 5)",
    "install": "concat('i', user_id % 2)",
    "provider": "CASE event_id % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' ELSE 'cursor' END",
    "tool": "CASE event_type WHEN 'purchase' THEN 'exec' WHEN 'view' THEN concat('get', event_id % 7) WHEN 'click' THEN 'read' WHEN 'error' THEN 'write' END",
    "namespace": "CASE WHEN event_type = 'view' THEN concat('ns', event_id % 4) END",
    "class": "CASE WHEN event_type = 'view' THEN 'mcp' ELSE 'builtin' END",
    "outcome": "CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 20 THEN 'succeeded' ELSE 'unknown' END",
    "caller_agent": "CASE WHEN event_id % 4 > 0 THEN concat('g', event_id % 6) END",
    "caller_request": "CASE WHEN event_id % 5 > 0 THEN event_id % 50 END",
    "parent": "CASE WHEN event_type IN ('error', 'click') THEN event_id - 6 WHEN event_type = 'view' AND event_id % 2 = 0 THEN event_id + 1000000000 END",
}
_LABELS = (("i0", "tool", "read", "Read a file"), ("i1", "tool", "get3", "Third"), ("i0", "tool_namespace", "ns1", "Space"))
_ROWS_SQL = f"""i AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _FIXTURE.items())}, ts >= TIMESTAMP '2024-01-05' AS inside FROM events), r AS (SELECT DISTINCT account, caller_request, CASE WHEN caller_request % 7 > 2 THEN 'q' || caller_request % 7 END AS caller_group FROM i WHERE caller_request IS NOT NULL),
    j AS (SELECT i.account, i.source, i.install, i.provider, i.tool, i.namespace, i.class, i.outcome, i.caller_agent, r.caller_group, i.caller_request IS NOT NULL AS has_caller_request,
        CASE WHEN i.parent IS NULL THEN 'top' WHEN p.tool = 'exec' AND p.provider = 'codex' THEN CASE WHEN p.inside THEN 'child' ELSE 'orphan' END WHEN p.tool IS NULL AND i.provider = 'codex' AND i.class = 'mcp' THEN 'orphan' ELSE 'top' END AS nesting
        FROM i LEFT JOIN i AS p ON p.account = i.account AND p.invocation = i.parent LEFT JOIN r ON r.account = i.account AND r.caller_request = i.caller_request WHERE i.inside),
    t AS (SELECT {', '.join(KEYS)}, count(*) AS n FROM j GROUP BY ALL)"""
_LABELS_SQL = "l(install, kind, key, label) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in _LABELS) + ")"
_TOOLS_SQL = f"""{_ROWS_SQL}, {_LABELS_SQL}, b AS (SELECT install, provider, tool, namespace, class, nesting, outcome, CAST(sum(n) AS BIGINT) AS invocations, CAST(coalesce(sum(n) FILTER (WHERE caller_agent IS NOT NULL OR has_caller_request), 0) AS BIGINT) AS with_caller FROM t GROUP BY ALL),
    w AS (SELECT b.*, x.label AS tool_label, y.label AS namespace_label FROM b LEFT JOIN l AS x ON x.install = b.install AND x.kind = 'tool' AND x.key = b.tool LEFT JOIN l AS y ON y.install = b.install AND y.kind = 'tool_namespace' AND y.key = b.namespace)"""


def _rows(spark, sf_dir) -> DataFrame:
    calls = table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in _FIXTURE.items()], "ts")
    request = F.col("caller_request")
    requests = calls.where(request.isNotNull()).select("account", request.alias("request")).distinct().withColumn("group", F.when(F.col("request") % 7 > 2, F.concat(F.lit("q"), F.col("request") % 7)))
    return tool_rows(calls, F.col("ts") >= "2024-01-05", requests)


@query(f"WITH {_ROWS_SQL} SELECT * FROM t")
def tool_calls(spark, sf_dir):
    """Calls by all twelve keys."""
    return _rows(spark, sf_dir)


@query(f"WITH {_TOOLS_SQL} SELECT * FROM w")
def tools_named(spark, sf_dir):
    """Calls by tool with their labels."""
    return by_tool(_rows(spark, sf_dir), spark.createDataFrame(list(_LABELS), "install string, kind string, key string, label string"))


@query(f"""WITH {_TOOLS_SQL}, s AS (SELECT install, CASE nesting WHEN 'top' THEN coalesce(tool_label, tool, '(unnamed)') WHEN 'child' THEN 'exec' ELSE 'exec (outside range)' END AS name, CASE WHEN nesting = 'top' THEN invocations ELSE 0 END AS own, CASE WHEN nesting <> 'top' THEN invocations ELSE 0 END AS under, CASE WHEN outcome IN ('failed', 'denied', 'cancelled') THEN invocations ELSE 0 END AS bad FROM w),
    g AS (SELECT install, name, CAST(sum(own) AS BIGINT) AS invocations, CAST(sum(under) AS BIGINT) AS children, CAST(sum(bad) AS BIGINT) AS not_done FROM s GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY install ORDER BY invocations DESC, children DESC, name) AS INTEGER) AS place FROM g""")
def tool_listing(spark, sf_dir):
    """Tools of each install in the order of a page."""
    return listing(tools_named(spark, sf_dir))
