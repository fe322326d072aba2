"""A rule that reads an application's own namespace: a failed request to a group of targets, made again for one.

It stands beside the built-in rules as an application would write it, and is passed to run_rules()."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.plans.registry import query, table
from meterloom.plans.traces import ORDER, Rule, claimable, run_rules
from meterloom.sources.sessions import shaped

NAMESPACE = "exampleapp"


def _app(name: str) -> Column:
    return F.get_json_object("scope", f"$.{NAMESPACE}.{name}")


def group_scope_loss(events: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Failed calls with request_kind `group`, followed in the run by a call with request_kind `single` and the same
    arguments, without an event with scope_change between: pattern `explicit` where the group's selection was
    explicit, of several targets, and not the single one's own; `absent` where nothing is told of the selection.
    size counts the pairs, evidence names each call that is in one, in the run's order.

    A stretch without a scope change has a number, so that none lies between is an equality. Partners are counted
    by running sums over equal arguments, all of them less those with the same targets; pairs are never made."""
    del limits
    order = [F.asc_nulls_last(c) for c in ORDER]
    run = Window.partitionBy("run_id").orderBy(*order)
    targets = F.from_json(_app("targets"), "array<string>")
    changed = F.coalesce(_app("scope_change") == "true", F.lit(False)).cast("int")
    rows = events.withColumn("changes", F.sum(changed).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    tool, kind = F.col("kind") == "tool", _app("request_kind")
    group = tool & (F.col("status") == "error") & (kind == "group") & claimable("args")
    single = tool & (kind == "single") & claimable("args")
    state = F.when(_app("selection_explicit").isNull() | targets.isNull(), "absent").when((_app("selection_explicit") == "true") & (F.size(targets) > 1), "explicit").otherwise("other")
    side = F.when(group & (state != "other"), state).when(single, "single")
    # A single call's own place in the stretch is before a change that it tells itself.
    stretch = F.when(side == "single", F.col("changes") - changed).otherwise(F.col("changes"))
    rows = rows.select("run_id", *ORDER, "args_hash", side.alias("side"), stretch.alias("stretch"), F.array_sort(F.array_distinct(targets)).alias("targets")).where("side IS NOT NULL")
    equal = ["run_id", "args_hash", "stretch"]
    one = lambda what: F.count_if(F.col("side") == what)
    before = Window.partitionBy(*equal).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*equal).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    same_before = Window.partitionBy(*equal, "targets").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same_after = Window.partitionBy(*equal, "targets").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    is_single, told = F.col("side") == "single", F.col("targets").isNotNull()
    absent = F.when(is_single, one("absent").over(before)).when(F.col("side") == "absent", one("single").over(after)).otherwise(0)
    alike = F.when(told, F.when(is_single, one("explicit").over(same_before)).otherwise(one("single").over(same_after))).otherwise(0)
    explicit = F.when(is_single, one("explicit").over(before) - alike).when(F.col("side") == "explicit", one("single").over(after) - alike).otherwise(0)
    met = rows.withColumns({"n_absent": absent, "n_explicit": explicit})
    both = met.select("run_id", *ORDER, "side", F.inline(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"n_{p}").alias("n")) for p in ("explicit", "absent")]))).where("n > 0")
    place = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)).alias(c) for c in ORDER])
    found = both.groupBy("run_id", "pattern").agg(F.sum(F.when(F.col("side") == "single", F.col("n")).otherwise(0)).alias("size"), F.array_sort(F.collect_set(F.struct(place.alias("at"), "event_id"))).alias("rows"))
    return found.select("run_id", F.lit(RULE.name).alias("rule"), "pattern", "size", F.transform("rows", lambda r: r["event_id"]).alias("evidence"))


RULE = Rule("group_scope_loss", group_scope_loss, ("args(full)", "status", "ordering"))

_FIXTURE = {
    "run_id": "concat('u', user_id)",
    "event_id": "concat('e', event_id)",
    "kind": "CASE WHEN event_type = 'purchase' THEN 'other' ELSE 'tool' END",
    "status": "CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END",
    "seq": "event_id",
    "args_hash": "CASE WHEN event_id % 31 > 0 THEN concat('a', event_id % 2) END",
}
_SCOPE = """CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN '{"exampleapp":{"scope_change":true}}' ELSE '{}' END
    WHEN event_type = 'error' THEN concat('{"exampleapp":{"request_kind":"group"', CASE WHEN event_id % 4 > 0 THEN ',"selection_explicit":true' ELSE '' END, CASE event_id % 3 WHEN 0 THEN ',"targets":["a"]' WHEN 1 THEN ',"targets":["a","b"]' ELSE ',"targets":["b","c","b"]' END, '}}')
    ELSE concat('{"exampleapp":{"request_kind":"single"', CASE event_id % 5 WHEN 0 THEN ',"targets":["b","a"]' WHEN 1 THEN '' ELSE ',"targets":["c","b"]' END, '}}') END"""


@query(f"""WITH ev AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _FIXTURE.items())}, event_type, event_id AS i, event_id % 3 = 0 AND event_type = 'purchase' AS change FROM events),
    g AS (SELECT *, CASE WHEN i % 4 = 0 THEN 'absent' WHEN i % 3 > 0 THEN 'explicit' END AS pattern, CASE i % 3 WHEN 1 THEN 'ab' ELSE 'bc' END AS ts FROM ev WHERE event_type = 'error' AND args_hash IS NOT NULL),
    s AS (SELECT *, CASE i % 5 WHEN 0 THEN 'ab' WHEN 1 THEN NULL ELSE 'bc' END AS ts FROM ev WHERE event_type NOT IN ('error', 'purchase') AND args_hash IS NOT NULL),
    p AS (SELECT g.run_id, g.pattern, g.i AS gi, s.i AS si FROM g JOIN s ON s.run_id = g.run_id AND s.args_hash = g.args_hash AND s.i > g.i
        WHERE g.pattern IS NOT NULL AND NOT (g.pattern = 'explicit' AND s.ts IS NOT NULL AND s.ts = g.ts) AND NOT EXISTS (SELECT 1 FROM ev c WHERE c.run_id = g.run_id AND c.change AND c.i > g.i AND c.i < s.i)),
    e AS (SELECT run_id, pattern, gi AS i FROM p UNION SELECT run_id, pattern, si FROM p), l AS (SELECT run_id, pattern, string_agg('e' || i, ',' ORDER BY i) AS evidence FROM e GROUP BY ALL)
    SELECT run_id, 'group_scope_loss' AS rule, pattern, n AS size, evidence FROM l JOIN (SELECT run_id, pattern, count(*) AS n FROM p GROUP BY ALL) USING (run_id, pattern)""")
def group_findings(spark, sf_dir):
    """Findings of the application's rule by run_rules(), as of any other."""
    events = shaped(table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in _FIXTURE.items()], "'full' AS args_label", f"{_SCOPE} AS scope"))
    return run_rules(events, [RULE])[0].withColumn("evidence", F.array_join("evidence", ","))
