"""Runs of the event model: duplicates merged, statistics, comparable series, rules and their findings.

A rule takes events and thresholds and gives rows of FINDING. Rules never look at content, only at hashes
and sizes; the evidence of a finding is the ids of the events that show it, in the run's order. What of a
run a rule can't be sure of it makes no claim about: hashes of redacted or truncated values never equal
others, calls without a token basis are compared with none, and a run that lacks what a rule needs is not
judged by it.

Windows go by run, so a task sorts whole runs; a run is what one session did.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterloom.functions.text import canonical_json, json_value
from meterloom.operators.components import components
from meterloom.plans.registry import query, table
from meterloom.sources.sessions import EVENT_COLUMNS, shaped

FINDING = ("run_id", "rule", "pattern", "size", "evidence")
ORDER = ("start_ms", "seq", "event_id")
LISTS = ("tags", "included")
#: Hashes of values that stand for missing content are never equal to anything.
PLACEHOLDERS: tuple[str, ...] = ()
#: Words in a call's name, and tags, that keep it out of the main context.
EXCLUDED_WORDS = ("route", "router", "routing", "retrieve", "retrieval", "retriever", "rerank", "reranker", "embed", "embedding", "embeddings", "compact", "compaction")
EXCLUDED_TAGS = ("routing", "retrieval", "compaction")


def _ordered() -> list[Column]:
    return [F.asc_nulls_last(c) for c in ORDER]


def _by_run() -> Window:
    return Window.partitionBy("run_id").orderBy(*_ordered())


#: Fields that two rows of one operation are compared by and give each other.
MERGED = tuple(c for c in EVENT_COLUMNS if c not in ("run_id", "event_id", "kind", "scope", *LISTS))


def richness(row: Column) -> Column:
    """How much a row tells: fields that it has, but for an unknown status, namespaces of its scope and the ids it includes."""
    told = sum((row[c].isNotNull().cast("int") for c in MERGED if not c.endswith("_label")), F.lit(0))
    return told - (row["status"] == "unknown").cast("int").eqNullSafe(1).cast("int") + F.coalesce(F.size(F.json_object_keys(row["scope"])), F.lit(0)) + F.size(row["included"])


def merged_scope(base: Column, other: Column) -> Column:
    """Two scopes, objects of objects, as one: names of both levels from either, values of base where both have them."""
    held = lambda c: F.from_json(c, "map<string,map<string,variant>>")
    none = F.create_map().cast("map<string,map<string,variant>>")
    inner = F.create_map().cast("map<string,variant>")
    both = F.map_zip_with(F.coalesce(held(base), none), F.coalesce(held(other), none), lambda _, b, o: F.map_zip_with(F.coalesce(b, inner), F.coalesce(o, inner), lambda _, x, y: F.coalesce(x, y)))
    return F.when((other == "{}") | (base == other), base).when(base == "{}", other).otherwise(canonical_json(F.to_json(both)))


def merged_pair(a: Column, b: Column) -> Column:
    """One row of two of the same operation: the richer one, a where they are alike, with what the other has beside.
    An unknown status gives way to a known one."""

    def onto(base: Column, other: Column) -> Column:
        known = lambda row: F.when(row["status"] != "unknown", row["status"])
        fields = []
        for c in EVENT_COLUMNS:
            if c in LISTS:
                fields.append(F.array_distinct(F.concat(base[c], other[c])).alias(c))
            elif c == "scope":
                fields.append(merged_scope(base[c], other[c]).alias(c))
            elif c == "status":
                fields.append(F.coalesce(known(base), known(other), base[c], other[c]).alias(c))
            elif c in MERGED:
                fields.append(F.coalesce(base[c], other[c]).alias(c))
            else:
                fields.append(base[c].alias(c))
        return F.struct(*fields)

    return F.when(richness(a) >= richness(b), onto(a, b)).otherwise(onto(b, a))


def merged(events: DataFrame) -> DataFrame:
    """One event for each set of rows of a run that share an event id, or a kind and tool call id, directly
    or through others: merged_pair() from one to the next in the run's order. Rows that repeat in every column count
    once, so what a set gathers is its different versions, not its copies."""
    rows = _rooted(events).select("run_id", "root", *[c for c in EVENT_COLUMNS if c != "run_id"]).distinct()
    last = [F.struct(F.col(c).isNull(), F.col(c)).alias(c) for c in ORDER]
    row = F.struct(F.struct(*last).alias("order"), F.struct(*EVENT_COLUMNS).alias("row"))
    found = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["row"])
    return rows.groupBy("run_id", "root").agg(found.alias("rows")).select(F.reduce(F.slice("rows", 2, F.size("rows")), F.get("rows", 0), merged_pair).alias("e")).select("e.*")


def _rooted(events: DataFrame) -> DataFrame:
    node = F.xxhash64("run_id", "event_id")
    rows = events.select(*EVENT_COLUMNS, node.alias("node"))
    called = rows.where("tool_call_id IS NOT NULL").groupBy("run_id", "kind", "tool_call_id").agg(F.min("node").alias("b"))
    links = rows.join(called, ["run_id", "kind", "tool_call_id"]).select(F.col("node").alias("a"), "b")
    return rows.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))


def conflicts(events: DataFrame) -> DataFrame:
    """run_id, event_id (the first of the set) and the fields in which rows that merged() joins disagree."""
    compared = [c for c in EVENT_COLUMNS if c not in (*LISTS, "run_id", "event_id", "scope")]
    differ = [F.when(F.count_distinct(F.when(F.col(c) != "unknown", F.col(c)) if c == "status" else F.col(c)) > 1, F.lit(c)) for c in compared]
    found = _rooted(events).groupBy("run_id", "root").agg(F.min("event_id").alias("event_id"), F.array_compact(F.array(*differ)).alias("fields"))
    return found.where(F.size("fields") > 0).select("run_id", "event_id", "fields")


def statistics(events: DataFrame) -> DataFrame:
    """Counts by kind and of failures, tokens (null where nothing tells them) and span of each run."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return events.groupBy("run_id").agg(
        of("model").alias("model_calls"),
        of("tool").alias("tool_calls"),
        F.count_if(F.col("status") == "error").alias("failures"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        (F.max("end_ms") - F.min("start_ms")).alias("span_ms"),
    )


def exclusion() -> Column:
    """Why a call does not belong to the main context; null where it does. Names count by whole words."""
    words = F.regexp_extract_all(F.lower(F.coalesce("name", F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    hit = lambda found, listed: F.try_element_at(F.array_sort(F.array_intersect(found, F.array(*map(F.lit, listed)))), F.lit(1))
    return F.coalesce(F.concat(F.lit("operation_name:"), hit(words, EXCLUDED_WORDS)), F.concat(F.lit("tag:"), hit(F.col("tags"), EXCLUDED_TAGS)))


def candidates(events: DataFrame) -> DataFrame:
    """The calls of each run's main context: its model calls or, where it has none, aggregates without model
    calls below them; excluded ones are left out, those without a basis stay, since they end series."""
    kinds = events.withColumn("models", F.count_if(F.col("kind") == "model").over(Window.partitionBy("run_id")))
    above = kinds.where("kind = 'model' AND parent_id IS NOT NULL").select("run_id", F.col("parent_id").alias("event_id")).distinct().withColumn("_parent", F.lit(True))
    pool = kinds.join(above, ["run_id", "event_id"], "left").where("kind = 'model' OR (kind = 'aggregate' AND models = 0 AND _parent IS NULL)")
    return pool.where(exclusion().isNull()).drop("models", "_parent")


def series(events: DataFrame) -> DataFrame:
    """Comparable calls with the number of their series in the run, and struct p, the call before in it. A
    series ends where basis or model change and at calls without a basis."""
    before = F.lag(F.struct("token_basis", "model", "tokens_in", "event_id", *[c for c in ("start_ms", "seq", "tools") if c in events.columns])).over(_by_run())
    marked = candidates(events).withColumn("p", before)
    same = F.col("token_basis").isNotNull() & F.col("p.token_basis").eqNullSafe(F.col("token_basis")) & F.col("p.model").eqNullSafe(F.col("model"))
    cut = marked.withColumn("same", same).withColumn("series", F.sum((~F.col("same")).cast("int")).over(_by_run().rowsBetween(Window.unboundedPreceding, 0)))
    return cut.where("token_basis IS NOT NULL").withColumn("p", F.when(F.col("same"), F.col("p"))).drop("same")


def token_totals(events: DataFrame) -> DataFrame:
    """Sums of each run by basis, never across bases; null where nothing was told."""
    sums = ("tokens_in", "tokens_out", "tokens_total", "cache_read", "cache_write")
    return candidates(events).where("token_basis IS NOT NULL").groupBy("run_id", "token_basis").agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in sums], F.bool_or(F.col("kind") == "aggregate").alias("is_aggregate"))


def basis_notes(events: DataFrame) -> DataFrame:
    """What has to be said about a run's bases: that it mixes them, or has calls without one."""
    held = events.where(F.col("kind") == "model").where(exclusion().isNull()).groupBy("run_id").agg(F.count_distinct("token_basis").alias("bases"), F.count_if(F.col("token_basis").isNull()).alias("without"))
    notes = F.array_compact(F.array(F.when(F.col("bases") > 1, F.struct(F.lit("mixed_token_basis").alias("code"), F.col("bases").alias("n"))), F.when(F.col("without") > 0, F.struct(F.lit("token_basis_absent").alias("code"), F.col("without").alias("n")))))
    return held.select("run_id", F.inline(notes))


def claimable(prefix: str) -> Column:
    """Whether a hash can back a claim of equality: it is there, of the full value, and no placeholder's."""
    own = F.col(f"{prefix}_hash")
    known = own.isNotNull() & (F.col(f"{prefix}_label") == "full")
    return F.coalesce(known & ~own.isin(*PLACEHOLDERS) if PLACEHOLDERS else known, F.lit(False))


def tagged(*tags: str) -> Column:
    return F.arrays_overlap("tags", F.array(*map(F.lit, tags)))


def _end() -> Column:
    """When an event ended, if both its ends are known."""
    return F.when(F.col("start_ms").isNotNull(), F.coalesce("end_ms", F.col("start_ms") + F.col("duration_ms")))


def _call() -> Column:
    return F.concat_ws(":", "name", "args_hash")


def _finding(df: DataFrame, rule: str, pattern: Column, size: Column, evidence: Column) -> DataFrame:
    return df.select("run_id", F.lit(rule).alias("rule"), pattern.alias("pattern"), size.cast("bigint").alias("size"), evidence.alias("evidence"))


def _placed(end: Column | None = None) -> Column:
    """An event in order, for lists: nulls last."""
    return F.struct(F.coalesce("start_ms", F.lit(2**62)).alias("o1"), F.coalesce("seq", F.lit(2**62)).alias("o2"), F.col("event_id").alias("id"), "start_ms", "seq", (_end() if end is None else end).alias("end"))


def repeated_result(events: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Results of the same bytes and some size, whatever calls gave them; deliberate rereads aside."""
    found = events.where((F.col("kind") == "tool") & claimable("result") & (F.col("result_bytes") >= limits["bytes"]) & ~tagged("reread"))
    groups = found.groupBy("run_id", "result_hash").agg(F.count_distinct("event_id").alias("n"), F.array_sort(F.collect_set(_placed())).alias("rows")).where(F.col("n") >= limits["times"])
    return _finding(groups, "repeated_result", F.col("result_hash"), F.col("n"), F.array_distinct(F.transform("rows", lambda r: r["id"])))


def oversized_result(events: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Large results, but for deliberate large reads; beside each the next comparable call that took it in,
    which its list names or which is the first of a series to begin after it."""
    big = events.where((F.col("kind") == "tool") & (F.col("result_bytes") >= limits["bytes"]) & ~tagged("large_read")).select("run_id", "event_id", "result_bytes", "start_ms", "seq", _end().alias("end"))
    pairs = series(events).where("p IS NOT NULL").select("run_id", F.col("event_id").alias("call"), "included", _end().isNotNull().alias("timed"), "start_ms", "seq", "p", F.col("tokens_in").isNotNull().alias("told"))
    probe = big.select("run_id", F.col("end").alias("at"), F.lit(0).alias("side"), "event_id", F.lit(None).cast("struct<call:string,since:bigint,told:boolean>").alias("next"))
    calls = pairs.where("timed").select("run_id", F.col("start_ms").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("event_id"), F.struct("call", F.col("p.start_ms").alias("since"), F.col("told") & F.col("p.tokens_in").isNotNull()).cast("struct<call:string,since:bigint,told:boolean>").alias("next"))
    ahead = Window.partitionBy("run_id").orderBy("at", "side").rowsBetween(0, Window.unboundedFollowing)
    after = probe.where("at IS NOT NULL").unionByName(calls).withColumn("next", F.first("next", ignorenulls=True).over(ahead)).where("side = 0 AND at > next.since").select("run_id", "event_id", F.col("next.call").alias("later"), F.col("next.told").alias("later_told"))
    named = pairs.select("run_id", F.explode("included").alias("event_id"), "call", (F.col("told") & F.col("p.tokens_in").isNotNull()).alias("told")).groupBy("run_id", "event_id").agg(F.min(F.struct("call", "told")).alias("own"))
    both = big.join(after, ["run_id", "event_id"], "left").join(named, ["run_id", "event_id"], "left")
    shown = F.coalesce(F.when(F.col("own.told"), F.col("own.call")), F.when(F.col("own").isNull() & F.col("later_told"), F.col("later")))
    return _finding(both, "oversized_result", F.col("event_id"), F.col("result_bytes"), F.array_compact(F.array(F.col("event_id"), shown)))


def context_growth(events: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Neighbouring comparable calls whose input grew by so many tokens and so many times, and the results
    that came between them or that the later one names: candidates, not causes."""
    counted = events.withColumn("tools", F.count_if(F.col("kind") == "tool").over(_by_run().rowsBetween(Window.unboundedPreceding, 0)))
    grown = series(counted).where((F.col("tokens_in") - F.col("p.tokens_in") >= limits["tokens"]) & (F.col("tokens_in") >= limits["times"] * F.col("p.tokens_in")))
    between = grown.where("tools > p.tools").select("run_id", "event_id", F.explode(F.sequence(F.col("p.tools") + 1, F.col("tools"))).alias("tools"))
    tools = counted.where("kind = 'tool'").select("run_id", "tools", F.col("event_id").alias("result"), _placed().alias("row"))
    inside = between.join(tools, ["run_id", "tools"]).select("run_id", "event_id", "row")
    named = grown.select("run_id", "event_id", F.explode("included").alias("result")).join(tools.drop("tools"), ["run_id", "result"]).select("run_id", "event_id", "row")
    held = inside.unionByName(named).groupBy("run_id", "event_id").agg(F.array_sort(F.collect_set("row")).alias("rows"))
    both = grown.join(held, ["run_id", "event_id"], "left")
    results = F.coalesce(F.transform("rows", lambda r: r["id"]), F.array().cast("array<string>"))
    return _finding(both, "context_growth", F.col("event_id"), F.col("tokens_in") - F.col("p.tokens_in"), F.concat(F.array("p.event_id", "event_id"), results))


def no_progress(events: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Equal calls with equal results in one scope, each beginning when the one before it in the chain has
    ended. A call that overlaps stands aside, and later ones go on with the chain. Calls that are tagged
    as polling or rereading don't count. A chain is one row, as long as a run repeats one call."""
    tools = events.where((F.col("kind") == "tool") & F.col("name").isNotNull() & claimable("args") & claimable("result") & ~tagged("polling", "reread"))
    groups = tools.groupBy("run_id", "name", "args_hash", "result_hash", "scope").agg(F.array_sort(F.collect_list(_placed())).alias("rows")).where(F.size("rows") >= limits["times"])
    follows = lambda a, b: F.when(a["end"].isNotNull() & b["end"].isNotNull(), b["start_ms"] >= a["end"]).otherwise(F.coalesce(b["seq"] > a["seq"], F.lit(False)))
    chain = F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), F.slice("rows", F.lit(1), F.lit(1)), lambda held, row: F.when(follows(F.element_at(held, F.lit(-1)), row), F.array_append(held, row)).otherwise(held))
    found = groups.withColumn("chain", chain).where(F.size("chain") >= limits["times"])
    return _finding(found, "no_progress", _call(), F.size("chain"), F.transform("chain", lambda r: r["id"]))


def retry_after_failure(events: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """The same call in one scope failing `weak` times, and the longest chain of `strong` or more such
    failures with a model call that begins between each two. Retries that are declared don't count, and
    a tool call id counts once."""
    failed = events.where((F.col("kind") == "tool") & (F.col("status") == "error") & F.col("name").isNotNull() & claimable("args") & ~tagged("retry", "backoff"))
    keys = ["run_id", "name", "args_hash", "scope"]
    once = Window.partitionBy(*keys, F.coalesce("tool_call_id", F.concat(F.lit("\0"), "event_id"))).orderBy(*_ordered())
    tries = failed.withColumn("nth", F.row_number().over(once)).where("nth = 1").select(*keys, "event_id", "start_ms", "seq", _end().alias("end"))
    own = Window.partitionBy(*keys).orderBy(*_ordered())
    tries = tries.withColumn("then", F.lead(F.struct("start_ms", "seq", "end")).over(own))
    # Three lanes of a run, each swept once: timed calls by time, untimed ones and all of them by seq. A try asks in
    # each for the first call at or after its end, or after its seq.
    lane = lambda n, place, side: F.struct(F.lit(n).alias("lane"), F.col(place).alias("place"), F.lit(side).alias("side"))
    asked = tries.select("*", F.inline(F.array(lane(0, "end", 0), lane(1, "seq", 2), lane(2, "seq", 2))))
    model = events.where("kind = 'model'").select("run_id", F.col("event_id").alias("model"), "start_ms", "seq", _end().isNotNull().alias("timed"))
    told = model.select("run_id", "model", F.inline(F.array(F.when(F.col("timed"), lane(0, "start_ms", 1)), F.when(~F.col("timed"), lane(1, "seq", 1)), lane(2, "seq", 1)))).where("place IS NOT NULL")
    ahead = Window.partitionBy("run_id", "lane").orderBy("place", "side", F.asc_nulls_last("model")).rowsBetween(0, Window.unboundedFollowing)
    answer = F.first(F.when(F.col("side") == 1, F.struct("place", "model")), ignorenulls=True).over(ahead)
    swept = asked.unionByName(told, allowMissingColumns=True).withColumn("next", answer).where("side <> 1")
    of_lane = lambda n, name: F.max(F.when((F.col("lane") == n) & F.col("place").isNotNull(), F.col("next"))).alias(name)
    tries = swept.groupBy(*keys, "event_id").agg(*[F.first(c).alias(c) for c in ("start_ms", "seq", "end", "then")], of_lane(0, "by_time"), of_lane(1, "by_seq"), of_lane(2, "by_any"))
    timed = F.col("end").isNotNull() & F.col("then.end").isNotNull()
    before = lambda name, place: F.when(F.col(f"{name}.place") < F.col(f"then.{place}"), F.col(f"{name}.model"))
    between = F.when(timed, F.coalesce(before("by_time", "start_ms"), before("by_seq", "seq"))).otherwise(before("by_any", "seq"))
    tries = tries.withColumn("between", F.when(F.col("then").isNotNull(), between))
    chain = F.coalesce(F.sum(F.col("between").isNull().cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chains = tries.withColumn("chain", chain).groupBy(*keys, "chain").agg(F.array_sort(F.collect_list(F.struct(_placed(F.col("end")).alias("row"), "between"))).alias("rows"))
    whole = chains.groupBy(*keys).agg(F.sum(F.size("rows")).alias("n"), F.max_by("rows", F.struct(F.size("rows"), -F.col("chain"))).alias("best"), F.array_sort(F.flatten(F.collect_list("rows"))).alias("all"))
    ids = lambda c: F.transform(c, lambda r: r["row"]["id"])
    shown = F.concat(ids("best"), F.filter(F.transform("best", lambda r: r["between"]), lambda m: m.isNotNull()))
    kinds = (("weak", F.col("n") >= limits["weak"], F.col("n"), ids("all")), ("strong", F.size("best") >= F.greatest(F.lit(limits["strong"]), F.lit(1)), F.size("best"), shown))
    found = F.array(*[F.when(holds, F.struct(F.concat(F.lit(f"{kind}:"), _call()).alias("pattern"), size.cast("bigint").alias("size"), evidence.alias("evidence"))) for kind, holds, size, evidence in kinds])
    return whole.select("run_id", F.lit("retry_after_failure").alias("rule"), F.inline(F.array_compact(found)))


@dataclass(frozen=True)
class Rule:
    """A rule by name, what it needs of a run, and its limits. A need is a kind of event, a field of those
    it applies to as field(kind), a hash as args(full), status, or ordering."""

    name: str
    find: Callable[[DataFrame, Mapping], DataFrame]
    needs: Sequence[str] = ()
    limits: Mapping[str, float] = field(default_factory=dict)


RULES = (
    Rule("no_progress", no_progress, ("args(full)", "result(full)", "ordering"), {"times": 3}),
    Rule("retry_after_failure", retry_after_failure, ("args(full)", "status", "ordering"), {"weak": 3, "strong": 2}),
    Rule("context_growth", context_growth, ("model", "tokens_in(model)", "token_basis(model)", "model(model)", "ordering"), {"tokens": 8000, "times": 1.5}),
    Rule("oversized_result", oversized_result, ("result_bytes",), {"bytes": 65_536}),
    Rule("repeated_result", repeated_result, ("result(full)", "result_bytes"), {"bytes": 8192, "times": 3}),
)
KINDS = ("model", "tool", "aggregate", "other", "approval")


def need(name: str) -> tuple[Column, Column]:
    """Whether an event is one that a need applies to, and whether it meets it."""
    own, _, of = name.rstrip(")").partition("(")
    tool = F.col("kind") == "tool"
    if own in KINDS and not of:
        return F.col("kind") == own, F.lit(True)
    if own == "ordering":
        return F.lit(True), F.col("seq").isNotNull() | (F.col("start_ms").isNotNull() & (F.col("end_ms").isNotNull() | F.col("duration_ms").isNotNull()))
    if own == "status":
        return tool, F.coalesce(F.col("status") != "unknown", F.lit(False))
    if own in ("args", "result"):
        return tool, claimable(own)
    if own not in EVENT_COLUMNS:
        raise ValueError(f"unknown need: {name}")
    return F.col("kind") == of if of else (tool if own.startswith("result") else F.lit(True)), F.col(own).isNotNull()


def covered(events: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """run_id, rule, state and missing of each run and rule: checked; partial, where some events lack what is
    needed and no claim is made about them; or abstained, where none has it."""
    needs = sorted({n for rule in rules for n in rule.needs})
    counts = []
    for i, name in enumerate(needs):
        applies, meets = need(name)
        counts += [F.count_if(applies).alias(f"a{i}"), F.count_if(applies & meets).alias(f"m{i}")]
    held = events.groupBy("run_id").agg(F.count("*").alias("events"), *counts)
    states = []
    for rule in rules:
        at = [needs.index(n) for n in rule.needs]
        missing = F.array_compact(F.array(*[F.when(F.col(f"m{i}") == 0, F.lit(needs[i])) for i in at], F.lit(None).cast("string")))
        some = F.lit(False)
        for i in at:
            some = some | (F.col(f"m{i}") < F.col(f"a{i}"))
        states.append(F.struct(F.lit(rule.name).alias("rule"), F.when(F.size(missing) > 0, "abstained").when(some, "partial").otherwise("checked").alias("state"), missing.alias("missing")))
    return held.select("run_id", F.inline(F.array(*states)))


def run_rules(events: DataFrame, rules: Sequence[Rule] = RULES, limits: Mapping[str, Mapping[str, float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, coverage): findings of all rules, one for each run, rule and pattern with all evidence,
    and covered(). A rule that abstains from a run finds nothing there. Unknown rules or limits are errors."""
    limits = limits or {}
    known = {rule.name: rule for rule in rules}
    if len(known) < len(rules):
        raise ValueError("two rules have one name")
    for name, own in limits.items():
        if name not in known or set(own) - set(known[name].limits):
            raise ValueError(f"unknown rule or limit: {name} {sorted(own)}")
    found = None
    for rule in rules:
        one = rule.find(events, {**rule.limits, **limits.get(rule.name, {})})
        found = one if found is None else found.unionByName(one)
    coverage = covered(events, rules)
    judged = found.join(coverage.where("state <> 'abstained'").select("run_id", "rule"), ["run_id", "rule"], "left_semi")
    return collapsed(judged, events), coverage


def collapsed(findings: DataFrame, events: DataFrame) -> DataFrame:
    """One finding for each run, rule and pattern, with the evidence of all in the run's order; what is cited and is
    no event of the run stands behind."""
    keys = ["run_id", "rule", "pattern"]
    whole = findings.groupBy(*keys).agg(F.max("size").alias("size"), F.count("*").alias("n"), F.first("evidence").alias("evidence"))
    several = whole.where("n > 1").select(*keys)
    cited = findings.join(several, keys, "left_semi").select(*keys, F.explode("evidence").alias("event_id")).distinct()
    placed = events.groupBy("run_id", "event_id").agg(F.min(F.struct(*[F.struct(F.col(c).isNull(), F.col(c)).alias(c) for c in ORDER[:2]])).alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col("at").isNull().alias("lost"), "at", "event_id"))), lambda x: x["event_id"])
    united = cited.join(placed, ["run_id", "event_id"], "left").groupBy(*keys).agg(listed.alias("all"))
    return whole.join(united, keys, "left").select("run_id", "rule", "pattern", "size", F.coalesce("all", "evidence").alias("evidence"))


def fingerprinted(findings: DataFrame, rules: Sequence[Rule] = RULES, limits: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """findings with a fingerprint: sha256 of rule, run, evidence in order of its ids and the limits that held, in
    canonical JSON, so that the same finding is known again."""
    held = [json.dumps({k: {**rule.limits, **(limits or {}).get(rule.name, {})}[k] for k in sorted(rule.limits)}, separators=(",", ":")) for rule in rules]
    own = F.coalesce(*[F.when(F.col("rule") == rule.name, F.lit(text)) for rule, text in zip(rules, held)], F.lit("{}"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort("evidence"), json_value), ","), F.lit("]"))
    whole = F.concat(F.lit('{"evidence":'), listed, F.lit(',"rule_id":'), json_value("rule"), F.lit(',"run_id":'), json_value("run_id"), F.lit(',"thresholds":'), own, F.lit("}"))
    return findings.withColumn("fingerprint", F.sha2(whole, 256))


def cited(findings: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings whose evidence are all events of their run, rule errors for the others)."""
    shown = findings.select("run_id", "rule", "pattern", F.explode_outer("evidence").alias("event_id"))
    lost = shown.join(events.select("run_id", "event_id").distinct(), ["run_id", "event_id"], "left_anti").select("run_id", "rule", "pattern").distinct()
    keys = ["run_id", "rule", "pattern"]
    return findings.join(lost, keys, "left_anti"), lost.withColumn("error", F.lit("evidence"))


def exit_code(findings: DataFrame, coverage: DataFrame) -> int:
    """0: nothing found; 2: findings; 3: nothing could be checked."""
    if findings.limit(1).count():
        return 2
    return 0 if coverage.where("state <> 'abstained'").limit(1).count() else 3


#: Runs in the test tables: a user's events, each column by an expression that both engines read alike.
FIXTURE = {
    "run_id": "concat('u', user_id)",
    "event_id": "concat('e', event_id)",
    "kind": "CASE WHEN event_type IN ('view', 'click', 'error') THEN 'tool' ELSE 'model' END",
    "name": "CASE WHEN event_type IN ('view', 'click', 'error') THEN concat('tool', event_id % 2) WHEN event_id % 9 = 0 THEN 'Router.call' ELSE 'chat' END",
    "model": "CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END",
    "status": "CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END",
    "seq": "event_id",
    "duration_ms": "CAST(floor(value * 300000) AS BIGINT)",
    "token_basis": "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 40 < 20 THEN 'x' ELSE 'y' END",
    "tokens_in": "CAST(floor(value * 100) AS BIGINT)",
    "tokens_out": "event_id % 500",
    "args_hash": "CASE WHEN event_type IN ('view', 'click', 'error') THEN concat('a', event_id % 3) END",
    "args_label": "CASE WHEN event_type = 'click' AND event_id % 6 = 0 THEN 'redacted' ELSE 'full' END",
    "result_hash": "CASE WHEN event_type IN ('view', 'click') THEN concat('r', event_id % 4) END",
    "result_label": "'full'",
    "result_bytes": "CASE WHEN event_type IN ('view', 'click') THEN event_id * 7919 % 80000 END",
    "scope": "concat('{\"s\":', event_id % 2, '}')",
}
_MS = {"spark": "CAST(unix_micros(CAST(ts AS TIMESTAMP)) / 1000 AS BIGINT)", "duck": "epoch_us(ts) // 1000"}
EVENTS_SQL = f"ev AS (SELECT {', '.join(f'{e} AS {c}' for c, e in FIXTURE.items())}, {_MS['duck']} AS start_ms, start_ms + duration_ms AS fin FROM events)"


def fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in FIXTURE.items()], f"{_MS['spark']} AS start_ms"))


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("evidence", F.array_join("evidence", ","))


@query(f"WITH {EVENTS_SQL} SELECT run_id, count(*) FILTER (WHERE kind = 'model') AS model_calls, count(*) FILTER (WHERE kind = 'tool') AS tool_calls, count(*) FILTER (WHERE status = 'error') AS failures, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, max(fin) - min(start_ms) AS span_ms FROM ev GROUP BY run_id")
def run_statistics(spark, sf_dir):
    return statistics(fixture(spark, sf_dir).withColumn("end_ms", F.col("start_ms") + F.col("duration_ms")))


_CALLS_SQL = "cand AS (SELECT * FROM ev WHERE kind = 'model' AND name <> 'Router.call'), lagged AS (SELECT *, lag(token_basis) OVER w AS pb, lag(model) OVER w AS pm, lag(tokens_in) OVER w AS pti, lag(event_id) OVER w AS pid, lag(start_ms) OVER w AS ps, lag(seq) OVER w AS pseq FROM cand WINDOW w AS (PARTITION BY run_id ORDER BY start_ms, seq, event_id)), pairs AS (SELECT * FROM lagged WHERE token_basis = pb AND model = pm)"


@query(f"WITH {EVENTS_SQL}, {_CALLS_SQL} SELECT run_id, token_basis, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(NULL AS BIGINT) AS tokens_total, CAST(NULL AS BIGINT) AS cache_read, CAST(NULL AS BIGINT) AS cache_write, false AS is_aggregate FROM cand WHERE token_basis IS NOT NULL GROUP BY ALL")
def tokens_by_basis(spark, sf_dir):
    return token_totals(fixture(spark, sf_dir))


@query(f"WITH {EVENTS_SQL}, {_CALLS_SQL}, n AS (SELECT run_id, count(DISTINCT token_basis) AS b, count(*) FILTER (WHERE token_basis IS NULL) AS w FROM cand GROUP BY run_id) SELECT run_id, 'mixed_token_basis' AS code, b AS n FROM n WHERE b > 1 UNION ALL SELECT run_id, 'token_basis_absent', w FROM n WHERE w > 0")
def token_basis_notes(spark, sf_dir):
    return basis_notes(fixture(spark, sf_dir))


@query(f"WITH {EVENTS_SQL} SELECT event_id, CASE WHEN name = 'Router.call' THEN 'operation_name:router' END AS reason FROM ev")
def call_exclusions(spark, sf_dir):
    return fixture(spark, sf_dir).select("event_id", exclusion().alias("reason"))


@query(f"""WITH {EVENTS_SQL}, {_CALLS_SQL}, g AS (SELECT * FROM pairs WHERE tokens_in - pti >= 8000 AND tokens_in >= 1.5 * pti)
    SELECT g.run_id, 'context_growth' AS rule, g.event_id AS pattern, g.tokens_in - pti AS size, concat_ws(',', pid, g.event_id, string_agg(t.event_id, ',' ORDER BY t.start_ms, t.seq)) AS evidence
    FROM g LEFT JOIN ev t ON t.run_id = g.run_id AND t.kind = 'tool' AND (t.start_ms, t.seq) > (g.ps, g.pseq) AND (t.start_ms, t.seq) < (g.start_ms, g.seq) GROUP BY g.run_id, g.event_id, g.tokens_in, pti, pid""")
def growth_findings(spark, sf_dir):
    return _shown(context_growth(fixture(spark, sf_dir), RULES[2].limits))


@query(f"""WITH {EVENTS_SQL}, {_CALLS_SQL}, b AS (SELECT * FROM ev WHERE kind = 'tool' AND result_bytes >= 65536), f AS (SELECT b.*, (SELECT arg_min(p.event_id, (p.start_ms, p.seq)) FROM pairs p WHERE p.run_id = b.run_id AND p.start_ms >= b.fin AND p.ps < b.fin) AS nx FROM b)
    SELECT run_id, 'oversized_result' AS rule, event_id AS pattern, result_bytes AS size, concat_ws(',', event_id, nx) AS evidence FROM f""")
def oversized_findings(spark, sf_dir):
    return _shown(oversized_result(fixture(spark, sf_dir), RULES[3].limits))


@query(f"WITH {EVENTS_SQL} SELECT run_id, 'repeated_result' AS rule, result_hash AS pattern, count(DISTINCT event_id) AS size, string_agg(event_id, ',' ORDER BY start_ms, seq, event_id) AS evidence FROM ev WHERE kind = 'tool' AND result_hash IS NOT NULL AND result_bytes >= 8192 GROUP BY ALL HAVING count(DISTINCT event_id) >= 3")
def repeated_findings(spark, sf_dir):
    return _shown(repeated_result(fixture(spark, sf_dir), RULES[4].limits))


@query(f"""WITH RECURSIVE {EVENTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id, name, args_hash, result_hash, scope ORDER BY start_ms, seq) AS n FROM ev WHERE kind = 'tool' AND args_label = 'full' AND result_hash IS NOT NULL),
    c AS (SELECT run_id, name, args_hash, result_hash, scope, n, fin, [event_id] AS ids FROM n WHERE n = 1
        UNION ALL SELECT n.run_id, n.name, n.args_hash, n.result_hash, n.scope, n.n, CASE WHEN n.start_ms >= c.fin THEN n.fin ELSE c.fin END, CASE WHEN n.start_ms >= c.fin THEN list_append(ids, n.event_id) ELSE ids END
        FROM c JOIN n ON n.run_id = c.run_id AND n.name = c.name AND n.args_hash = c.args_hash AND n.result_hash = c.result_hash AND n.scope = c.scope AND n.n = c.n + 1)
    SELECT run_id, 'no_progress' AS rule, name || ':' || args_hash AS pattern, CAST(len(ids) AS BIGINT) AS size, array_to_string(ids, ',') AS evidence FROM c WHERE len(ids) >= 3 QUALIFY row_number() OVER (PARTITION BY run_id, name, args_hash, result_hash, scope ORDER BY n DESC) = 1""")
def no_progress_findings(spark, sf_dir):
    return _shown(no_progress(fixture(spark, sf_dir), RULES[0].limits))


@query(f"""WITH {EVENTS_SQL}, t AS (SELECT *, row_number() OVER w AS n, lead(start_ms) OVER w AS ns, lead(event_id) OVER w AS nid FROM ev WHERE kind = 'tool' AND status = 'error' AND args_label = 'full' WINDOW w AS (PARTITION BY run_id, name, args_hash, scope ORDER BY start_ms, seq)),
    b AS (SELECT t.*, (SELECT arg_min(m.event_id, (m.start_ms, m.event_id)) FROM ev m WHERE m.run_id = t.run_id AND m.kind = 'model' AND m.start_ms >= t.fin AND m.start_ms < t.ns) AS mid FROM t),
    k AS (SELECT *, coalesce(sum(CASE WHEN mid IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, name, args_hash, scope ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chain FROM b),
    s AS (SELECT run_id, name, args_hash, scope, chain, count(*) AS n, string_agg(event_id, ',' ORDER BY n) AS ids, string_agg(mid, ',' ORDER BY n) AS mids FROM k GROUP BY ALL)
    SELECT run_id, 'retry_after_failure' AS rule, 'weak:' || name || ':' || args_hash AS pattern, count(*) AS size, string_agg(event_id, ',' ORDER BY n) AS evidence FROM k GROUP BY run_id, name, args_hash, scope HAVING count(*) >= 3
    UNION ALL SELECT run_id, 'retry_after_failure', 'strong:' || name || ':' || args_hash, n, concat_ws(',', ids, mids) FROM s QUALIFY row_number() OVER (PARTITION BY run_id, name, args_hash, scope ORDER BY n DESC, chain) = 1 AND n >= 2""")
def retry_findings(spark, sf_dir):
    return _shown(retry_after_failure(fixture(spark, sf_dir), RULES[1].limits))


@query(f"""WITH {EVENTS_SQL}, h AS (SELECT run_id, count(*) FILTER (WHERE kind = 'model') AS m, count(*) FILTER (WHERE kind = 'model' AND token_basis IS NOT NULL) AS mb, count(*) FILTER (WHERE kind = 'tool') AS t, count(*) FILTER (WHERE kind = 'tool' AND args_label = 'full') AS ta,
        count(*) FILTER (WHERE kind = 'tool' AND result_hash IS NOT NULL) AS tr FROM ev GROUP BY run_id)
    SELECT run_id, 'no_progress' AS rule, CASE WHEN ta = 0 OR tr = 0 THEN 'abstained' WHEN ta < t OR tr < t THEN 'partial' ELSE 'checked' END AS state, concat_ws(',', CASE WHEN ta = 0 THEN 'args(full)' END, CASE WHEN tr = 0 THEN 'result(full)' END) AS missing FROM h
    UNION ALL SELECT run_id, 'retry_after_failure', CASE WHEN ta = 0 OR t = 0 THEN 'abstained' WHEN ta < t THEN 'partial' ELSE 'checked' END, concat_ws(',', CASE WHEN ta = 0 THEN 'args(full)' END, CASE WHEN t = 0 THEN 'status' END) FROM h
    UNION ALL SELECT run_id, 'context_growth', CASE WHEN mb = 0 THEN 'abstained' WHEN mb < m THEN 'partial' ELSE 'checked' END, concat_ws(',', CASE WHEN m = 0 THEN 'model' END, CASE WHEN m = 0 THEN 'tokens_in(model)' END, CASE WHEN mb = 0 THEN 'token_basis(model)' END, CASE WHEN m = 0 THEN 'model(model)' END) FROM h
    UNION ALL SELECT run_id, 'oversized_result', CASE WHEN tr = 0 THEN 'abstained' WHEN tr < t THEN 'partial' ELSE 'checked' END, CASE WHEN tr = 0 THEN 'result_bytes' ELSE '' END FROM h
    UNION ALL SELECT run_id, 'repeated_result', CASE WHEN tr = 0 THEN 'abstained' WHEN tr < t THEN 'partial' ELSE 'checked' END, CASE WHEN tr = 0 THEN 'result(full),result_bytes' ELSE '' END FROM h""")
def rule_coverage(spark, sf_dir):
    return covered(fixture(spark, sf_dir)).withColumn("missing", F.array_join("missing", ","))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS a, CAST(l_orderkey // 24 * 24 + l_partkey % 31 % 24 AS BIGINT) AS b FROM lineitem WHERE l_orderkey <> l_orderkey // 24 * 24 + l_partkey % 31 % 24), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen) SELECT node, min(seen) AS root FROM r GROUP BY node""")
def connected_components(spark, sf_dir):
    order = F.col("l_orderkey")
    other = F.floor(order / 24) * 24 + F.col("l_partkey") % 31 % 24
    return components(table(spark, sf_dir, "lineitem").select(order.alias("a"), other.alias("b")))


#: Fields of events and the kinds that they apply to.
APPLICABLE = {"model": ("model",), "token_basis": ("model",), "tokens_in": ("model",), "name": ("tool", "model"), "args_hash": ("tool",), "result_hash": ("tool",), "result_bytes": ("tool",)}


def field_states(events: DataFrame) -> DataFrame:
    """run_id, field and state of each field: present, partial or absent over the events that it applies to, null
    where a run has none of these."""
    counts = []
    for name, kinds in APPLICABLE.items():
        own = F.col("kind").isin(*kinds)
        counts += [F.count_if(own).alias(f"n_{name}"), F.count_if(own & F.col(name).isNotNull()).alias(f"h_{name}")]
    held = events.groupBy("run_id").agg(*counts)
    state = lambda c: F.when(F.col(f"h_{c}") == F.col(f"n_{c}"), F.when(F.col(f"n_{c}") > 0, "present")).when(F.col(f"h_{c}") == 0, "absent").otherwise("partial")
    return held.select("run_id", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), state(c).alias("state")) for c in APPLICABLE])))


@query(f"WITH {EVENTS_SQL}, " + """f AS (""" + " UNION ALL ".join(f"SELECT run_id, '{c}' AS field, count(*) FILTER (WHERE kind IN ({', '.join(repr(k) for k in kinds)})) AS n, count({c}) FILTER (WHERE kind IN ({', '.join(repr(k) for k in kinds)})) AS h FROM ev GROUP BY run_id" for c, kinds in APPLICABLE.items()) + """)
    SELECT run_id, field, CASE WHEN h = n THEN CASE WHEN n > 0 THEN 'present' END WHEN h = 0 THEN 'absent' ELSE 'partial' END AS state FROM f""")
def event_coverage(spark, sf_dir):
    return field_states(fixture(spark, sf_dir))


def merged_runs(runs: DataFrame) -> DataFrame:
    """One row a run of those that several files tell (run_id, file, format, conversation, started, ended): the first
    file's format and conversation, the widest span, all files, and what the files disagree on."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("file"))).alias(c)
    differ = lambda c: F.when(F.count_distinct(c) > 1, F.lit(c))
    return runs.groupBy("run_id").agg(first("format"), first("conversation"), F.min("started").alias("started"), F.max("ended").alias("ended"), F.array_sort(F.collect_set("file")).alias("files"), F.array_compact(F.array(differ("format"), differ("conversation"))).alias("conflicts"))


@query("""WITH r AS (SELECT o_custkey AS run_id, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS file, o_orderstatus AS format, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS conversation, o_orderdate AS started, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 1 HOUR END AS ended FROM orders)
    SELECT run_id, arg_min(format, file) AS format, arg_min(conversation, file) AS conversation, min(started) AS started, max(ended) AS ended, string_agg(file, ',' ORDER BY file) AS files, concat_ws(',', CASE WHEN count(DISTINCT format) > 1 THEN 'format' END, CASE WHEN count(DISTINCT conversation) > 1 THEN 'conversation' END) AS conflicts FROM r GROUP BY run_id""")
def run_merge(spark, sf_dir):
    order = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.lpad(order.cast("string"), 9, "0").alias("file"), F.col("o_orderstatus").alias("format"), F.when(order % 3 > 0, F.col("o_orderpriority")).alias("conversation"), F.col("o_orderdate").alias("started"), F.when(order % 2 == 0, F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("ended"))
    return merged_runs(rows).withColumn("files", F.array_join("files", ",")).withColumn("conflicts", F.array_join("conflicts", ","))
