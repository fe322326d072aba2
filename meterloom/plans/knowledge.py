"""What was read of which source of knowledge, and how far sources overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.operators.canonical import top_n, winner
from meterloom.operators.joins import null_safe_join
from meterloom.plans.registry import query, table

ACCESS_KINDS, BASES, OUTCOMES = ("read", "search", "write", "unknown"), ("explicit_argument", "connector", "indirect_shell", "unknown"), ("succeeded", "failed", "denied", "cancelled", "unknown")
_CALL = ["account", "invocation"]


def source_summaries(accesses: DataFrame, invocations: DataFrame, tools: int = 5) -> DataFrame:
    """A row for each source, and for each identity without one, of accesses (account, invocation, kind, basis, outcome,
    observed, source, identity, current) under the current configuration: how many, of how many calls, sessions and
    agents, by kind, basis and outcome, when, and the tools that made most calls.

    Session, agent and tool are those of the call's newest row (account, invocation, session, agent, tool, class,
    observed, id); an access whose call isn't known any more adds to none of them. Calls of different accounts are
    different calls."""
    calls = winner(invocations, _CALL, ["observed", "id"], ["session", "agent", "tool", "class"])
    own = accesses.where("identity IS NOT NULL AND current").withColumn("identity", F.when(F.col("source").isNull(), F.col("identity")))
    joined = null_safe_join(own, calls, _CALL)
    bucket = ["source", "identity"]
    # Distinct calls, sessions and agents of a bucket are counted over its distinct calls, not over its accesses.
    met = joined.groupBy(*bucket, *_CALL, "session", "agent", "tool", "class").agg(F.count("*").alias("n"), F.min("observed").alias("first"), F.max("observed").alias("last"), *[F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c, values in (("kind", ACCESS_KINDS), ("basis", BASES), ("outcome", OUTCOMES)) for v in values])
    tallies = [F.sum(c).alias(c) for c in met.columns if c.startswith(("kind_", "basis_", "outcome_"))]
    sums = met.groupBy(*bucket).agg(F.sum("n").alias("accesses"), F.count("*").alias("calls"), F.min("first").alias("first_observed"), F.max("last").alias("last_observed"), *tallies)
    for name in ("session", "agent"):
        seen = met.where(F.col(name).isNotNull()).select(*bucket, name).distinct().groupBy(*bucket).agg(F.count("*").alias(f"{name}s"))
        sums = null_safe_join(sums, seen, bucket).withColumn(f"{name}s", F.coalesce(f"{name}s", F.lit(0)))
    used = top_n(met.where("class IS NOT NULL").groupBy(*bucket, "tool", "class").agg(F.count("*").alias("n")), bucket, [F.desc("n"), F.asc("class"), F.asc("tool")], tools)
    listed = used.groupBy(*bucket).agg(F.array_sort(F.collect_list(F.struct("rank", "tool", "class", "n"))).alias("top_tools"))
    return null_safe_join(sums, listed, bucket)


def overlap(accesses: DataFrame) -> DataFrame:
    """One row that says by how much totals of sources overlap: accesses under the current configuration, the calls that
    they are of, the calls with several, those under earlier configurations, and where accesses led."""
    current = F.col("identity").isNotNull() & F.col("current")
    by_call = accesses.groupBy(*_CALL).agg(F.count_if(current).alias("n"), F.count("*").alias("all"), F.count_if(F.col("identity").isNotNull() & ~F.col("current")).alias("earlier"), F.count_if(F.col("source").isNotNull()).alias("resolved"), F.count_if(F.col("source").isNull() & F.col("identity").isNotNull()).alias("unassigned"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    found = by_call.agg(zero(F.sum("all"), "accesses"), zero(F.sum("n"), "current_accesses"), zero(F.sum("earlier"), "earlier_accesses"), F.count_if(F.col("n") > 0).alias("calls"), F.count_if(F.col("n") > 1).alias("overlapping_calls"), zero(F.sum("resolved"), "of_a_source"), zero(F.sum("unassigned"), "unassigned"))
    return found.withColumn("counted_twice", F.col("current_accesses") - F.col("calls"))


def nested_roots(roots: DataFrame, keys: Sequence[str], root: str, separator: str = "/") -> DataFrame:
    """keys and root of each distinct root with `inside`, the deepest other one that holds it, and how many do: each is
    asked for by its own ancestors, not compared with all others."""
    own = roots.where(F.col(root).isNotNull()).select(*keys, root).distinct()
    parts = F.split(F.col(root), separator)
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), separator).alias("holder")))
    chains = own.select(*keys, root, F.inline(above)).where(F.col("holder") != F.col(root))
    found = chains.join(own.withColumnRenamed(root, "holder"), [*keys, "holder"]).groupBy(*keys, root).agg(F.max_by("holder", "depth").alias("inside"), F.count("*").alias("holders"))
    return own.join(found, [*keys, root], "left").withColumn("holders", F.coalesce("holders", F.lit(0)))


_ACCESS = """a AS (SELECT l_suppkey % 3 AS account, l_orderkey AS invocation, CASE l_partkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'search' WHEN 2 THEN 'write' ELSE 'unknown' END AS kind, CASE WHEN l_partkey % 2 = 0 THEN 'connector' ELSE 'unknown' END AS basis, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'succeeded' END AS outcome,
        l_shipdate AS observed, CASE WHEN l_partkey % 5 > 0 THEN 's' || l_partkey % 5 END AS source, CASE WHEN l_partkey % 9 > 0 THEN 'i' || l_partkey % 45 END AS identity, l_linenumber < 6 AS current FROM lineitem)"""


def _accesses(spark, sf_dir) -> DataFrame:
    part = F.col("l_partkey")
    kind = F.when(part % 4 == 0, "read").when(part % 4 == 1, "search").when(part % 4 == 2, "write").otherwise("unknown")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 3).alias("account"),
        F.col("l_orderkey").alias("invocation"),
        kind.alias("kind"),
        F.when(part % 2 == 0, "connector").otherwise("unknown").alias("basis"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("succeeded").alias("outcome"),
        F.col("l_shipdate").alias("observed"),
        F.when(part % 5 > 0, F.concat(F.lit("s"), part % 5)).alias("source"),
        F.when(part % 9 > 0, F.concat(F.lit("i"), part % 45)).alias("identity"),
        (F.col("l_linenumber") < 6).alias("current"),
    )


@query(f"""WITH {_ACCESS}, t AS (SELECT account, o_orderkey AS invocation, 'c' || o_custkey % 50 AS session, CASE WHEN o_orderkey % 4 = 0 THEN 'g' || o_custkey % 7 END AS agent, o_orderpriority AS tool, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS class FROM orders, (VALUES (0), (1), (2)) v(account) WHERE (o_orderkey + account) % 6 > 0),
    j AS (SELECT a.* EXCLUDE (identity), CASE WHEN source IS NULL THEN identity END AS identity, session, agent, tool, class, a.account * 1000000000 + a.invocation AS call FROM a LEFT JOIN t ON t.account = a.account AND t.invocation = a.invocation WHERE identity IS NOT NULL AND current),
    q AS (SELECT source, identity, tool, class, count(DISTINCT call) AS n FROM j WHERE class IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source, identity ORDER BY n DESC, class, tool) AS rank FROM q),
    l AS (SELECT source, identity, string_agg(tool || '/' || class || ':' || n, ',' ORDER BY rank) AS top_tools FROM r WHERE rank <= 5 GROUP BY ALL)
    SELECT j.source AS source, j.identity AS identity, count(*) AS accesses, count(DISTINCT call) AS calls, count(DISTINCT session) AS sessions, count(DISTINCT agent) AS agents, count(*) FILTER (WHERE kind = 'write') AS kind_write, count(*) FILTER (WHERE basis = 'connector') AS basis_connector, count(*) FILTER (WHERE outcome = 'failed') AS outcome_failed,
        min(observed) AS first_observed, max(observed) AS last_observed, any_value(l.top_tools) AS top_tools FROM j LEFT JOIN l ON l.source IS NOT DISTINCT FROM j.source AND l.identity IS NOT DISTINCT FROM j.identity GROUP BY j.source, j.identity""")
def knowledge_sources(spark, sf_dir):
    """Sources and unassigned identities with what was read of them, by calls that are told with revisions."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    accounts = orders.withColumn("account", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)]))).where((key + F.col("account")) % 6 > 0)
    rows = accounts.select("account", key.alias("invocation"), F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("session"), F.when(key % 4 == 0, F.concat(F.lit("g"), F.col("o_custkey") % 7)).alias("agent"), F.col("o_orderpriority").alias("tool"), F.when(key % 5 > 0, F.col("o_orderstatus")).alias("class"), F.col("o_orderdate").alias("observed"), F.lit(2).alias("id"))
    older = rows.withColumns({"tool": F.lit("older"), "session": F.lit("older"), "id": F.lit(1)})
    found = source_summaries(_accesses(spark, sf_dir), rows.unionByName(older))
    listed = F.array_join(F.transform("top_tools", lambda t: F.concat(t["tool"], F.lit("/"), t["class"], F.lit(":"), t["n"].cast("string"))), ",")
    return found.select("source", "identity", "accesses", "calls", "sessions", "agents", "kind_write", "basis_connector", "outcome_failed", "first_observed", "last_observed", listed.alias("top_tools"))


@query(f"""WITH {_ACCESS}, c AS (SELECT account, invocation, count(*) FILTER (WHERE identity IS NOT NULL AND current) AS n FROM a GROUP BY ALL)
    SELECT count(*) AS accesses, count(*) FILTER (WHERE identity IS NOT NULL AND current) AS current_accesses, count(*) FILTER (WHERE identity IS NOT NULL AND NOT current) AS earlier_accesses, (SELECT count(*) FROM c WHERE n > 0) AS calls, (SELECT count(*) FROM c WHERE n > 1) AS overlapping_calls,
        count(*) FILTER (WHERE source IS NOT NULL) AS of_a_source, count(*) FILTER (WHERE source IS NULL AND identity IS NOT NULL) AS unassigned, count(*) FILTER (WHERE identity IS NOT NULL AND current) - (SELECT count(*) FROM c WHERE n > 0) AS counted_twice FROM a""")
def knowledge_overlap(spark, sf_dir):
    return overlap(_accesses(spark, sf_dir))


@query("""WITH r AS (SELECT DISTINCT p_partkey % 5 AS install, CASE p_partkey % 3 WHEN 0 THEN '/r/' || p_size WHEN 1 THEN '/r/' || p_size || '/' || p_partkey % 40 ELSE '/r/' || p_size || '/' || p_partkey % 40 || '/x/' || p_partkey % 11 END AS root FROM part)
    SELECT a.install, a.root, arg_max(b.root, length(b.root)) AS inside, count(b.root) AS holders FROM r AS a LEFT JOIN r AS b ON b.install = a.install AND starts_with(a.root, b.root || '/') GROUP BY a.install, a.root""")
def knowledge_roots(spark, sf_dir):
    """Roots of each install and the roots that they lie in."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    first = F.concat(F.lit("/r/"), size)
    second = F.concat(first, F.lit("/"), (key % 40).cast("string"))
    root = F.when(key % 3 == 0, first).when(key % 3 == 1, second).otherwise(F.concat(second, F.lit("/x/"), (key % 11).cast("string")))
    return nested_roots(table(spark, sf_dir, "part").select((key % 5).alias("install"), root.alias("root")), ["install"], "root")
