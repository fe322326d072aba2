"""What a collector tells of single records: surfaces, outcomes, agents, resources, resets, settings, emission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.operators.canonical import winner
from meterloom.operators.components import checkpointed
from meterloom.operators.joins import keyed_diff, null_safe_join
from meterloom.operators.trees import climbed
from meterloom.plans.registry import query, table


def surface(provider: Column, origin: Column, source: Column) -> Column:
    """The product that a transcript comes from. One provider names an entry point, and none is its command
    line; the other an originator, which decides before its source."""
    low = F.lower(origin)
    entry = F.when(origin.isNull() | (origin == "cli"), "cli").when(origin == "claude-desktop", "desktop").when(origin == "claude-vscode", "ide").when(F.startswith(origin, F.lit("sdk-")), "sdk").otherwise("unknown")
    by_source = F.when(source.isNull() | source.isin("cli", "exec"), "cli").when(source == "vscode", "ide").otherwise("unknown")
    named = F.when(low.isin("codex_cli_rs", "codex_exec"), "cli").when(F.contains(low, F.lit("desktop")), "desktop").when(low.rlike("vscode|vs code|jetbrains"), "ide").otherwise(by_source)
    return F.when(provider == "claude", entry).otherwise(named)


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'claude' ELSE 'codex' END AS p, CASE o_custkey % 8 WHEN 1 THEN 'cli' WHEN 2 THEN 'claude-desktop' WHEN 3 THEN 'claude-vscode' WHEN 4 THEN 'sdk-py' WHEN 5 THEN 'Codex Desktop' WHEN 6 THEN 'codex_exec' WHEN 7 THEN 'My VS Code' END AS o, CASE o_orderstatus WHEN 'F' THEN 'vscode' WHEN 'O' THEN 'exec' WHEN 'P' THEN 'web' END AS s FROM orders)
    SELECT o_orderkey, CASE p WHEN 'claude' THEN CASE WHEN o IS NULL OR o = 'cli' THEN 'cli' WHEN o = 'claude-desktop' THEN 'desktop' WHEN o = 'claude-vscode' THEN 'ide' WHEN o = 'sdk-py' THEN 'sdk' ELSE 'unknown' END
        ELSE CASE WHEN o = 'codex_exec' THEN 'cli' WHEN o IN ('Codex Desktop', 'claude-desktop') THEN 'desktop' WHEN o IN ('My VS Code', 'claude-vscode') THEN 'ide' ELSE CASE s WHEN 'vscode' THEN 'ide' WHEN 'exec' THEN 'cli' ELSE 'unknown' END END END AS surface FROM o""")
def product_surfaces(spark, sf_dir):
    n = F.col("o_custkey") % 8
    names = (None, "cli", "claude-desktop", "claude-vscode", "sdk-py", "Codex Desktop", "codex_exec", "My VS Code")
    origin = F.coalesce(*[F.when(n == i, F.lit(name)) for i, name in enumerate(names) if name])
    source = F.when(F.col("o_orderstatus") == "F", "vscode").when(F.col("o_orderstatus") == "O", "exec").otherwise("web")
    return table(spark, sf_dir, "orders").select("o_orderkey", surface(F.when(F.col("o_orderkey") % 2 == 0, "claude").otherwise("codex"), origin, source).alias("surface"))


#: Words by which results tell how they ended, and texts that say a person declined.
WORDS = {"succeeded": ("completed", "complete", "succeeded", "success", "ok"), "failed": ("failed", "failure", "error"), "denied": ("denied", "rejected", "permission_denied"), "cancelled": ("cancelled", "canceled", "aborted", "interrupted")}
DECLINED = ("permission request denied", "permission denied by user", "exec command rejected by user")


def outcome(status: Column, is_error: Column, text: Column) -> Column:
    """How a call ended: by its status word, by its error flag, by an exit code or a refusal in the text, in this
    order; unknown where nothing tells."""
    low = F.lower(F.substring(text, 1, 8192))
    explicit = F.coalesce(*[F.when(F.lower(status).isin(*words), name) for name, words in WORDS.items()])
    code = F.regexp_extract(low, r"process exited with code\s+(-?\d+)", 1).try_cast("bigint")
    declined = F.lit(False)
    for words in DECLINED:
        declined = declined | F.contains(low, F.lit(words))
    flagged = F.when(is_error, "failed").when(~is_error, "succeeded")
    return F.coalesce(explicit, F.when(declined, "denied"), flagged, F.when(code == 0, "succeeded").when(code.isNotNull(), "failed"), F.lit("unknown"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey % 9 AS k, CASE l_linenumber WHEN 1 THEN l_partkey % 2 = 0 END AS e, l_suppkey % 3 AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'denied' WHEN 3 THEN 'cancelled' WHEN 4 THEN 'denied' ELSE CASE WHEN e IS NOT NULL THEN CASE WHEN e THEN 'failed' ELSE 'succeeded' END WHEN k = 5 THEN CASE WHEN c = 0 THEN 'succeeded' ELSE 'failed' END ELSE 'unknown' END END AS outcome FROM r""")
def tool_outcomes(spark, sf_dir):
    k, code = F.col("l_partkey") % 9, (F.col("l_suppkey") % 3).cast("string")
    status = F.when(k == 0, "Success").when(k == 1, "FAILURE").when(k == 2, "permission_denied").when(k == 3, "Aborted").when(k == 6, "running")
    said = F.when(k == 4, "Sorry: Permission request DENIED").when(k == 5, F.concat(F.lit("x\nProcess exited with code "), code)).otherwise("plain")
    failed = F.when(F.col("l_linenumber") == 1, F.col("l_partkey") % 2 == 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", outcome(status, failed, said).alias("outcome"))


def agent_class(provider: Column, name: Column, builtins: dict[str, Sequence[str]]) -> Column:
    """builtin, custom or unknown; without a name one provider's agents are built in, the others' unknown."""
    known = F.lit(False)
    for p, names in builtins.items():
        known = known | ((provider == p) & name.isin(*names))
    return F.when(name.isNull(), F.when(provider == "codex", "builtin").otherwise("unknown")).when(known, "builtin").otherwise("custom")


def hashed_name(name: Column, key: str) -> Column:
    """A name that can't be confirmed by guessing: h: and 16 digits of its digest under an install's key."""
    return F.when(F.trim(name) != "", F.concat(F.lit("h:"), F.substring(F.sha2(F.concat(F.lit(key), F.lit("\0"), F.trim(name)), 256), 1, 16)))


@query("""WITH a AS (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'codex' ELSE 'claude' END AS p, CASE c_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'worker' WHEN 2 THEN 'Explore' ELSE c_mktsegment END AS n FROM customer), k AS (SELECT *, CASE WHEN n IS NULL THEN CASE p WHEN 'codex' THEN 'builtin' ELSE 'unknown' END WHEN (p = 'codex' AND n = 'worker') OR (p = 'claude' AND n = 'Explore') THEN 'builtin' ELSE 'custom' END AS class FROM a)
    SELECT c_custkey, class, CASE class WHEN 'builtin' THEN n WHEN 'custom' THEN 'h:' || substr(sha256('key' || chr(0) || n), 1, 16) END AS name FROM k""")
def agent_classes(spark, sf_dir):
    provider, n = F.when(F.col("c_nationkey") % 2 == 0, "codex").otherwise("claude"), F.col("c_nationkey") % 5
    name = F.when(n == 1, "worker").when(n == 2, "Explore").when(n > 2, F.col("c_mktsegment"))
    kind = agent_class(provider, name, {"codex": ("worker", "default"), "claude": ("Explore", "Plan")})
    return table(spark, sf_dir, "customer").select("c_custkey", kind.alias("class"), F.when(kind == "builtin", name).when(kind == "custom", hashed_name(name, "key")).alias("name"))


#: Strength of kinds and bases of an access.
KINDS, BASES = ("unknown", "search", "read", "write"), ("unknown", "inferred", "argument", "native")


def resource_matches(candidates: DataFrame, roots: DataFrame) -> DataFrame:
    """invocation, resource, access_kind, evidence_basis and nested of candidate paths (invocation, path, kind,
    basis) that lie at or below a root (resource, root): one row a resource with its strongest kind and basis,
    nested where a path lies below several. A path meets its own ancestors by equality, not every root."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    chains = candidates.select("path").distinct().select("path", F.explode(ups).alias("root"))
    hits = chains.join(roots, "root").select("path", "resource")
    nested = hits.groupBy("path").agg((F.count("*") > 1).alias("nested"))
    rank = lambda c, listed: F.array_position(F.array(*map(F.lit, listed)), F.col(c))
    rows = candidates.join(hits, "path").join(nested, "path")
    best = lambda c, listed: F.element_at(F.array(*map(F.lit, listed)), F.greatest(F.max(rank(c, listed)), F.lit(1)).cast("int"))
    return rows.groupBy("invocation", "resource").agg(best("kind", KINDS).alias("access_kind"), best("basis", BASES).alias("evidence_basis"), F.bool_or("nested").alias("nested"))


@query("""WITH c AS (SELECT l_orderkey AS invocation, '/r' || l_suppkey % 4 || CASE WHEN l_linenumber % 2 = 0 THEN '/sub/x' || l_partkey % 9 ELSE '' END AS path, CASE l_returnflag WHEN 'R' THEN 'read' WHEN 'A' THEN 'write' ELSE 'search' END AS kind, CASE WHEN l_linenumber < 3 THEN 'argument' ELSE 'inferred' END AS basis FROM lineitem),
    r(resource, root) AS (VALUES ('a', '/r0'), ('b', '/r1'), ('c', '/r1/sub'), ('c', '/r2/sub/x3'), ('d', '/r')), h AS (SELECT c.*, resource FROM c JOIN r ON c.path = root OR starts_with(c.path, root || '/')), n AS (SELECT path, count(*) > 1 AS nested FROM (SELECT DISTINCT path FROM c) p JOIN r ON p.path = root OR starts_with(p.path, root || '/') GROUP BY path)
    SELECT invocation, resource, CASE max(CASE kind WHEN 'search' THEN 2 WHEN 'read' THEN 3 ELSE 4 END) WHEN 2 THEN 'search' WHEN 3 THEN 'read' ELSE 'write' END AS access_kind, CASE max(CASE basis WHEN 'inferred' THEN 2 ELSE 3 END) WHEN 2 THEN 'inferred' ELSE 'argument' END AS evidence_basis, bool_or(nested) AS nested FROM h JOIN n USING (path) GROUP BY 1, 2""")
def resource_access(spark, sf_dir):
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    path = F.concat(F.lit("/r"), F.col("l_suppkey") % 4, F.when(line % 2 == 0, F.concat(F.lit("/sub/x"), F.col("l_partkey") % 9)).otherwise(""))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("invocation"), path.alias("path"), F.when(flag == "R", "read").when(flag == "A", "write").otherwise("search").alias("kind"), F.when(line < 3, "argument").otherwise("inferred").alias("basis"))
    roots = spark.createDataFrame([("a", "/r0"), ("b", "/r1"), ("c", "/r1/sub"), ("c", "/r2/sub/x3"), ("d", "/r")], "resource string, root string")
    return resource_matches(rows, roots)


def connector_class(calls: DataFrame, connectors: DataFrame) -> DataFrame:
    """calls (connector, ...) with class and resource: matched where just one resource names the connector,
    ambiguous where several do, unmatched where none, no_evidence without one."""
    known = connectors.groupBy("connector").agg(F.count_distinct("resource").alias("_n"), F.min("resource").alias("_r"))
    joined = calls.join(known, "connector", "left")
    kind = F.when(F.col("connector").isNull(), "no_evidence").when(F.col("_n").isNull(), "unmatched").when(F.col("_n") > 1, "ambiguous").otherwise("matched")
    return joined.withColumn("class", kind).withColumn("resource", F.when(F.col("class") == "matched", F.col("_r"))).drop("_n", "_r")


@query("""WITH k AS (SELECT 'c' || CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey - 1 ELSE s_suppkey END AS connector, 'r' || s_suppkey AS resource FROM supplier), n AS (SELECT connector, count(DISTINCT resource) AS n, min(resource) AS r FROM k GROUP BY 1), c AS (SELECT o_orderkey, CASE WHEN o_custkey % 9 < 8 THEN 'c' || o_custkey END AS connector FROM orders)
    SELECT o_orderkey, CASE WHEN c.connector IS NULL THEN 'no_evidence' WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS class, CASE WHEN n = 1 THEN r END AS resource FROM c LEFT JOIN n USING (connector)""")
def connector_matches(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey") - F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(0)).alias("connector"), F.concat(F.lit("r"), "s_suppkey").alias("resource"))
    calls = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 9 < 8, F.concat(F.lit("c"), F.col("o_custkey"))).alias("connector"))
    return connector_class(calls, known).select("o_orderkey", "class", "resource")


def in_agent_setting(include: bool) -> Column:
    """Whether a request counts while subagents are collected or not: what nothing is known of stays, since that
    is no evidence of a child."""
    unknown = F.col("agent_key").isNull() & F.col("parent_agent_key").isNull() & F.col("agent_depth").isNull()
    return F.lit(include) | (F.col("parent_session").isNull() & (~F.col("agent_observed") | F.coalesce(F.col("agent_class") == "main", F.lit(False)) | unknown))


@query("""WITH r AS (SELECT *, CASE WHEN l_partkey % 11 = 0 THEN 'p' END AS ps, l_suppkey % 3 > 0 AS ob, CASE l_linenumber WHEN 1 THEN 'main' WHEN 2 THEN 'custom' END AS cl, CASE WHEN l_linenumber BETWEEN 2 AND 4 THEN 'k' END AS ak, CASE WHEN l_linenumber = 5 THEN 'p' END AS pk FROM lineitem)
    SELECT l_orderkey, count(*) AS all_calls, count(*) FILTER (WHERE ps IS NULL AND (NOT ob OR coalesce(cl = 'main', false) OR (ak IS NULL AND pk IS NULL))) AS main_calls FROM r GROUP BY l_orderkey""")
def agent_setting_buckets(spark, sf_dir):
    line = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_partkey") % 11 == 0, "p").alias("parent_session"), (F.col("l_suppkey") % 3 > 0).alias("agent_observed"), F.when(line == 1, "main").when(line == 2, "custom").alias("agent_class"), F.when(line.between(2, 4), "k").alias("agent_key"), F.when(line == 5, "p").alias("parent_agent_key"), F.lit(None).cast("int").alias("agent_depth"))
    return rows.groupBy("l_orderkey").agg(F.count_if(in_agent_setting(True)).alias("all_calls"), F.count_if(in_agent_setting(False)).alias("main_calls"))


def reset_kind(item: dict[str, Column]) -> Column:
    """What an entry of a reset feed says happened, whether reported, announced or forecast."""
    told = F.coalesce(item["kind"], F.when(item["category"] == "forecast", "forecast").when(item["status"].rlike("(?i)banked"), "banked").when(item["scope"].rlike("(?i)global"), "global").otherwise("reset"))
    return F.when(told == "watch", "signal").otherwise(told)


@query("""WITH i AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'watch' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'history' WHEN 'O' THEN 'announcement' ELSE 'forecast' END AS category, CASE WHEN o_custkey % 4 = 0 THEN 'Banked now' ELSE 'open' END AS status, CASE WHEN o_custkey % 3 = 0 THEN 'GLOBAL' END AS scope, 'p' || o_custkey % 3 AS provider, 'u' || o_custkey % 10 AS url, o_orderdate AS at_ FROM orders),
    k AS (SELECT *, CASE WHEN kind = 'watch' THEN 'signal' WHEN category = 'forecast' THEN 'forecast' WHEN status = 'Banked now' THEN 'banked' WHEN scope = 'GLOBAL' THEN 'global' ELSE 'reset' END AS type FROM i)
    SELECT provider, url, category, CASE type WHEN 'global' THEN 'reset' WHEN 'signal' THEN 'watch' ELSE type END AS entry, count(*) AS entries, min(o_orderkey) FILTER (WHERE type IN ('global', 'reset')) AS first_reset, bool_and(category <> 'history') AS planned, arg_max(type, (at_, o_orderkey)) AS newest_type FROM k GROUP BY 1, 2, 3, 4""")
def reset_entries(spark, sf_dir):
    """Entries that tell one event, an announcement apart from its later observation."""
    order, key, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    category = F.when(status == "F", "history").when(status == "O", "announcement").otherwise("forecast")
    item = {"kind": F.when(order % 5 == 0, "watch"), "category": category, "status": F.when(key % 4 == 0, "Banked now").otherwise("open"), "scope": F.when(key % 3 == 0, "GLOBAL")}
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.concat(F.lit("p"), key % 3).alias("provider"), F.concat(F.lit("u"), key % 10).alias("url"), category.alias("category"), reset_kind(item).alias("type"))
    entry = F.when(F.col("type") == "global", "reset").when(F.col("type") == "signal", "watch").otherwise(F.col("type"))
    return rows.groupBy("provider", "url", "category", entry.alias("entry")).agg(
        F.count("*").alias("entries"), F.min(F.when(F.col("type").isin("global", "reset"), F.col("o_orderkey"))).alias("first_reset"), F.bool_and(F.col("category") != "history").alias("planned"), F.max_by("type", F.struct("o_orderdate", "o_orderkey")).alias("newest_type")
    )


@query("""SELECT o_custkey AS kind, o_orderkey AS report FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'P' AND o_custkey % 2 = 0 AND o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderstatus <> 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey DESC) = 1""")
def default_report(spark, sf_dir):
    """The report that is shown first: a full one where the kind has them, the newest that did not fail, or any."""
    good = F.col("o_orderstatus") != "P"
    full = good & (F.col("o_custkey") % 2 == 0) & (F.col("o_orderpriority") == "1-URGENT")
    rank = F.when(full, 2).when(good, 1).otherwise(0)
    return winner(table(spark, sf_dir, "orders"), ["o_custkey"], [rank, "o_orderdate", "o_orderkey"], ["o_orderkey"]).select(F.col("o_custkey").alias("kind"), F.col("o_orderkey").alias("report"))


def to_emit(state: DataFrame, published: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """Rows of state whose content is not what was published for their key, and why: new or revised."""
    old = published.groupBy(*keys).agg(F.max(content).alias("_old"), F.lit(True).alias("_known"))
    told = state.join(old, list(keys), "left").withColumn("change", F.when(F.col("_known").isNull(), "new").when(~F.col(content).eqNullSafe(F.col("_old")), "revised"))
    return told.where("change IS NOT NULL").drop("_old", "_known")


def with_dependents(changed: DataFrame, state: DataFrame, keys: Sequence[str], depends: DataFrame, on: Sequence[str]) -> DataFrame:
    """changed (keys, ..., change) and the rows of state that depend on one of them (depends: keys and, under `on`, the
    keys of what they rest on) without having changed themselves: `dependent`, each once, however long the chain that
    leads to them. A round takes what rests on the rows that the one before it found, and only what is new, so
    circles end."""
    keys, on = list(keys), list(on)
    found = front = checkpointed(changed.select(*keys).distinct(), "changed")
    while True:
        named = front.select(*[F.col(k).alias(o) for k, o in zip(keys, on)])
        up = null_safe_join(depends, named, on, "left_semi").select(*keys).distinct()
        front = checkpointed(null_safe_join(up, found, keys, "left_anti"), "dependents")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    resting = null_safe_join(null_safe_join(state, found, keys, "left_semi"), changed, keys, "left_anti")
    return changed.unionByName(resting.withColumn("change", F.lit("dependent")).select(changed.columns))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS c FROM lineitem GROUP BY ALL), p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN max(l_quantity) + 1 ELSE max(l_quantity) END AS c FROM lineitem WHERE l_partkey % 4 > 0 GROUP BY l_orderkey, l_linenumber)
    SELECT s.l_orderkey, s.l_linenumber, CASE WHEN p.l_orderkey IS NULL THEN 'new' ELSE 'revised' END AS change FROM s LEFT JOIN p USING (l_orderkey, l_linenumber) WHERE p.l_orderkey IS NULL OR p.c IS DISTINCT FROM s.c""")
def incremental_emission(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    state = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("c"))
    sent = lines.where("l_partkey % 4 > 0").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_quantity") + F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0)).alias("c"))
    return to_emit(state, sent, ["l_orderkey", "l_linenumber"], "c").select("l_orderkey", "l_linenumber", "change")


@query("""WITH RECURSIVE c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 0 THEN 'new' WHEN o_orderkey % 90 = 7 THEN 'revised' END AS change FROM orders), d AS (SELECT o_orderkey AS row, CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey - o_orderkey % 6 ELSE o_orderkey - o_orderkey % 36 END AS base FROM orders WHERE o_orderkey % 36 > 0),
    r AS (SELECT o_orderkey AS row FROM c WHERE change IS NOT NULL UNION SELECT d.row FROM r JOIN d ON d.base = r.row) SELECT c.o_orderkey, coalesce(change, 'dependent') AS change FROM c JOIN r ON r.row = c.o_orderkey""")
def emission_with_dependents(spark, sf_dir):
    """What is sent again since it changed, or since it rests on what did."""
    order = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(order % 90 == 7, 1).otherwise(0).alias("c"))
    sent = orders.where(order % 40 > 0).withColumn("c", F.lit(0))
    depends = orders.where(order % 36 > 0).select("o_orderkey", (order - F.when(order % 6 > 0, order % 6).otherwise(order % 36)).alias("base"))
    return with_dependents(to_emit(orders, sent, ["o_orderkey"], "c"), orders, ["o_orderkey"], depends, ["base"]).select("o_orderkey", "change")


@query("""WITH b AS (SELECT p_brand, p_partkey, p_size, p_type FROM part WHERE p_partkey % 10 > 0), a AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE p_type END AS p_type FROM part WHERE p_partkey % 9 > 0)
    SELECT coalesce(a.p_brand, b.p_brand) AS kind, count(*) FILTER (WHERE b.p_partkey IS NULL) AS added, count(*) FILTER (WHERE a.p_partkey IS NULL) AS lost, count(*) FILTER (WHERE a.p_size <> b.p_size) AS size_revised, count(*) FILTER (WHERE a.p_type <> b.p_type) AS type_revised,
        count(*) FILTER (WHERE a.p_partkey IS NULL OR a.p_type <> b.p_type) = 0 AS passes FROM b FULL JOIN a ON a.p_partkey = b.p_partkey GROUP BY 1""")
def upgrade_gate(spark, sf_dir):
    """What a new build would change of what was published, by field: rows may come, none may go or change type."""
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    before = part.where("p_partkey % 10 > 0").select("p_brand", "p_partkey", "p_size", "p_type", F.lit("b").alias("side"))
    after = part.where("p_partkey % 9 > 0").select("p_brand", "p_partkey", (F.col("p_size") + F.when(key % 7 == 0, 1).otherwise(0)).alias("p_size"), F.when(key % 11 == 0, "x").otherwise(F.col("p_type")).alias("p_type"), F.lit("a").alias("side"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.struct("p_size", "p_type"))).alias(side)
    both = before.unionByName(after).groupBy("p_brand", "p_partkey").agg(of("b"), of("a"))
    differs = lambda c: F.coalesce(F.col(f"a.{c}") != F.col(f"b.{c}"), F.lit(False))
    lost = F.col("a").isNull()
    return both.groupBy(F.col("p_brand").alias("kind")).agg(F.count_if(F.col("b").isNull()).alias("added"), F.count_if(lost).alias("lost"), F.count_if(differs("p_size")).alias("size_revised"), F.count_if(differs("p_type")).alias("type_revised"), (F.count_if(lost | differs("p_type")) == 0).alias("passes"))


def merged_settings(documents: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """keys and settings: the groups (map of maps) of documents in order, a later group replacing an earlier one of
    its name, and what a group leaves out coming from the first document, the defaults."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "settings")), lambda a, b: a["o"].cast("int") - b["o"].cast("int"))
    zero = F.create_map().cast("map<string,map<string,string>>")
    last = F.aggregate("listed", zero, lambda held, d: F.map_concat(F.map_filter(held, lambda k, _: ~F.map_contains_key(d["settings"], k)), d["settings"]))
    filled = F.map_zip_with("last", F.element_at("listed", 1)["settings"], lambda _, own, first: F.when(own.isNull(), first).otherwise(F.map_zip_with(own, F.coalesce(first, F.create_map().cast("map<string,string>")), lambda __, a, b: F.coalesce(a, b))))
    return documents.groupBy(*keys).agg(listed.alias("listed")).withColumn("last", last).select(*keys, filled.alias("settings"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'own' ELSE 'base' END AS mode, CASE WHEN s_suppkey % 3 = 0 THEN 'low' ELSE 'full' END AS detail, CASE WHEN s_suppkey % 3 = 0 THEN 'off' ELSE 'on' END AS hooks FROM supplier""")
def effective_settings(spark, sf_dir):
    """Defaults, then the account's document, then the install's: groups are replaced whole, gaps filled."""
    def group(name, entries):
        return F.create_map(F.lit(name), entries)

    key, keys = F.col("s_suppkey"), table(spark, sf_dir, "supplier").select("s_suppkey")
    none = F.create_map().cast("map<string,map<string,string>>")
    pair = lambda a, b: F.create_map(F.lit(a), F.lit(b))
    defaults = keys.select("s_suppkey", F.lit(0).alias("o"), F.create_map(F.lit("execution"), F.create_map(F.lit("mode"), F.lit("base"), F.lit("detail"), F.lit("full")), F.lit("hooks"), pair("state", "on")).alias("settings"))
    account = keys.select("s_suppkey", F.lit(1).alias("o"), F.when(key % 3 == 0, F.create_map(F.lit("execution"), pair("detail", "low"), F.lit("hooks"), pair("state", "off"))).otherwise(none).alias("settings"))
    install = keys.select("s_suppkey", F.lit(2).alias("o"), F.when(key % 2 == 0, group("execution", F.when(key % 3 == 0, F.create_map(F.lit("mode"), F.lit("own"), F.lit("detail"), F.lit("low"))).otherwise(pair("mode", "own")))).otherwise(none).alias("settings"))
    found = merged_settings(defaults.unionByName(account).unionByName(install), ["s_suppkey"], "o")
    at = lambda a, b: F.col("settings")[a][b]
    return found.select("s_suppkey", at("execution", "mode").alias("mode"), at("execution", "detail").alias("detail"), at("hooks", "state").alias("hooks"))


@query("""WITH r AS (SELECT l_orderkey, l_suppkey % 4 AS proj, l_linestatus, l_shipdate FROM lineitem), u AS (SELECT proj, count(*) AS requests, count(DISTINCT l_orderkey) AS sessions, count(DISTINCT l_orderkey % 10) FILTER (WHERE l_linestatus = 'F') AS folders, max(l_shipdate) AS last_seen FROM r GROUP BY proj),
    c AS (SELECT s_suppkey % 5 AS proj, arg_max(s_name, (s_acctbal > 0, s_acctbal)) AS name, bool_or(s_acctbal > 0) AS active, count(DISTINCT s_nationkey) AS machines FROM supplier GROUP BY 1)
    SELECT proj, CASE WHEN active THEN name ELSE name || ' (removed)' END AS name, CAST(machines AS BIGINT) AS machines, coalesce(requests, 0) AS requests, coalesce(sessions, 0) AS sessions, coalesce(folders, 0) AS folders, last_seen FROM c LEFT JOIN u USING (proj)""")
def project_statistics(spark, sf_dir):
    """Every project of the catalogue with what was ever seen of it; one that is nowhere active is marked."""
    lines = table(spark, sf_dir, "lineitem").withColumn("proj", F.col("l_suppkey") % 4)
    used = lines.groupBy("proj").agg(F.count("*").alias("requests"), F.count_distinct("l_orderkey").alias("sessions"), F.count_distinct(F.when(F.col("l_linestatus") == "F", F.col("l_orderkey") % 10)).alias("folders"), F.max("l_shipdate").alias("last_seen"))
    active = F.col("s_acctbal") > 0
    listed = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 5).alias("proj")).agg(F.max_by("s_name", F.struct(active.alias("a"), "s_acctbal")).alias("name"), F.bool_or(active).alias("active"), F.count_distinct("s_nationkey").alias("machines"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return listed.join(used, "proj", "left").select("proj", F.when(F.col("active"), F.col("name")).otherwise(F.concat("name", F.lit(" (removed)"))).alias("name"), "machines", zero("requests"), zero("sessions"), zero("folders"), "last_seen")


def descendants(tree: DataFrame, keys: Sequence[str], node: str, parent: str) -> DataFrame:
    """keys, node and how many nodes lie below it, however deep; below a node of a circle lies all of the circle
    and what hangs on it."""
    return climbed(tree, node=node, parent=parent, keys=keys).select(*keys, node, "below")


@query("""WITH RECURSIVE t AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 600 = 0 THEN o_orderkey + 5 WHEN o_orderkey % 200 > 0 THEN o_orderkey - 1 - CASE WHEN o_orderkey % 7 = 6 THEN 1 ELSE 0 END END AS p FROM orders),
    e AS (SELECT n, p FROM t WHERE p IN (SELECT n FROM t)), r AS (SELECT p AS a, n FROM e UNION SELECT e.p, r.n FROM r JOIN e ON e.n = r.a),
    c AS (SELECT a, count(DISTINCT n) AS below FROM r GROUP BY a) SELECT t.n AS o_orderkey, CAST(coalesce(below, 0) AS BIGINT) AS below FROM t LEFT JOIN c ON c.a = t.n""")
def nodes_below(spark, sf_dir):
    """Chains of 200 orders with side branches; every third of them leads round in a circle at its top."""
    i = F.col("o_orderkey")
    parent = F.when(i % 600 == 0, i + 5).when(i % 200 > 0, i - 1 - F.when(i % 7 == 6, 1).otherwise(0))
    return descendants(table(spark, sf_dir, "orders").select(i, parent.alias("parent")), [], "o_orderkey", "parent")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn // 2 END AS p FROM conversations), r AS (SELECT conv_id, p AS a, turn AS n FROM t WHERE p IS NOT NULL AND p <> turn UNION SELECT r.conv_id, t.p, r.n FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.a WHERE t.p IS NOT NULL AND t.p <> t.turn),
    c AS (SELECT conv_id, a AS turn, count(DISTINCT n) AS below FROM r GROUP BY 1, 2) SELECT DISTINCT t.conv_id, t.turn, coalesce(below, 0) AS below FROM t LEFT JOIN c USING (conv_id, turn)""")
def turns_below(spark, sf_dir):
    parent = F.when((F.col("turn") > 0) & (F.floor(F.col("turn") / 2) != F.col("turn")), F.floor(F.col("turn") / 2))
    return descendants(table(spark, sf_dir, "conversations").select("conv_id", "turn", parent.alias("parent")), ["conv_id"], "turn", "parent")


@query("""WITH b AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 6 > 0), h AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 5 > 0), d AS (SELECT CASE WHEN b.p_partkey IS NULL THEN 'added' WHEN h.p_partkey IS NULL THEN 'removed' WHEN b.p_size <> h.p_size THEN 'changed' ELSE 'same' END AS change, p_partkey FROM b FULL JOIN h USING (p_partkey))
    SELECT change, count(*) AS entries, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM d GROUP BY change""")
def diff_partition(spark, sf_dir):
    """Every key lies in one of four lists."""
    part = table(spark, sf_dir, "part")
    head = part.where("p_partkey % 5 > 0").select("p_partkey", (F.col("p_size") + F.when(F.col("p_partkey") % 4 == 0, 1).otherwise(0)).alias("p_size"))
    found = keyed_diff(part.where("p_partkey % 6 > 0"), head, ["p_partkey"], ["p_size"])
    return found.groupBy("change").agg(F.count("*").alias("entries"), F.min("p_partkey").alias("first_key"), F.max("p_partkey").alias("last_key"))
