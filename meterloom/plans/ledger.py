"""Batches judged before they are applied, states of allowance windows, nested calls, residuals, series and projects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.operators import aggregates, sequences
from meterloom.operators.canonical import top_n
from meterloom.plans.registry import query, table


def batch_verdicts(arrived: DataFrame, held: DataFrame, keys: Sequence[str], *, revision: str, order: Sequence[str]) -> DataFrame:
    """arrived with verdict and gain, what the first of the order columns would add to the totals.

    duplicate: the revision is held; new_key: nothing is held for its key; advancing: it would win over
    what is held; superseded: it would not. A null key is held by nothing."""
    best = held.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_best"))
    seen = held.select(revision).distinct().withColumn("_seen", F.lit(True))
    measure = F.col(order[0])
    verdict = F.when(F.col("_seen"), "duplicate").when(F.col("_best").isNull(), "new_key").when(F.struct(*order) > F.col("_best"), "advancing").otherwise("superseded")
    judged = arrived.join(best, list(keys), "left").join(seen, revision, "left").withColumn("verdict", verdict)
    gain = F.when(F.col("verdict") == "new_key", measure).when(F.col("verdict") == "advancing", measure - F.col(f"_best.{order[0]}")).otherwise(F.lit(0.0))
    return judged.withColumn("gain", gain).drop("_best", "_seen")


@query("""WITH held AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-20'), best AS (SELECT user_id, event_type, max(value) AS best FROM held GROUP BY ALL),
    j AS (SELECT a.event_id, a.value, best, CASE WHEN h.event_id IS NOT NULL THEN 'duplicate' WHEN best IS NULL THEN 'new_key' WHEN a.value > best THEN 'advancing' ELSE 'superseded' END AS verdict
        FROM events a LEFT JOIN best USING (user_id, event_type) LEFT JOIN held h ON h.event_id = a.event_id WHERE a.ts >= TIMESTAMP '2024-01-10')
    SELECT event_id, verdict, CASE verdict WHEN 'new_key' THEN value WHEN 'advancing' THEN value - best ELSE 0.0::DOUBLE END AS gain FROM j""")
def batch_verdict(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    arrived, held = events.where(F.col("ts") >= "2024-01-10"), events.where(F.col("ts") < "2024-01-20")
    return batch_verdicts(arrived, held, ["user_id", "event_type"], revision="event_id", order=["value"]).select("event_id", "verdict", "gain")


def window_states(readings: DataFrame, keys: Sequence[str], *, value: str, time: str, tie: str, reset: str, now: Column, cadence_minutes: Column | int = 60, gap_hours: int = 3) -> DataFrame:
    """The newest reading of each key with state, points an hour against the one before, the level that this comes to
    at the reset (projected) and the hours until all is used (exhausted_in; null where it isn't rising).

    insufficient: not between 0 and 100; stale: its window has ended, or it is older than two
    cadences and a quarter of an hour (two hours at least); discontinuous: another window, a fall, two levels
    at one time or a gap over gap_hours; usable otherwise. Only usable ones with a reading before have a rate."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    cadence = F.lit(cadence_minutes) if isinstance(cadence_minutes, int) else cadence_minutes
    reading = F.struct(F.col(value).alias("level"), micros(F.col(time)).alias("at"), micros(F.col(reset)).alias("reset"), F.col(tie).alias("id"), cadence.cast("bigint").alias("cadence"))
    newest = top_n(readings, keys, [F.desc(time), F.desc(tie)], 2, "_rank").groupBy(*keys)
    both = newest.agg(F.max(F.when(F.col("_rank") == 1, reading)).alias("c"), F.max(F.when(F.col("_rank") == 2, reading)).alias("p"))
    level, at, before, then = F.col("c.level"), F.col("c.at"), F.col("p.level"), F.col("p.at")
    old = (micros(now) - at) > F.greatest(F.lit(120), 2 * F.col("c.cadence") + 15) * 60_000_000
    broken = ~F.col("p.reset").eqNullSafe(F.col("c.reset")) | (before > level) | ((then == at) & (before != level)) | (at - then > gap_hours * 3_600_000_000)
    reason = F.when(F.col("c.reset") <= micros(now), "reset_passed").when(old, "too_old")
    state = (
        F.when(level.isNull() | ~level.between(0, 100), "insufficient")
        .when(F.col("reason").isNotNull(), "stale")
        .when(F.col("p").isNotNull() & F.coalesce(broken, F.lit(True)), "discontinuous")
        .otherwise("usable")
    )
    hours = (at - then) / 3.6e9
    rate = F.when((F.col("state") == "usable") & F.col("p").isNotNull(), F.when(hours > 0, (level - before) / hours).otherwise(0.0))
    found = both.withColumn("reason", reason).withColumn("state", state).withColumn("rate", rate)
    left = (F.col("c.reset") - at) / 3.6e9
    more = ((level + F.col("rate") * left).alias("projected"), F.when(F.col("rate") > 0, (100 - level) / F.col("rate")).alias("exhausted_in"))
    return found.select(*keys, F.col("c.id").alias(tie), level.alias("level"), "state", F.when(F.col("state") == "stale", F.col("reason")).alias("reason"), "rate", *more)


@query("""WITH r AS (SELECT user_id, event_id, value, ts, lead(value) OVER w AS pv, lead(ts) OVER w AS pt, row_number() OVER w AS n, CAST(date_trunc('week', ts) AS TIMESTAMP) + INTERVAL 7 DAY AS reset,
        lead(CAST(date_trunc('week', ts) AS TIMESTAMP) + INTERVAL 7 DAY) OVER w AS preset FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)),
    s AS (SELECT *, CASE WHEN reset <= TIMESTAMP '2024-01-31' THEN 'reset_passed' WHEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) > (CASE WHEN user_id % 2 = 0 THEN 173700000000 ELSE 951300000000 END) THEN 'too_old' END AS why FROM r WHERE n = 1),
    t AS (SELECT *, CASE WHEN value IS NULL OR value < 0 OR value > 100 THEN 'insufficient' WHEN why IS NOT NULL THEN 'stale'
        WHEN pt IS NOT NULL AND (reset <> preset OR pv > value OR (pt = ts AND pv <> value) OR epoch_us(ts) - epoch_us(pt) > 345600000000) THEN 'discontinuous' ELSE 'usable' END AS state FROM s),
    u AS (SELECT user_id, event_id, value AS level, state, CASE WHEN state = 'stale' THEN why END AS reason, (epoch_us(reset) - epoch_us(ts)) / 3.6e9 AS hours,
        CASE WHEN state = 'usable' AND pt IS NOT NULL THEN CASE WHEN ts > pt THEN (value - pv) / ((epoch_us(ts) - epoch_us(pt)) / 3.6e9) ELSE 0.0::DOUBLE END END AS rate FROM t)
    SELECT user_id, event_id, level, state, reason, rate, level + rate * hours AS projected, CASE WHEN rate > 0 THEN (100 - level) / rate END AS exhausted_in FROM u""")
def window_state(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("reset", F.date_trunc("week", "ts") + F.expr("INTERVAL 7 DAYS"))
    return window_states(events, ["user_id"], value="value", time="ts", tie="event_id", reset="reset", now=F.lit("2024-01-31"), cadence_minutes=F.when(F.col("user_id") % 2 == 0, 1440).otherwise(7920), gap_hours=96)


def nested_calls(calls: DataFrame, scope: Column, *, key: str, parent: str, name: str, wrapper: str, nestable: Column) -> DataFrame:
    """Calls in scope counted by name and place: top, child of a wrapper's call in scope, or orphan, whose
    wrapper is out of scope or, for nestable calls, not known. Other parents leave a call at the top."""
    parents = calls.select(F.col(key).alias("_id"), F.col(name).alias("_name"), scope.alias("_inside")).dropDuplicates(["_id"])
    joined = calls.where(scope).join(parents, F.col(parent) == F.col("_id"), "left")
    place = (
        F.when(F.col(parent).isNull(), "top")
        .when(F.col("_name") == wrapper, F.when(F.col("_inside"), "child").otherwise("orphan"))
        .when(F.col("_id").isNull() & nestable, "orphan")
        .otherwise("top")
    )
    under = F.when(F.col("place") == "child", wrapper).when(F.col("place") == "orphan", f"{wrapper} (outside range)")
    return joined.withColumn("place", place).withColumn("under", under).groupBy(F.col(name).alias("name"), "place", "under").agg(F.count("*").alias("calls"))


@query("""WITH c AS (SELECT event_id, event_type, ts, CASE WHEN event_type IN ('error', 'click') THEN event_id - 7 WHEN event_type = 'view' THEN event_id + 1000000000 END AS parent FROM events),
    n AS (SELECT c.event_type, CASE WHEN c.parent IS NULL THEN 'top' WHEN p.event_type = 'purchase' THEN CASE WHEN p.ts >= TIMESTAMP '2024-01-05' THEN 'child' ELSE 'orphan' END
        WHEN p.event_id IS NULL AND c.event_type = 'view' THEN 'orphan' ELSE 'top' END AS place FROM c LEFT JOIN events p ON p.event_id = c.parent WHERE c.ts >= TIMESTAMP '2024-01-05')
    SELECT event_type AS name, place, CASE place WHEN 'child' THEN 'purchase' WHEN 'orphan' THEN 'purchase (outside range)' END AS under, count(*) AS calls FROM n GROUP BY ALL""")
def tool_nesting(spark, sf_dir):
    kind = F.col("event_type")
    parent = F.when(kind.isin("error", "click"), F.col("event_id") - 7).when(kind == "view", F.col("event_id") + 1_000_000_000)
    calls = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", parent.alias("parent"))
    return nested_calls(calls, F.col("ts") >= "2024-01-05", key="event_id", parent="parent", name="event_type", wrapper="purchase", nestable=kind == "view")


def residuals(intervals: DataFrame, keys: Sequence[str], *, points: str, local: str, rate: float, least: float = 3.0) -> DataFrame:
    """For each key what its allowance points stand for beyond what was seen locally, or a reason.

    Signed differences are summed before they are judged: noise within an interval makes no usage."""
    sums = intervals.groupBy(*keys).agg(aggregates.exact_sum(points).alias("points"), aggregates.exact_sum(local).alias("local"))
    total = F.col("points") * rate
    reason = F.when(F.col("points").isNull() | (F.col("points") < least), "too_few_points").when(F.col("local") > total, "local_exceeds_total")
    return sums.withColumn("reason", reason).withColumn("unobserved", F.when(F.col("reason").isNull(), total - F.coalesce("local", F.lit(0.0))))


@query("""WITH s AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,6))) AS DOUBLE) AS points, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,6))) AS DOUBLE) AS local FROM lineitem GROUP BY l_orderkey),
    r AS (SELECT *, CASE WHEN points < 20 THEN 'too_few_points' WHEN local > points * 1500.0::DOUBLE THEN 'local_exceeds_total' END AS reason FROM s)
    SELECT l_orderkey, points, local, reason, CASE WHEN reason IS NULL THEN points * 1500.0::DOUBLE - local END AS unobserved FROM r""")
def residual_estimate(spark, sf_dir):
    return residuals(table(spark, sf_dir, "lineitem"), ["l_orderkey"], points="l_quantity", local="l_extendedprice", rate=1500.0, least=20.0)


def comparable_series(calls: DataFrame, keys: Sequence[str], order: Sequence[str], *, basis: str, model: str, value: str) -> DataFrame:
    """Stretches of calls of a key with one basis and one model: calls, first and last value. A call
    without a basis belongs to none and ends the one before it."""
    window = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(F.struct(basis, model)).over(window)
    same = F.col(basis).isNotNull() & before[basis].eqNullSafe(F.col(basis)) & before[model].eqNullSafe(F.col(model))
    cut = sequences.islands(calls, keys, order, ~same, "_series").where(F.col(basis).isNotNull())
    place = F.struct(*order)
    return cut.groupBy(*keys, "_series", basis, model).agg(F.count("*").alias("calls"), F.min_by(value, place).alias("first_value"), F.max_by(value, place).alias("last_value"), F.min(order[0]).alias("since")).drop("_series")


@query("""WITH b AS (SELECT *, CASE WHEN event_type <> 'error' THEN 'input' END AS basis, CASE WHEN event_type IN ('view', 'click') THEN 'a' ELSE 'b' END AS model FROM events),
    f AS (SELECT *, CASE WHEN basis IS NOT NULL AND basis = lag(basis) OVER w AND model = lag(model) OVER w THEN 0 ELSE 1 END AS cut FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS series FROM f)
    SELECT user_id, basis, model, count(*) AS calls, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value, min(ts) AS since FROM g WHERE basis IS NOT NULL GROUP BY user_id, series, basis, model""")
def comparable_calls(spark, sf_dir):
    kind = F.col("event_type")
    calls = table(spark, sf_dir, "events").withColumn("basis", F.when(kind != "error", "input")).withColumn("model", F.when(kind.isin("view", "click"), "a").otherwise("b"))
    return comparable_series(calls, ["user_id"], ["ts", "event_id"], basis="basis", model="model", value="value")


def project_states(rows: DataFrame, memberships: DataFrame, projects: DataFrame, reports: DataFrame) -> DataFrame:
    """rows (install, session, basis, directory, ...) with project_id, state and reason.

    memberships (install, kind, member, resolution, project) place sessions and directories; a session's
    own comes first, a directory's counts where the basis is working_directory. projects (install,
    project, project_id) names those that were reported, reports (install) the installs that report at
    all. Each of the three has one row a key; nothing is broadcast by hand."""
    of = lambda kind, member, prefix: memberships.where(F.col("kind") == kind).select("install", F.col("member").alias(member), F.struct("resolution", "project").alias(prefix))
    placed = rows.join(of("session", "session", "_s"), ["install", "session"], "left").join(of("working_directory", "directory", "_d"), ["install", "directory"], "left")
    found = F.coalesce("_s", F.when(F.col("basis") == "working_directory", F.col("_d")))
    placed = placed.withColumn("_m", found).withColumn("resolution", F.col("_m.resolution")).withColumn("project", F.col("_m.project"))
    named = placed.join(projects.select("install", "project", "project_id"), ["install", "project"], "left").join(reports.select("install", F.lit(True).alias("_reports")), "install", "left")
    reason = (
        F.when(F.col("basis") == "none", "no_project")
        .when(F.col("resolution").isNull(), F.when(F.col("_reports"), "unknown").otherwise("not_reported"))
        .when(F.col("resolution") == "projectless", "projectless")
        .when(F.col("project_id").isNotNull(), "project")
        .when(F.col("resolution").isin("outside_roots", "no_folder"), F.col("resolution"))
        .otherwise("missing_project")
    )
    state = F.when(F.col("reason") == "projectless", "no_project").when(F.col("reason").isin("outside_roots", "no_folder", "missing_project"), "unassigned").otherwise(F.col("reason"))
    told = named.withColumn("reason", reason).withColumn("state", state).withColumn("project_id", F.when(F.col("state") == "project", F.col("project_id")))
    return told.drop("_s", "_d", "_m", "_reports", "resolution", "project")


@query("""WITH r AS (SELECT o_orderkey, c_nationkey AS install, o_custkey AS session, o_orderpriority AS directory, CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE 'working_directory' END AS basis
        FROM orders JOIN customer ON c_custkey = o_custkey),
    s AS (SELECT c_nationkey AS install, c_custkey AS session, CASE WHEN c_acctbal < 0 THEN 'projectless' ELSE 'project' END AS resolution, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS project
        FROM customer WHERE c_acctbal < 0 OR c_acctbal > 5000),
    d AS (SELECT n_nationkey AS install, '1-URGENT' AS directory, 'outside_roots' AS resolution, CAST(NULL AS VARCHAR) AS project FROM nation),
    p AS (SELECT DISTINCT c_nationkey AS install, c_mktsegment AS project, c_mktsegment || '@' || c_nationkey AS project_id FROM customer WHERE c_mktsegment <> 'BUILDING'),
    m AS (SELECT r.*, coalesce(s.resolution, CASE WHEN basis = 'working_directory' THEN d.resolution END) AS resolution, s.project AS project FROM r LEFT JOIN s USING (install, session) LEFT JOIN d USING (install, directory)),
    q AS (SELECT o_orderkey, project_id, CASE WHEN basis = 'none' THEN 'no_project' WHEN resolution IS NULL THEN CASE WHEN n_nationkey IS NOT NULL THEN 'unknown' ELSE 'not_reported' END
        WHEN resolution = 'projectless' THEN 'projectless' WHEN project_id IS NOT NULL THEN 'project' WHEN resolution IN ('outside_roots', 'no_folder') THEN resolution ELSE 'missing_project' END AS reason
        FROM m LEFT JOIN p USING (install, project) LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) ON n_nationkey = m.install)
    SELECT o_orderkey, CASE WHEN reason = 'project' THEN project_id END AS project_id, reason,
        CASE WHEN reason = 'projectless' THEN 'no_project' WHEN reason IN ('outside_roots', 'no_folder', 'missing_project') THEN 'unassigned' ELSE reason END AS state FROM q""")
def project_resolution(spark, sf_dir):
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    balance, segment, install = F.col("c_acctbal"), F.col("c_mktsegment"), F.col("c_nationkey").cast("bigint").alias("install")
    basis = F.when(F.col("o_orderstatus") == "F", "none").otherwise("working_directory")
    orders = table(spark, sf_dir, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey"))
    rows = orders.select("o_orderkey", install, F.col("o_custkey").cast("string").alias("session"), basis.alias("basis"), F.col("o_orderpriority").alias("directory"))
    own = customers.where((balance < 0) | (balance > 5000)).select(
        install, F.lit("session").alias("kind"), F.col("c_custkey").cast("string").alias("member"), F.when(balance < 0, "projectless").otherwise("project").alias("resolution"), F.when(balance >= 0, segment).alias("project")
    )
    nation = F.col("n_nationkey").cast("bigint").alias("install")
    folders = nations.select(nation, F.lit("working_directory").alias("kind"), F.lit("1-URGENT").alias("member"), F.lit("outside_roots").alias("resolution"), F.lit(None).cast("string").alias("project"))
    projects = customers.where(segment != "BUILDING").select(install, segment.alias("project"), F.concat_ws("@", segment, F.col("c_nationkey")).alias("project_id")).distinct()
    return project_states(rows, own.unionByName(folders), projects, nations.where("n_regionkey < 3").select(nation)).select("o_orderkey", "project_id", "reason", "state")


def callers(calls: DataFrame, agents: DataFrame, requests: DataFrame) -> DataFrame:
    """Calls (caller, request) counted by who made them: state, who and calls.

    group: the caller's group, or else its request's; label: a caller known by label alone;
    outside_range: a caller that isn't known; none: no caller. agents (caller, group_id, label) and
    requests (request, request_group) have one row a key. Calls are counted before they are joined."""
    counted = calls.groupBy("caller", "request").agg(F.count("*").alias("calls"))
    known = counted.join(agents.select("caller", "group_id", "label"), "caller", "left").join(requests.select("request", "request_group"), "request", "left")
    group = F.coalesce("group_id", "request_group")
    state = F.when(group.isNotNull(), "group").when(F.col("caller").isNull(), "none").when(F.col("label").isNotNull(), "label").otherwise("outside_range")
    return known.withColumn("state", state).withColumn("who", F.when(F.col("state") == "group", group).when(F.col("state") == "label", F.col("label"))).groupBy("state", "who").agg(F.sum("calls").alias("calls"))


@query("""WITH j AS (SELECT CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS own, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END AS asked, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS caller,
        CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN c_mktsegment || ' (label)' END AS label
        FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON c_custkey = CASE WHEN o_orderstatus <> 'P' THEN o_custkey END),
    s AS (SELECT *, CASE WHEN coalesce(own, asked) IS NOT NULL THEN 'group' WHEN caller IS NULL THEN 'none' WHEN label IS NOT NULL THEN 'label' ELSE 'outside_range' END AS state FROM j)
    SELECT state, CASE state WHEN 'group' THEN coalesce(own, asked) WHEN 'label' THEN label END AS who, count(*) AS calls FROM s GROUP BY ALL""")
def caller_resolution(spark, sf_dir):
    balance, segment = F.col("c_acctbal"), F.col("c_mktsegment")
    calls = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("caller"), F.col("o_orderpriority").alias("request"))
    label = F.when(balance <= 5000, F.concat(segment, F.lit(" (label)")))
    agents = table(spark, sf_dir, "customer").where(balance >= 0).select(F.col("c_custkey").alias("caller"), F.when(balance > 5000, segment).alias("group_id"), label.alias("label"))
    requests = calls.select("request").distinct().withColumn("request_group", F.when(F.col("request") == "1-URGENT", "urgent"))
    return callers(calls, agents, requests)
