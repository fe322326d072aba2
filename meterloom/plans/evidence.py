"""Records judged before they count, side records, two ledgers of the same facts, accesses and coverage."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.operators.canonical import top_n, winner
from meterloom.operators.components import checkpointed
from meterloom.operators.trees import solved
from meterloom.plans.registry import query, table


def accounting_fault(parts: Sequence[Column], reasoning: Column, reported: Column, unclassified: Column, state: Column) -> Column:
    """What is wrong with a record's token accounting; null where its state says what its numbers do.

    complete: all parts known; partial: some evidence, not all; inconsistent: known tokens above the reported
    total; unknown: no evidence. What the parts leave of a reported total has to be told as unclassified."""
    zero = F.lit(0)
    known = sum((F.coalesce(p, zero) for p in parts), zero)
    held = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    every, none = held == len(parts), (held == 0) & reasoning.isNull()
    least = sum((F.coalesce(p, zero) for p in parts[:-1]), zero) + F.coalesce(parts[-1], reasoning, zero)
    exceeds = F.coalesce(least > reported, F.lit(False))
    rest = F.when(reported.isNull(), unclassified.isNotNull()).otherwise(~unclassified.eqNullSafe(reported - known))
    complete = F.when(~every, "complete_without_all_parts").when(exceeds, "exceeds_reported").when(rest, "unclassified_is_not_the_rest")
    partial = F.when(every | (none & reported.isNull()), "partial_without_gap").when(exceeds, "exceeds_reported").when(rest, "unclassified_is_not_the_rest")
    inconsistent = F.when(~exceeds, "inconsistent_without_excess").when(unclassified.isNotNull(), "inconsistent_with_rest")
    unknown = F.when(~none | reported.isNotNull() | unclassified.isNotNull(), "unknown_with_evidence")
    return F.when(state == "complete", complete).when(state == "partial", partial).when(state == "inconsistent", inconsistent).otherwise(unknown)


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 2 THEN l_partkey END AS a, CASE WHEN l_linenumber <> 3 THEN l_suppkey END AS b, CASE WHEN l_linenumber < 6 THEN l_orderkey % 50 END AS c, CASE WHEN l_linenumber < 5 THEN l_orderkey % 70 END AS d, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey % 30 END AS re,
        CASE l_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN l_partkey + l_suppkey + 200 ELSE 5 END AS rep, CASE l_orderkey % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN 'inconsistent' ELSE 'unknown' END AS state FROM lineitem),
    k AS (SELECT *, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0) AS known, a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL AS every_, a IS NULL AND b IS NULL AND c IS NULL AND d IS NULL AND re IS NULL AS none_, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, re, 0) AS least_ FROM r),
    u AS (SELECT *, CASE WHEN l_orderkey % 5 < 3 THEN rep - known END AS un, coalesce(least_ > rep, false) AS ex FROM k), t AS (SELECT *, CASE WHEN rep IS NULL THEN un IS NOT NULL ELSE un IS DISTINCT FROM rep - known END AS bad FROM u)
    SELECT l_orderkey, l_linenumber, CASE state WHEN 'complete' THEN CASE WHEN NOT every_ THEN 'complete_without_all_parts' WHEN ex THEN 'exceeds_reported' WHEN bad THEN 'unclassified_is_not_the_rest' END
        WHEN 'partial' THEN CASE WHEN every_ OR (none_ AND rep IS NULL) THEN 'partial_without_gap' WHEN ex THEN 'exceeds_reported' WHEN bad THEN 'unclassified_is_not_the_rest' END
        WHEN 'inconsistent' THEN CASE WHEN NOT ex THEN 'inconsistent_without_excess' WHEN un IS NOT NULL THEN 'inconsistent_with_rest' END ELSE CASE WHEN NOT none_ OR rep IS NOT NULL OR un IS NOT NULL THEN 'unknown_with_evidence' END END AS fault FROM t""")
def token_accounting(spark, sf_dir):
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    parts = [F.when(line != 2, F.col("l_partkey")), F.when(line != 3, F.col("l_suppkey")), F.when(line < 6, order % 50), F.when(line < 5, order % 70)]
    reported = F.when(order % 3 == 1, F.col("l_partkey") + F.col("l_suppkey") + 200).when(order % 3 == 2, 5)
    known = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in parts])
    state = F.when(order % 4 == 0, "complete").when(order % 4 == 1, "partial").when(order % 4 == 2, "inconsistent").otherwise("unknown")
    fault = accounting_fault(parts, F.when(line != 7, order % 30), reported, F.when(order % 5 < 3, reported - known), state)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fault.alias("fault"))


def rejection(record: dict[str, Column], binding: dict[str, Column]) -> Column:
    """The first reason for which a record is refused; null for one that counts."""
    browser = binding["install_kind"] == "browser"
    return (
        F.when(binding["id"].isNull(), "binding_not_owned")
        .when(~binding["enabled"], "binding_not_enabled")
        .when(binding["identity_hash"].isNull() & binding["identity_reset_at"].isNotNull(), "identity_changed")
        .when((record["adapter_kind"] == "browser") != browser, "adapter_not_allowed_for_install")
        .when(browser & (record["type"] != "allowance.reading"), "record_type_not_allowed_for_install")
        .when(record["provider"] != binding["provider"], "adapter_provider_mismatch")
    )


@query("""WITH b AS (SELECT c_custkey AS id, c_acctbal > 0 AS enabled, CASE WHEN c_custkey % 3 > 0 THEN 'h' END AS ih, CASE WHEN c_custkey % 2 = 0 THEN 'r' END AS ir, CASE WHEN c_nationkey % 4 = 0 THEN 'browser' ELSE 'local' END AS kind, 'p' || c_nationkey % 3 AS provider FROM customer WHERE c_custkey % 7 > 0)
    SELECT o_orderkey, CASE WHEN b.id IS NULL THEN 'binding_not_owned' WHEN NOT enabled THEN 'binding_not_enabled' WHEN ih IS NULL AND ir IS NOT NULL THEN 'identity_changed' WHEN (o_orderkey % 5 = 0) <> (kind = 'browser') THEN 'adapter_not_allowed_for_install'
        WHEN kind = 'browser' AND o_orderpriority <> '1-URGENT' THEN 'record_type_not_allowed_for_install' WHEN 'p' || o_orderkey % 3 <> b.provider THEN 'adapter_provider_mismatch' END AS reason FROM orders LEFT JOIN b ON b.id = o_custkey""")
def record_rejections(spark, sf_dir):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    bindings = table(spark, sf_dir, "customer").where("c_custkey % 7 > 0").select(key.alias("id"), (F.col("c_acctbal") > 0).alias("enabled"), F.when(key % 3 > 0, "h").alias("identity_hash"), F.when(key % 2 == 0, "r").alias("identity_reset_at"), F.when(nation % 4 == 0, "browser").otherwise("local").alias("install_kind"), F.concat(F.lit("p"), nation % 3).alias("provider"))
    order = F.col("o_orderkey")
    record = {"adapter_kind": F.when(order % 5 == 0, "browser").otherwise("local"), "type": F.when(F.col("o_orderpriority") == "1-URGENT", "allowance.reading").otherwise("activity.request"), "provider": F.concat(F.lit("p"), order % 3)}
    joined = table(spark, sf_dir, "orders").join(bindings, F.col("o_custkey") == F.col("id"), "left")
    return joined.select("o_orderkey", rejection(record, {c: F.col(c) for c in bindings.columns}).alias("reason"))


@query("""WITH r AS (SELECT event_id, ts, ts + to_minutes(event_id % 20000) AS reset, CASE WHEN event_id % 3 > 0 THEN 300 * (event_id % 3) END AS minutes FROM events) SELECT event_id, reset <= ts + to_minutes(coalesce(minutes, 129600)) + INTERVAL 1 DAY AS plausible FROM r""")
def plausible_resets(spark, sf_dir):
    """A window resets within its own length and a day; anything later is a bad clock."""
    at, minutes = F.col("ts"), F.when(F.col("event_id") % 3 > 0, F.lit(300) * (F.col("event_id") % 3))
    later = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))
    limit = at + later(F.coalesce(minutes, F.lit(129_600))) + F.expr("INTERVAL 1 DAY")
    return table(spark, sf_dir, "events").select("event_id", (at + later(F.col("event_id") % 20_000) <= limit).alias("plausible"))


def side_winners(records: DataFrame, keys: Sequence[str], time: str, text: str) -> DataFrame:
    """The newest record of each key; of equal times the one with the smaller text."""
    kept = [c for c in records.columns if c not in keys]
    order = F.struct((-F.unix_micros(F.col(time).cast("timestamp"))).alias("t"), F.coalesce(text, F.lit("")).alias("x"))
    return records.where(F.col(time).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*kept), order).alias("w")).select(*keys, "w.*")


def forward_upsert(held: DataFrame, arrived: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """What a table holds after `arrived` (a row a key): never an older row, and `written` only where something
    changed. Both sides are stacked and grouped."""
    content = [c for c in held.columns if c not in keys]
    of = lambda side: F.max(F.when(F.col("_side") == side, F.struct(*content))).alias(side)
    both = held.withColumn("_side", F.lit("h")).unionByName(arrived.select(held.columns).withColumn("_side", F.lit("a"))).groupBy(*keys).agg(of("h"), of("a"))
    takes = F.col("a").isNotNull() & (F.col("h").isNull() | (F.col(f"a.{time}") >= F.col(f"h.{time}")))
    written = takes & ~F.col("a").eqNullSafe(F.col("h"))
    return both.select(*keys, F.when(takes, F.col("a")).otherwise(F.col("h")).alias("n"), written.alias("written")).select(*keys, "n.*", "written")


@query("""WITH s AS (SELECT user_id, event_type AS kind, date_trunc('day', ts)::TIMESTAMP AS seen, 'l' || event_id % 4 AS label FROM events), w AS (SELECT * FROM s WHERE seen >= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY seen DESC, label) = 1),
    h AS (SELECT * FROM s WHERE seen < TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY seen DESC, label) = 1)
    SELECT user_id, kind, CASE WHEN w.seen IS NOT NULL AND (h.seen IS NULL OR w.seen >= h.seen) THEN w.seen ELSE h.seen END AS seen, CASE WHEN w.seen IS NOT NULL AND (h.seen IS NULL OR w.seen >= h.seen) THEN w.label ELSE h.label END AS label,
        w.seen IS NOT NULL AND (h.seen IS NULL OR w.seen >= h.seen) AND (h.seen IS NULL OR w.seen <> h.seen OR w.label <> h.label) AS written FROM h FULL JOIN w USING (user_id, kind)""")
def label_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("seen"), F.concat(F.lit("l"), F.col("event_id") % 4).alias("label"))
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    of = lambda part: side_winners(part, ["user_id", "kind"], "seen", "label")
    return forward_upsert(of(rows.where(F.col("seen") < day("2024-01-20"))), of(rows.where(F.col("seen") >= day("2024-01-15"))), ["user_id", "kind"], "seen")


def append_verdicts(arrived: DataFrame, held: DataFrame, ids: Sequence[Sequence[str]], content: str) -> DataFrame:
    """arrived with a verdict: conflict where one of its keys (each of `ids`) is held, or comes in the same
    batch, with other content; duplicate where it is held with the same; else accepted. Nulls match nothing."""
    judged = arrived
    conflict, seen = F.lit(False), F.lit(False)
    for i, key in enumerate(ids):
        stacked = arrived.select(*key, content, F.lit(False).alias("_old")).unionByName(held.select(*key, content, F.lit(True).alias("_old")))
        facts = stacked.groupBy(*key).agg(F.count_distinct(content).alias(f"_n{i}"), F.bool_or("_old").alias(f"_o{i}"))
        judged = judged.join(facts, list(key), "left")
        conflict, seen = conflict | F.coalesce(F.col(f"_n{i}") > 1, F.lit(False)), seen | F.coalesce(F.col(f"_o{i}"), F.lit(False))
    return judged.withColumn("verdict", F.when(conflict, "conflict").when(seen, "duplicate").otherwise("accepted")).select(*arrived.columns, "verdict")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber % 5 AS event_id, l_orderkey % 400 AS task, l_orderkey // 400 * 10 + l_linenumber AS seq, l_returnflag AS content, l_partkey % 2 = 0 AS old FROM lineitem),
    e AS (SELECT event_id, count(DISTINCT content) AS n, bool_or(old) AS o FROM a GROUP BY 1), s AS (SELECT task, seq, count(DISTINCT content) AS n, bool_or(old) AS o FROM a GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, CASE WHEN e.n > 1 OR s.n > 1 THEN 'conflict' WHEN e.o OR s.o THEN 'duplicate' ELSE 'accepted' END AS verdict FROM a JOIN e USING (event_id) JOIN s USING (task, seq) WHERE NOT old""")
def routing_appends(spark, sf_dir):
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (order * 10 + line % 5).alias("event_id"), (order % 400).alias("task"), (F.floor(order / 400) * 10 + line).alias("seq"), F.col("l_returnflag").alias("content"), (F.col("l_partkey") % 2 == 0).alias("old"))
    return append_verdicts(rows.where("NOT old").drop("old"), rows.where("old").drop("old"), [["event_id"], ["task", "seq"]], "content").select("l_orderkey", "l_linenumber", "verdict")


@query("SELECT user_id AS task, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS place FROM events QUALIFY place <= 50")
def task_history(spark, sf_dir):
    """The first events of each task in sequence, no more than are shown."""
    return top_n(table(spark, sf_dir, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], 50, "place").select(F.col("user_id").alias("task"), "event_id", "place")


def ledger_matrix(revisions: DataFrame, keys: Sequence[str], groups: Sequence[str], *, mode: str, old: str, new: str, calls: str, tokens: str, order: Sequence[str], hour: Sequence[str]) -> DataFrame:
    """Two readers' revisions of the same buckets: for each group how many keys each holds alone or both share,
    which is larger, and what the canonical rows come to with and without the older reader."""
    is_old, is_new = F.col(mode) == old, F.col(mode) == new
    best = lambda when, c: F.max_by(c, F.when(when, F.struct(calls, tokens, *order)))
    keyed = revisions.groupBy(*keys).agg(
        F.bool_or(is_old).alias("has_old"), F.bool_or(is_new).alias("has_new"), *[F.max(F.when(w, F.col(c))).alias(f"{n}_{k}") for w, n in ((is_old, "old"), (is_new, "new")) for c, k in ((calls, "calls"), (tokens, "tokens"))],
        best(F.lit(True), calls).alias("c_calls"), best(F.lit(True), tokens).alias("c_tokens"), best(F.lit(True), mode).alias("c_mode"), best(is_new, calls).alias("n_calls"), best(is_new, tokens).alias("n_tokens"),
    )
    hours = keyed.where("has_new").select(*hour).distinct().withColumn("_hour", F.lit(True))
    rows = keyed.join(hours, list(hour), "left")
    o, n = F.struct("old_calls", "old_tokens"), F.struct("new_calls", "new_tokens")
    alone, both = F.col("has_old") & ~F.col("has_new"), F.col("has_old") & F.col("has_new")
    count = lambda when: F.count_if(F.coalesce(when, F.lit(False)))
    total = lambda c, when=F.lit(True): F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("double")
    return rows.groupBy(*groups).agg(
        count(alone).alias("old_only"), count(F.col("has_new") & ~F.col("has_old")).alias("new_only"), count(both).alias("shared"), count(both & (o == n)).alias("shared_equal"), count(both & (n > o)).alias("shared_new_larger"), count(both & (o > n)).alias("shared_old_larger"),
        count(alone & F.col("_hour")).alias("old_only_in_new_hours"), total("c_tokens").alias("canonical_tokens"), total("c_tokens", F.col("c_mode") == old).alias("canonical_tokens_from_old"), total("n_tokens").alias("tokens_without_old"), total("c_tokens", alone).alias("old_only_tokens"),
    )


@query("""WITH r AS (SELECT user_id, event_type AS model, date_trunc('hour', ts)::TIMESTAMP AS hour, CASE WHEN event_id % 3 = 0 THEN 'local' ELSE 'companion' END AS mode, event_id % 4 AS calls, event_id % 50 AS tokens, event_id FROM events),
    k AS (SELECT user_id, model, hour, bool_or(mode = 'local') AS v1, bool_or(mode = 'companion') AS v2, max(calls) FILTER (WHERE mode = 'local') AS c1, max(tokens) FILTER (WHERE mode = 'local') AS t1, max(calls) FILTER (WHERE mode = 'companion') AS c2, max(tokens) FILTER (WHERE mode = 'companion') AS t2 FROM r GROUP BY 1, 2, 3),
    c AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id, model, hour ORDER BY calls DESC, tokens DESC, event_id DESC) = 1), w AS (SELECT * FROM r WHERE mode = 'companion' QUALIFY row_number() OVER (PARTITION BY user_id, model, hour ORDER BY calls DESC, tokens DESC, event_id DESC) = 1), h AS (SELECT DISTINCT user_id, hour FROM k WHERE v2)
    SELECT k.user_id, k.model, count(*) FILTER (WHERE v1 AND NOT v2) AS old_only, count(*) FILTER (WHERE v2 AND NOT v1) AS new_only, count(*) FILTER (WHERE v1 AND v2) AS shared, count(*) FILTER (WHERE v1 AND v2 AND c1 = c2 AND t1 = t2) AS shared_equal, count(*) FILTER (WHERE v1 AND v2 AND (c2 > c1 OR (c2 = c1 AND t2 > t1))) AS shared_new_larger,
        count(*) FILTER (WHERE v1 AND v2 AND (c1 > c2 OR (c1 = c2 AND t1 > t2))) AS shared_old_larger, count(*) FILTER (WHERE v1 AND NOT v2 AND EXISTS (SELECT 1 FROM h WHERE h.user_id = k.user_id AND h.hour = k.hour)) AS old_only_in_new_hours, CAST(coalesce(sum(c.tokens), 0) AS DOUBLE) AS canonical_tokens,
        CAST(coalesce(sum(c.tokens) FILTER (WHERE c.mode = 'local'), 0) AS DOUBLE) AS canonical_tokens_from_old, CAST(coalesce(sum(w.tokens), 0) AS DOUBLE) AS tokens_without_old, CAST(coalesce(sum(c.tokens) FILTER (WHERE v1 AND NOT v2), 0) AS DOUBLE) AS old_only_tokens
    FROM k JOIN c USING (user_id, model, hour) LEFT JOIN w USING (user_id, model, hour) GROUP BY 1, 2""")
def two_readers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("model"), F.date_trunc("hour", "ts").alias("hour"), F.when(F.col("event_id") % 3 == 0, "local").otherwise("companion").alias("mode"), (F.col("event_id") % 4).alias("calls"), (F.col("event_id") % 50).alias("tokens"), "event_id")
    return ledger_matrix(rows, ["user_id", "model", "hour"], ["user_id", "model"], mode="mode", old="local", new="companion", calls="calls", tokens="tokens", order=["event_id"], hour=["user_id", "hour"])


@query("""WITH q AS (SELECT user_id, ts, value, event_id, event_id % 4 = 0 AS disabled FROM events WHERE event_id % 2 = 0), r AS (SELECT user_id, ts, value, event_id, user_id % 5 > 0 AS enabled FROM events WHERE event_id % 6 = 0 OR event_id % 2 = 1),
    o AS (SELECT user_id, 'samples' AS origin, disabled AS history_only, EXISTS (SELECT 1 FROM r WHERE r.user_id = q.user_id AND r.ts = q.ts AND r.value = q.value AND (q.disabled OR r.enabled)) AS duplicate, ts FROM q UNION ALL SELECT user_id, 'readings', NOT enabled, false, ts FROM r)
    SELECT user_id, origin, count(*) AS n_rows, count(*) FILTER (WHERE history_only) AS history_only_rows, count(*) FILTER (WHERE duplicate) AS cross_ledger_duplicates, count(*) FILTER (WHERE NOT history_only) AS visible_before, count(*) FILTER (WHERE NOT duplicate) AS visible_after, min(ts) AS first_observed, max(ts) AS last_observed FROM o GROUP BY 1, 2""")
def allowance_ledgers(spark, sf_dir):
    """Samples of the older ledger that the newer one holds as well, and what of both is seen."""
    events = table(spark, sf_dir, "events")
    samples = events.where("event_id % 2 = 0").select("user_id", "ts", "value", (F.col("event_id") % 4 == 0).alias("history_only"))
    readings = events.where("event_id % 6 = 0 OR event_id % 2 = 1").select("user_id", "ts", "value", (F.col("user_id") % 5 > 0).alias("enabled"))
    facts = readings.groupBy("user_id", "ts", "value").agg(F.bool_or("enabled").alias("any_enabled"))
    twice = F.coalesce(F.col("history_only") | F.col("any_enabled"), F.lit(False)) & F.col("any_enabled").isNotNull()
    old = samples.join(facts, ["user_id", "ts", "value"], "left").select("user_id", F.lit("samples").alias("origin"), "history_only", twice.alias("duplicate"), "ts")
    both = old.unionByName(readings.select("user_id", F.lit("readings").alias("origin"), (~F.col("enabled")).alias("history_only"), F.lit(False).alias("duplicate"), "ts"))
    return both.groupBy("user_id", "origin").agg(
        F.count("*").alias("n_rows"), F.count_if("history_only").alias("history_only_rows"), F.count_if("duplicate").alias("cross_ledger_duplicates"), F.count_if(~F.col("history_only")).alias("visible_before"), F.count_if(~F.col("duplicate")).alias("visible_after"), F.min("ts").alias("first_observed"), F.max("ts").alias("last_observed")
    )


def identified(rows: DataFrame, identities: DataFrame, kinds: dict[str, Sequence[str]]) -> DataFrame:
    """rows (basis, evidence and key columns) with identity_id. Each kind of identity has keys of its own: a join
    by equality for each, in place of one with an OR that no plan can hash."""
    found = None
    for kind, keys in kinds.items():
        own = identities.where(F.col("basis") == kind).select(*keys, F.col("identity_id"))
        one = rows.where(F.col("basis") == kind).join(own, list(keys), "left")
        found = one if found is None else found.unionByName(one)
    others = rows.where(~F.coalesce(F.col("basis").isin(*kinds), F.lit(False))).withColumn("identity_id", F.lit(None).cast(identities.schema["identity_id"].dataType))
    return found.unionByName(others)


@query("""WITH r AS (SELECT o_orderkey, o_custkey % 10 AS install, 'a' || o_custkey % 4 AS account, 'e' || (o_custkey + o_orderkey % 3) AS evidence, CASE o_orderstatus WHEN 'F' THEN 'working_directory' WHEN 'O' THEN 'native' ELSE 'none' END AS basis FROM orders),
    i AS (SELECT c_custkey AS identity_id, c_custkey % 10 AS install, 'a' || c_custkey % 4 AS account, 'e' || c_custkey AS evidence, CASE WHEN c_custkey % 2 = 0 THEN 'working_directory' ELSE 'native' END AS basis FROM customer)
    SELECT o_orderkey, identity_id FROM r LEFT JOIN i ON (r.basis = 'working_directory' AND i.basis = r.basis AND i.install = r.install AND i.evidence = r.evidence) OR (r.basis = 'native' AND i.basis = r.basis AND i.account = r.account AND i.evidence = r.evidence)""")
def evidence_identity(spark, sf_dir):
    shape = lambda key: [(F.col(key) % 10).alias("install"), F.concat(F.lit("a"), F.col(key) % 4).alias("account")]
    basis = F.when(F.col("o_orderstatus") == "F", "working_directory").when(F.col("o_orderstatus") == "O", "native").otherwise("none")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *shape("o_custkey"), F.concat(F.lit("e"), F.col("o_custkey") + F.col("o_orderkey") % 3).alias("evidence"), basis.alias("basis"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("identity_id"), *shape("c_custkey"), F.concat(F.lit("e"), F.col("c_custkey")).alias("evidence"), F.when(F.col("c_custkey") % 2 == 0, "working_directory").otherwise("native").alias("basis"))
    return identified(rows, known, {"working_directory": ["install", "evidence"], "native": ["account", "evidence"]}).select("o_orderkey", "identity_id")


@query("""WITH a AS (SELECT user_id, event_id % 300 AS semantic, event_id, ts, 'r' || event_id % 307 AS resource, event_id % 4 AS version, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'search' WHEN 'error' THEN 'unknown' ELSE 'write' END AS kind FROM events),
    c AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id, semantic ORDER BY ts DESC, event_id DESC) = 1), i AS (SELECT 'r' || s_suppkey AS resource, s_suppkey AS identity, CASE WHEN s_suppkey % 2 = 0 THEN 2 END AS version, CASE WHEN s_suppkey % 3 > 0 THEN 'src' || s_suppkey % 3 END AS source FROM supplier),
    k AS (SELECT c.*, i.identity, source, c.version IS NOT DISTINCT FROM i.version AS cur, CASE WHEN i.identity IS NULL THEN 'unknown' WHEN source IS NULL THEN 'unassigned' ELSE 'source' END AS state FROM c LEFT JOIN i USING (resource))
    SELECT state, source, CASE WHEN source IS NULL THEN identity END AS identity, count(*) FILTER (WHERE cur) AS accesses, count(*) FILTER (WHERE NOT cur) AS earlier_accesses, count(DISTINCT semantic) FILTER (WHERE cur) AS invocations, count(DISTINCT user_id) FILTER (WHERE cur) AS sessions,
        count(*) FILTER (WHERE cur AND kind = 'read') AS kind_read, count(*) FILTER (WHERE cur AND kind = 'search') AS kind_search, count(*) FILTER (WHERE cur AND kind = 'write') AS kind_write, count(*) FILTER (WHERE cur AND kind = 'unknown') AS kind_unknown FROM k GROUP BY 1, 2, 3""")
def knowledge_access(spark, sf_dir):
    """Canonical accesses by source: those made under the current configuration, and earlier ones apart."""
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 300).alias("semantic"), "event_id", "ts", F.concat(F.lit("r"), F.col("event_id") % 307).alias("resource"), (F.col("event_id") % 4).alias("version"), F.when(kind == "view", "read").when(kind == "click", "search").when(kind == "error", "unknown").otherwise("write").alias("kind"))
    held = winner(rows, ["user_id", "semantic"], ["ts", "event_id"])
    key = F.col("s_suppkey")
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), key).alias("resource"), key.alias("identity"), F.when(key % 2 == 0, F.lit(2).cast("bigint")).alias("current"), F.when(key % 3 > 0, F.concat(F.lit("src"), key % 3)).alias("source"))
    told = held.join(known, "resource", "left").withColumns({"now": F.col("version").eqNullSafe(F.col("current")), "state": F.when(F.col("identity").isNull(), "unknown").when(F.col("source").isNull(), "unassigned").otherwise("source"), "identity": F.when(F.col("source").isNull(), F.col("identity"))})
    now = F.col("now")
    return told.groupBy("state", "source", "identity").agg(
        F.count_if(now).alias("accesses"), F.count_if(~now).alias("earlier_accesses"), F.count_distinct(F.when(now, F.col("semantic"))).alias("invocations"), F.count_distinct(F.when(now, F.col("user_id"))).alias("sessions"), *[F.count_if(now & (F.col("kind") == k)).alias(f"kind_{k}") for k in ("read", "search", "write", "unknown")]
    )


def folded_path(path: Column) -> Column:
    """A place in a document with array indexes folded: items[3].name reads items[].name."""
    return F.when(path == "", "(body)").otherwise(F.regexp_replace(path, r"\[\d+\]", "[]"))


def issue_histogram(issues: DataFrame, keys: Sequence[str], revision: str, path: str, message: str, top: int = 5) -> DataFrame:
    """The issues that most revisions have, each counted once a revision however often it stands in it."""
    counted = issues.select(*keys, revision, folded_path(F.col(path)).alias("path"), F.col(message).alias("message")).distinct().groupBy(*keys, "path", "message").agg(F.count("*").alias("revisions"))
    return top_n(counted, keys, [F.desc("revisions"), F.asc("path"), F.asc("message")], top, "place")


@query("""WITH i AS (SELECT DISTINCT l_returnflag AS kind, l_orderkey AS rev, CASE WHEN l_linenumber = 1 THEN '(body)' ELSE 'items[].f' || l_linenumber % 4 END AS path, 'm' || l_suppkey % 3 AS message FROM lineitem), c AS (SELECT kind, path, message, count(*) AS revisions FROM i GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY revisions DESC, path, message) AS INTEGER) AS place FROM c QUALIFY place <= 5""")
def contract_issues(spark, sf_dir):
    path = F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lit("items["), F.col("l_partkey"), F.lit("].f"), F.col("l_linenumber") % 4))
    issues = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("rev"), path.alias("path"), F.concat(F.lit("m"), F.col("l_suppkey") % 3).alias("message"))
    return issue_histogram(issues, ["kind"], "rev", "path", "message")


@query("""WITH c AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'view') AS a, min(ts) FILTER (WHERE event_type = 'click') AS b, max(ts) FILTER (WHERE event_type = 'error') AS c, max(ts) FILTER (WHERE event_type = 'purchase') AS d FROM events GROUP BY user_id)
    SELECT user_id, least(a, b) AS observed_from, greatest(c, d) AS scanned_through FROM c""")
def coverage_bounds(spark, sf_dir):
    """From when anything was seen by either reader, and until when either has looked; one alone is enough."""
    of = lambda f, kind: f(F.when(F.col("event_type") == kind, F.col("ts")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.least(of(F.min, "view"), of(F.min, "click")).alias("observed_from"), F.greatest(of(F.max, "error"), of(F.max, "purchase")).alias("scanned_through"))


@query("""WITH b AS (SELECT user_id, min(ts) AS f, max(ts) FILTER (WHERE event_type <> 'view') AS t FROM events GROUP BY user_id), d AS (SELECT user_id, CAST(unnest(range(DATE '2023-12-30', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT user_id FROM events)),
    n AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL)
    SELECT d.user_id, d.day, coalesce(n, 0) AS n, CASE WHEN CAST(d.day AS TIMESTAMP) + INTERVAL 1 DAY > TIMESTAMP '2024-01-30 12:00:00' THEN 'partial' WHEN n > 0 THEN 'observed' WHEN CAST(d.day AS TIMESTAMP) + INTERVAL 1 DAY <= t AND CAST(d.day AS TIMESTAMP) >= f THEN 'zero' ELSE 'missing' END AS state
    FROM d JOIN b USING (user_id) LEFT JOIN n USING (user_id, day)""")
def covered_days(spark, sf_dir):
    """A day without rows is a zero only where a reader was there before and has looked past it."""
    events = table(spark, sf_dir, "events")
    bounds = events.groupBy("user_id").agg(F.min("ts").alias("f"), F.max(F.when(F.col("event_type") != "view", F.col("ts"))).alias("t"))
    counted = events.where("event_type = 'click'").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    days = bounds.select("user_id", "f", "t", F.explode(F.sequence(F.lit("2023-12-30").cast("date"), F.lit("2024-02-02").cast("date"))).alias("day"))
    start, end = F.col("day").cast("timestamp_ntz"), F.date_add("day", 1).cast("timestamp_ntz")
    state = F.when(end > F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), "partial").when(F.col("n") > 0, "observed").when((end <= F.col("t")) & (start >= F.col("f")), "zero").otherwise("missing")
    return days.join(counted, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


@query("""(SELECT 'open' AS part, o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30) UNION ALL (SELECT 'closed', o_orderkey FROM orders WHERE o_orderstatus <> 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)""")
def bracketed_union(spark, sf_dir):
    """Each side in its own order to its own limit."""
    orders = table(spark, sf_dir, "orders")
    first = orders.where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(30).select(F.lit("open").alias("part"), "o_orderkey")
    return first.unionByName(orders.where("o_orderstatus <> 'O'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select(F.lit("closed").alias("part"), "o_orderkey"))


@query("""WITH n AS (SELECT l_suppkey, l_partkey, count(DISTINCT l_orderkey) AS orders, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY orders DESC, quantity DESC, l_partkey) AS place FROM n)
    SELECT l_suppkey, '[' || string_agg('{"part":' || l_partkey || ',"orders":' || orders || '}', ',' ORDER BY place) || ']' AS top FROM r WHERE place <= 5 GROUP BY l_suppkey""")
def ranked_objects(spark, sf_dir):
    """The five most asked for of each group, ranked by a distinct count, as one list of objects."""
    counted = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count_distinct("l_orderkey").alias("orders"), F.sum("l_quantity").cast("bigint").alias("quantity"))
    few = top_n(counted, ["l_suppkey"], [F.desc("orders"), F.desc("quantity"), F.asc("l_partkey")], 5, "place")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(F.col("l_partkey").alias("part"), "orders").alias("o")))), lambda x: x["o"])
    return few.groupBy("l_suppkey").agg(F.to_json(listed).alias("top"))


def prorated(intervals: DataFrame, steps: DataFrame, keys: Sequence[str], *, start: str, end: str, from_: str, until: str, amount: str) -> DataFrame:
    """overlaps() of intervals with fixed steps, each with its share of the interval's amount by seconds."""
    from meterloom.operators.joins import overlaps

    both = overlaps(intervals, steps, keys, start=start, end=end, from_=from_, until=until, step=86_400)
    return both.withColumn("share", F.col(amount) * F.col("seconds") / (F.col(end) - F.col(start)))


@query("""WITH i AS (SELECT o_orderkey, o_custkey % 5 AS k, epoch_us(o_orderdate) // 1000000 AS a, epoch_us(o_orderdate) // 1000000 + 3600 * (1 + o_orderkey % 60) AS b, o_totalprice AS amount FROM orders), d AS (SELECT DISTINCT k, unnest(range(a // 86400, (b - 1) // 86400 + 1)) * 86400 AS f FROM i)
    SELECT o_orderkey, make_timestamp(f * 1000000) AS day, amount * (least(b, f + 86400) - greatest(a, f)) / (b - a) AS share FROM i JOIN d ON d.k = i.k AND f < b AND f + 86400 > a""")
def interval_shares(spark, sf_dir):
    """Amounts of intervals over the days that they touch."""
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("k"), seconds.alias("a"), (seconds + 3600 * (1 + F.col("o_orderkey") % 60)).alias("b"), F.col("o_totalprice").alias("amount"))
    days = rows.select("k", F.explode(F.sequence(F.floor(F.col("a") / 86_400), F.floor((F.col("b") - 1) / 86_400))).alias("d")).distinct().select("k", (F.col("d") * 86_400).alias("f"), ((F.col("d") + 1) * 86_400).alias("u"))
    found = prorated(rows, days, ["k"], start="a", end="b", from_="f", until="u", amount="amount")
    return found.select("o_orderkey", F.timestamp_seconds("f").cast("timestamp_ntz").alias("day"), "share")


def depths(tree: DataFrame, *, node: str, parent: str, keys: Sequence[str] = (), cut: Callable[[DataFrame, str], DataFrame] = checkpointed) -> DataFrame:
    """tree, a row a node, with depth (0 at a root or where the parent is not in the tree) and root, and null for both within
    a circle and on what hangs on one. No row of one task ever holds a path."""
    keys = list(keys)
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    kind, others = tree.schema[node].dataType, [c for c in tree.columns if c not in (*keys, node)]
    above = F.when(whole, F.col(parent).try_cast(kind)).alias("p")
    held = tree.where(F.col(node).isNotNull()).select(*keys, F.col(node).alias("n"), above, F.lit(0).cast("bigint").alias("w"), F.struct(*others).alias("row"))
    closed, left = solved(held, keys, cut)
    told = [F.col("n").alias(c) if c == node else F.col(c if c in keys else f"row.{c}").alias(c) for c in tree.columns]
    found = closed.select(*told, "depth", "root")
    if left is None:
        return found
    return found.unionByName(left.select(*told, F.lit(None).cast("bigint").alias("depth"), F.lit(None).cast(kind).alias("root")))


@query("""WITH RECURSIVE t AS (SELECT DISTINCT l_orderkey AS n, CASE WHEN l_orderkey % 9 = 0 THEN NULL WHEN l_orderkey % 50 = 7 THEN l_orderkey + 1 ELSE l_orderkey - 1 - l_orderkey % 3 END AS p FROM (SELECT DISTINCT l_orderkey FROM lineitem)), e AS (SELECT t.n, CASE WHEN x.n IS NOT NULL THEN t.p END AS p FROM t LEFT JOIN t x ON x.n = t.p),
    r AS (SELECT n, CAST(0 AS BIGINT) AS depth, n AS root FROM e WHERE p IS NULL UNION ALL SELECT e.n, r.depth + 1, r.root FROM r JOIN e ON e.p = r.n) SELECT e.n AS node, r.depth, r.root FROM e LEFT JOIN r ON r.n = e.n""")
def parent_depths(spark, sf_dir):
    order = F.col("l_orderkey")
    tree = table(spark, sf_dir, "lineitem").select(order.alias("node"), F.when(order % 9 == 0, F.lit(None)).when(order % 50 == 7, order + 1).otherwise(order - 1 - order % 3).cast("bigint").alias("parent")).distinct()
    return depths(tree, node="node", parent="parent").select("node", "depth", "root")
