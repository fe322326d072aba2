"""Canonical rows, registers, snapshots and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.functions import periods
from meterloom.operators import aggregates, canonical, joins
from meterloom.plans.registry import query, table

ZONE = "America/Chicago"


@query("""SELECT user_id, event_type, CAST(ts AS DATE) AS day, event_id, ts, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY value DESC, ts DESC, event_id DESC) = 1""")
def canonical_bucket(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    return canonical.winner(events, ["user_id", "event_type", "day"], ["value", "ts", "event_id"], ["event_id", "ts", "value"])


@query("""SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY
        CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, ts DESC, event_id DESC) = 1""")
def canonical_ranked(spark, sf_dir):
    kind = F.col("event_type")
    rank = F.when(kind == "purchase", 0).when(kind == "signup", 1).when(kind == "click", 2).otherwise(3)
    events = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    return canonical.winner(events, ["user_id", "day"], [-rank, "ts", "event_id"], ["event_id", "event_type"])


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
    b AS (SELECT o_custkey, o_orderkey AS best_o_orderkey, o_orderpriority AS best_o_orderpriority FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INTEGER), o_orderdate DESC, o_orderkey DESC) = 1)
    SELECT o_custkey, o_orderkey, o_orderdate, best_o_orderkey, best_o_orderpriority FROM a JOIN b USING (o_custkey)""")
def two_winners(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    recent, rank = ["o_orderdate", "o_orderkey"], F.substring("o_orderpriority", 1, 1).cast("int")
    found = canonical.two_winners(orders, ["o_custkey"], recent, [-rank, *recent], ["o_orderkey", "o_orderpriority"])
    return found.drop("o_orderpriority")


@query("""WITH v AS (SELECT user_id, event_id AS view_event_id, ts AS view_ts FROM events WHERE event_type = 'view'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
    c AS (SELECT user_id, event_id AS click_event_id, ts AS click_ts FROM events WHERE event_type = 'click'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT user_id, view_event_id, view_ts, click_event_id, click_ts FROM v FULL JOIN c USING (user_id)""")
def two_registers(spark, sf_dir):
    return canonical.registers(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["view", "click"], ["ts", "event_id"], ["event_id", "ts"])


@query("""SELECT year(l_shipdate) AS ship_year, l_orderkey, l_linenumber, l_extendedprice,
        CAST(row_number() OVER (PARTITION BY year(l_shipdate) ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS rank
    FROM lineitem QUALIFY rank <= 3""")
def top_n_per_group(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("ship_year", F.year("l_shipdate").cast("bigint"))
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return canonical.top_n(lines, ["ship_year"], order, 3).select("ship_year", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query("""SELECT l_orderkey, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, max(l_tax) AS l_tax,
        coalesce(min(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END), 'N') AS l_returnflag FROM lineitem GROUP BY l_orderkey""")
def max_merge(spark, sf_dir):
    return canonical.component_max(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_quantity", "l_extendedprice", "l_tax"], ["l_returnflag"], unknown="N")


@query("SELECT text, lang, source, min(doc_id) AS doc_id FROM documents GROUP BY text, lang, source")
def replay_collapse(spark, sf_dir):
    return canonical.earliest_of_equal(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), ["text", "lang", "source"], ["doc_id"])


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= '1998-01-01' AND NOT EXISTS
        (SELECT 1 FROM orders AS h WHERE h.o_orderkey = orders.o_orderkey AND h.o_orderdate < '2000-01-01')""")
def append_new(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return canonical.append_new(orders.where("o_orderdate < '2000-01-01'"), orders.where("o_orderdate >= '1998-01-01'"), ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS contents FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1")
def content_conflicts(spark, sf_dir):
    return canonical.conflicts(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority")


@query("""SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON c_custkey = o_custkey""")
def latest_revision_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.latest_join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def semi_open_orders(spark, sf_dir):
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(held, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_large_orders(spark, sf_dir):
    held = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(held, "c_custkey", "left_anti")


@query("""WITH k AS (SELECT nullif(event_type, 'error') AS kind, count(*) AS n_all FROM events GROUP BY ALL)
    SELECT event_id, nullif(event_type, 'error') AS kind, n_all FROM events JOIN k ON k.kind IS NOT DISTINCT FROM nullif(event_type, 'error')""")
def null_safe_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("kind"))
    return joins.null_safe_join(events, events.groupBy("kind").agg(F.count("*").alias("n_all")), ["kind"], "inner")


@query("""WITH o AS (SELECT c.c_custkey AS k, epoch(o_orderdate)::BIGINT AS a, epoch(o_orderdate)::BIGINT + 86400 * 40 AS b, o_orderkey
        FROM orders JOIN customer AS c ON c_custkey = o_custkey)
    SELECT x.o_orderkey AS first_key, y.o_orderkey AS second_key, least(x.b, y.b) - greatest(x.a, y.a) AS seconds
    FROM o AS x JOIN o AS y ON x.k = y.k AND x.o_orderkey < y.o_orderkey AND x.a < y.b AND y.a < x.b""")
def interval_overlap(spark, sf_dir):
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    span = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select(F.col("o_custkey").alias("k"), "o_orderkey", start.alias("a"), (start + 86400 * 40).alias("b"))
    other = span.select("k", F.col("o_orderkey").alias("second_key"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    found = joins.overlaps(span, other, ["k"], start="a", end="b", from_="a2", until="b2", step=86400 * 20)
    return found.where("o_orderkey < second_key").select(F.col("o_orderkey").alias("first_key"), "second_key", "seconds")


@query(r"""WITH p AS (SELECT page_id, regexp_replace(split_part(url, '://', 2), '[?#].*$', '') AS path FROM pages),
    r AS (SELECT DISTINCT split_part(path, '/', 1) AS root FROM p UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM p WHERE path LIKE '%/en%')
    SELECT page_id, path, (SELECT max_by(root, length(root)) FROM r WHERE path = root OR starts_with(path, root || '/')) AS root FROM p""")
def longest_prefix(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.split_part("url", F.lit("://"), F.lit(2)), "[?#].*$", "").alias("path"))
    host, second = F.split_part("path", F.lit("/"), F.lit(1)), F.split_part("path", F.lit("/"), F.lit(2))
    roots = pages.select(host.alias("root")).union(pages.where("path LIKE '%/en%'").select(F.concat_ws("/", host, second))).distinct()
    return joins.longest_prefix(pages, "path", roots, "root", ["root"])


@query("""WITH b AS (SELECT * FROM part WHERE p_size <= 35), h AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 7 = 0 THEN 'x' ELSE p_type END AS p_type FROM part WHERE p_size >= 10)
    SELECT coalesce(b.p_partkey, h.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'added' WHEN h.p_partkey IS NULL THEN 'removed'
        WHEN b.p_type = h.p_type AND b.p_brand = h.p_brand THEN 'same' ELSE 'changed' END AS change FROM b FULL JOIN h ON b.p_partkey = h.p_partkey""")
def keyed_diff(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    head = part.where("p_size >= 10").withColumn("p_type", F.when(F.col("p_size") % 7 == 0, "x").otherwise(F.col("p_type")))
    return joins.keyed_diff(part.where("p_size <= 35"), head, ["p_partkey"], ["p_brand", "p_type"])


@query("""SELECT 'customer' AS ledger, c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, s_acctbal FROM supplier""")
def union_ledgers(spark, sf_dir):
    one = table(spark, sf_dir, "customer").select(F.lit("customer").alias("ledger"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    two = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("ledger"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return one.unionByName(two)


@query("""WITH l AS (SELECT o_custkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS covered, count(*) AS requests FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'F' AND l_returnflag = 'R' GROUP BY 1),
    u AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS reported, count(*) AS buckets FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
    SELECT o_custkey, reported, buckets, covered, requests, reported - covered AS unattributed FROM u FULL JOIN l USING (o_custkey)""")
def reconcile(spark, sf_dir):
    """What an account reports less what its requests cover; null where either side is not told, never a guess."""
    orders = table(spark, sf_dir, "orders")
    covered = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F' AND l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("covered"), F.count("*").alias("requests"))
    joined = orders.join(covered, "o_orderkey", "left")
    reported = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("decimal(18,2)"))
    found = joined.groupBy("o_custkey").agg(F.sum(reported).cast("double").alias("reported"), F.count(reported).alias("buckets"), F.sum("covered").cast("double").alias("covered"), F.sum("requests").alias("requests"))
    told = found.where("buckets > 0 OR requests IS NOT NULL").withColumn("buckets", F.when(F.col("buckets") > 0, F.col("buckets")))
    return told.withColumn("unattributed", F.col("reported") - F.col("covered"))


@query("""SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus = 'P') AS last_pending FROM orders GROUP BY o_custkey""")
def ordered_first(spark, sf_dir):
    pending = F.when(F.col("o_orderstatus") == "P", F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", pending).alias("last_pending"))


@query("""WITH n AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, string_agg(l_returnflag || ':' || n, ',' ORDER BY l_returnflag) AS counts FROM n GROUP BY l_suppkey""")
def counts_by_flag(spark, sf_dir):
    found = aggregates.state_counts(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag")
    return found.select("l_suppkey", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("""WITH b AS (SELECT l_suppkey % 5 AS account, l_returnflag AS source, date_trunc('month', l_shipdate)::TIMESTAMP AS start, md5(l_linestatus || '/' || l_partkey % 40) AS dims, CASE WHEN l_partkey % 3 > 0 THEN l_shipdate + to_days(CAST(l_linenumber AS INTEGER)) END AS refreshed, l_shipdate AS observed, l_orderkey * 10 + l_linenumber AS id, l_quantity AS tokens FROM lineitem)
    SELECT account, source, start, dims, refreshed, id, tokens FROM b QUALIFY row_number() OVER (PARTITION BY account, source, start, dims ORDER BY refreshed DESC NULLS LAST, observed DESC, id DESC) = 1""")
def canonical_provider_bucket(spark, sf_dir):
    """A provider's bucket by its dimensions: what it refreshed last, then what was observed last."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("account"),
        F.col("l_returnflag").alias("source"),
        F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("start"),
        F.md5(F.concat_ws("/", "l_linestatus", (F.col("l_partkey") % 40).cast("string"))).alias("dims"),
        F.when(F.col("l_partkey") % 3 > 0, F.col("l_shipdate") + F.make_dt_interval(F.col("l_linenumber").cast("int"))).alias("refreshed"),
        F.col("l_shipdate").alias("observed"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_quantity").alias("tokens"),
    )
    return canonical.winner(rows, ["account", "source", "start", "dims"], ["refreshed", "observed", "id"], ["refreshed", "id", "tokens"])


@query("""WITH e AS (SELECT user_id % 7 AS account, event_id % 400 AS semantic_key, event_type AS kind, ts AS observed, event_id AS id, 'g' || user_id % 9 AS agent FROM events)
    SELECT account, semantic_key, kind, observed, agent FROM e QUALIFY row_number() OVER (PARTITION BY account, semantic_key ORDER BY observed DESC, id DESC) = 1""")
def canonical_agent_event(spark, sf_dir):
    """What is told of an agent counts by its key's newest row."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("account"), (F.col("event_id") % 400).alias("semantic_key"), F.col("event_type").alias("kind"), F.col("ts").alias("observed"), F.col("event_id").alias("id"), F.concat(F.lit("g"), F.col("user_id") % 9).alias("agent"))
    return canonical.winner(rows, ["account", "semantic_key"], ["observed", "id"], ["kind", "observed", "agent"])
