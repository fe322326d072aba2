"""Exported spans out of the test tables: a user's events as a tree of spans, an envelope for each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meterloom.plans.registry import query, table
from meterloom.sources import spans


@query("""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), s AS (SELECT user_id, event_id, i, CASE WHEN i > 1 THEN i // 2 END AS up, event_type = 'error' AS tool, event_type = 'view' AS model, CASE WHEN i % 5 = 0 THEN 'c' || user_id || '-' || i END AS own, epoch_us(ts) // 1000 AS start_ms FROM n),
    r AS (SELECT user_id, i AS a, up, model FROM s UNION ALL SELECT r.user_id, r.a, s.up, r.model FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.up), b AS (SELECT user_id, up AS i, count(*) FILTER (WHERE model) AS models FROM r WHERE up IS NOT NULL GROUP BY ALL),
    k AS (SELECT s.*, coalesce(models, 0) AS models FROM s LEFT JOIN b USING (user_id, i)), r2 AS (SELECT user_id, i AS a, up, model AND models = 0 AS leaf FROM k UNION ALL SELECT r2.user_id, r2.a, k.up, r2.leaf FROM r2 JOIN k ON k.user_id = r2.user_id AND k.i = r2.up), d AS (SELECT user_id, up AS i, count(*) FILTER (WHERE leaf) AS calls FROM r2 WHERE up IS NOT NULL GROUP BY ALL),
    w AS (SELECT user_id, i, i AS at_i, own, up FROM k UNION ALL SELECT w.user_id, w.i, k.i, k.own, k.up FROM w JOIN k ON k.user_id = w.user_id AND k.i = w.up WHERE w.own IS NULL), f AS (SELECT user_id, i, max(own) AS run FROM w GROUP BY ALL), o AS (SELECT user_id, count(DISTINCT own) AS n, min(own) AS only_run FROM s GROUP BY user_id)
    SELECT coalesce(f.run, CASE WHEN o.n = 1 THEN only_run END, 't' || k.user_id) AS run_id, 's' || k.i AS event_id, CASE WHEN tool THEN 'tool' WHEN model THEN CASE WHEN coalesce(calls, 0) = 0 THEN 'model' ELSE 'aggregate' END WHEN coalesce(calls, 0) >= 2 THEN 'aggregate' ELSE 'other' END AS kind,
        CASE WHEN tool THEN 'grep' ELSE 'n' END AS name, CASE WHEN model THEN event_id % 500 END AS tokens_in, CASE WHEN tool THEN sha256('{"path":"file number ' || event_id || '"}') END AS args_hash, k.start_ms FROM k LEFT JOIN d USING (user_id, i) LEFT JOIN f USING (user_id, i) LEFT JOIN o USING (user_id)""")
def span_trees(spark, sf_dir):
    """Kinds, runs and hashed arguments of spans, which their trees decide."""
    at, i = F.col("event_id"), F.col("i")
    rows = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    text = lambda c: F.to_json(F.struct(c.alias("stringValue")))
    pair = lambda key, value: F.concat(F.lit(f'{{"key":"{key}","value":'), value, F.lit("}"))
    path = F.concat(F.lit('{"kvlistValue":{"values":[{"key":"path","value":{"stringValue":"file number '), at, F.lit('"}}]}}'))
    attributes = F.array_compact(
        F.array(
            F.when(i % 5 == 0, pair("gen_ai.conversation.id", text(F.concat(F.lit("c"), "user_id", F.lit("-"), i)))),
            F.when(F.col("event_type") == "error", pair("gen_ai.tool.name", text(F.lit("grep")))),
            F.when(F.col("event_type") == "error", pair("gen_ai.tool.call.arguments", path)),
            F.when(F.col("event_type") == "view", pair("gen_ai.usage.input_tokens", F.concat(F.lit('{"intValue":"'), at % 500, F.lit('"}')))),
        )
    )
    start = F.concat(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.lit("000"))
    span = F.concat(F.lit('{"traceId":"t'), "user_id", F.lit('","spanId":"s'), i, F.when(i > 1, F.concat(F.lit('","parentSpanId":"s'), F.floor(i / 2))).otherwise(""), F.lit('","name":"n","startTimeUnixNano":"'), start, F.lit('","attributes":['), F.array_join(attributes, ","), F.lit("]}"))
    whole = F.concat(F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":['), span, F.lit("]}]}]}"))
    found, _ = spans.span_events(rows.select(F.lit("events").alias("file"), at.alias("pos"), whole.alias("value")))
    return found.select("run_id", "event_id", "kind", "name", "tokens_in", "args_hash", "start_ms")
