"""Exports and account pages, written as JSON from the test tables and read back, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.plans.registry import query, table
from meterloom.sources import exports, feeds


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("day", F.date_trunc("day", "l_shipdate"))


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


@query("""SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS bucket_start, CASE WHEN l_suppkey % 2 = 0 THEN date_trunc('day', l_shipdate)::TIMESTAMP + INTERVAL 2 HOUR ELSE date_trunc('day', l_shipdate)::TIMESTAMP + INTERVAL 1 HOUR END AS bucket_end, 'm' || l_partkey % 5 AS model,
    CASE WHEN l_linenumber < 4 THEN 'w' || l_suppkey END AS scope, l_returnflag AS service_tier, CASE WHEN l_linenumber <> 6 THEN l_orderkey % 9 END AS requests, CAST(floor(l_quantity) AS BIGINT) AS input_fresh, CASE WHEN l_linenumber > 2 THEN l_partkey END AS input_cached,
    CASE l_linenumber % 4 WHEN 0 THEN l_suppkey + l_partkey WHEN 1 THEN l_suppkey WHEN 2 THEN l_orderkey % 77 END AS input_cache_write, l_orderkey % 50 AS output FROM lineitem""")
def account_usage_pages(spark, sf_dir):
    """A page for each supplier and day: what is cached and written is told beside fresh input."""
    line = F.col("l_linenumber")
    when = lambda cond, c: F.when(cond, c)
    creation = F.struct(when(line % 4 < 2, F.col("l_suppkey")).alias("ephemeral_5m_input_tokens"), when(line % 4 == 0, F.col("l_partkey")).alias("ephemeral_1h_input_tokens"))
    result = F.struct(
        F.concat(F.lit("m"), F.col("l_partkey") % 5).alias("model"),
        when(line < 4, F.concat(F.lit("w"), "l_suppkey")).alias("workspace_id"),
        F.col("l_returnflag").alias("service_tier"),
        when(line % 2 == 0, when(line != 6, F.col("l_orderkey") % 9)).alias("requests"),
        when(line % 2 == 1, F.col("l_orderkey") % 9).alias("request_count"),
        F.floor("l_quantity").alias("uncached_input_tokens"),
        when(line > 2, F.col("l_partkey")).alias("cache_read_input_tokens"),
        when(line % 4 != 2, creation).alias("cache_creation"),
        when(line % 4 == 2, F.col("l_orderkey") % 77).alias("cache_creation_input_tokens"),
        (F.col("l_orderkey") % 50).alias("output_tokens"),
    )
    even = F.col("l_suppkey") % 2 == 0
    buckets = _lines(spark, sf_dir).groupBy("l_suppkey", "day").agg(F.collect_list(result).alias("results"))
    bucket = F.struct(when(even, _stamp("day")).alias("starting_at"), when(~even, _stamp("day")).alias("start_time"), when(even, _stamp(F.col("day") + F.expr("INTERVAL 2 HOURS"))).alias("ending_at"), "results")
    pages = buckets.select(F.to_json(F.struct(F.array(bucket).alias("data"))).alias("value"))
    return exports.usage_page(pages, "anthropic")[0]


@query("""SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS bucket_start, date_trunc('day', l_shipdate)::TIMESTAMP + INTERVAL 1 HOUR AS bucket_end, 'm' || l_partkey % 5 AS model, 'p' || l_suppkey AS scope, CASE WHEN l_linenumber = 1 THEN 'flex' END AS service_tier, l_orderkey % 9 AS requests,
    greatest(l_partkey - coalesce(CASE WHEN l_linenumber > 2 THEN l_orderkey % 300 END, 0), 0) AS input_fresh, CASE WHEN l_linenumber > 2 THEN l_orderkey % 300 END AS input_cached, CAST(NULL AS BIGINT) AS input_cache_write, l_orderkey % 50 AS output FROM lineitem""")
def account_completion_pages(spark, sf_dir):
    """Pages that tell cached tokens within their input."""
    line, seconds = F.col("l_linenumber"), F.unix_seconds(F.col("day").cast("timestamp"))
    result = F.struct(F.concat(F.lit("m"), F.col("l_partkey") % 5).alias("model"), F.concat(F.lit("p"), "l_suppkey").alias("project_id"), F.when(line == 1, "flex").alias("service_tier"), (F.col("l_orderkey") % 9).alias("num_model_requests"), F.col("l_partkey").alias("input_tokens"), F.when(line > 2, F.col("l_orderkey") % 300).alias("input_cached_tokens"), (F.col("l_orderkey") % 50).alias("output_tokens"))
    buckets = _lines(spark, sf_dir).groupBy("l_suppkey", "day").agg(F.collect_list(result).alias("results"))
    pages = buckets.select(F.to_json(F.struct(F.array(F.struct(seconds.alias("start_time"), (seconds + 3600).alias("end_time"), "results")).alias("data"))).alias("value"))
    return exports.usage_page(pages, "openai")[0]


@query("""SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS started, date_trunc('day', l_shipdate)::TIMESTAMP + INTERVAL 1 DAY AS ended, CASE WHEN l_linenumber = 1 THEN 'unknown' ELSE 's' || l_partkey % 7 END AS sku, CASE WHEN l_linenumber = 2 THEN 'm' END AS model,
    l_partkey / 100 AS usd FROM lineitem WHERE l_linenumber <> 5""")
def account_cost_pages(spark, sf_dir):
    """Cents as text, as numbers or with their currency; other currencies are left out."""
    line, cents = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    amount = F.when(line == 1, F.concat(F.lit('"'), cents, F.lit('"'))).when(line == 2, cents).when(line == 5, F.concat(F.lit('{"currency":"EUR","value":"'), cents, F.lit('"}'))).otherwise(F.concat(F.lit('{"currency":"usd","value":'), cents, F.lit("}")))
    result = F.concat(F.lit('{"amount":'), amount, F.when(line != 1, F.concat(F.lit(',"description":"s'), (F.col("l_partkey") % 7).cast("string"), F.lit('"'))).otherwise(""), F.when(line == 2, ',"model":"m"').otherwise(""), F.lit("}"))
    buckets = _lines(spark, sf_dir).groupBy("l_suppkey", "day").agg(F.array_join(F.collect_list(result), ",").alias("results"))
    pages = buckets.select(F.concat(F.lit('{"data":[{"starting_at":"'), _stamp("day"), F.lit('","results":['), "results", F.lit("]}]}")).alias("value"))
    return exports.cost_page(pages, "anthropic").withColumn("usd", F.col("usd").cast("double"))


@query("""WITH e AS (SELECT *, CAST(floor(value) AS BIGINT) AS i, CASE WHEN event_id % 3 > 0 THEN event_id % 200 END AS c, CASE WHEN event_id % 4 = 0 THEN user_id END AS w FROM events WHERE event_id % 10 > 0)
    SELECT ts AS started, 'ev' || event_id AS event_id, event_type AS model, CASE WHEN c IS NULL OR c > i THEN i ELSE i - c END AS input_fresh, c AS input_cached, w AS input_cache_write, event_id % 90 AS output, CASE WHEN event_id % 5 > 0 THEN event_id % 5 / 100 END AS usd,
        CASE WHEN c IS NULL OR c > i THEN i ELSE i - c END + coalesce(c, 0) + coalesce(w, 0) + event_id % 90 AS total FROM e""")
def account_event_pages(spark, sf_dir):
    tokens = F.struct(F.floor("value").alias("inputTokens"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 200).alias("cacheReadTokens"), F.when(F.col("event_id") % 4 == 0, F.col("user_id")).alias("cache_write_tokens"), (F.col("event_id") % 90).alias("outputTokens"))
    whole = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.concat(F.lit("ev"), "event_id").alias("id"), F.col("event_type").alias("model"), F.when(F.col("event_id") % 10 > 0, tokens).alias("tokenUsage"), F.when(F.col("event_id") % 10 > 0, F.col("event_id") % 5).alias("chargedCents"))
    pages = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(whole).alias("usageEvents")).select(F.to_json(F.struct("usageEvents")).alias("value"))
    return exports.event_page(pages)[0].withColumn("usd", F.col("usd").cast("double"))


@query("""WITH w AS (SELECT ts, 'lim' || user_id % 5 AS lim, CAST(floor(value) AS DOUBLE) AS used, epoch_us(ts) // 1000000 + event_id % 9000 - 500 AS reset, 10080 AS minutes, event_id FROM events WHERE event_type <> 'error'
        UNION ALL SELECT ts, 'lim' || user_id % 5, 50.0::DOUBLE, epoch_us(ts) // 1000000 + 300, CASE WHEN event_id % 2 = 0 THEN 300 END, event_id FROM events WHERE event_type <> 'error'),
    g AS (SELECT * FROM w WHERE used BETWEEN 0 AND 100 AND minutes > 0 AND reset > epoch_us(ts) / 1e6)
    SELECT lim || ':' || minutes AS window_key, 'Plan' || CASE WHEN minutes = 10080 THEN ' · weekly' ELSE ' · ' || minutes // 60 || 'h' END AS label, ts AS observed_at, used, make_timestamp(reset * 1000000) AS resets_at, CAST(minutes AS BIGINT) AS window_minutes FROM g
    QUALIFY row_number() OVER (PARTITION BY lim, minutes, date_trunc('hour', ts) ORDER BY ts DESC, used DESC) = 1""")
def embedded_allowance(spark, sf_dir):
    """Readings that come within other records: what can't be true is left out, one an hour stays."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    first = F.struct(F.floor("value").alias("used_percent"), (seconds + F.col("event_id") % 9000 - 500).alias("resets_at"), F.lit(10080).alias("window_minutes"))
    second = F.struct(F.lit(50.0).alias("used_percent"), (seconds + 300).alias("resets_at"), F.when(F.col("event_id") % 2 == 0, 300).alias("window_minutes"))
    limits = F.struct(F.concat(F.lit("lim"), F.col("user_id") % 5).alias("limit_id"), F.lit("Plan").alias("limit_name"), first.alias("primary"), second.alias("secondary"))
    record = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.struct(F.when(F.col("event_type") != "error", limits).alias("rate_limits")).alias("payload"))
    return exports.embedded_windows(table(spark, sf_dir, "events").select(F.to_json(record).alias("value")))


@query("""WITH o AS (SELECT *, CASE event_type WHEN 'view' THEN 'GENERATION' WHEN 'click' THEN 'SPAN' WHEN 'error' THEN 'TOOL' ELSE 'AGENT' END AS t, CASE WHEN event_id % 4 = 0 THEN event_id - 1 END AS p FROM events),
    k AS (SELECT o.*, CASE WHEN t = 'GENERATION' THEN 'model' WHEN t = 'TOOL' OR (t = 'SPAN' AND event_id % 2 = 0) THEN 'tool' ELSE 'other' END AS kind FROM o), w AS (SELECT DISTINCT p AS id FROM k WHERE kind = 'model' AND p IS NOT NULL)
    SELECT 'u' || user_id AS run_id, 'o' || event_id AS event_id, CASE WHEN kind = 'other' AND w.id IS NOT NULL AND EXISTS (SELECT 1 FROM k c WHERE c.p = k.event_id AND c.user_id = k.user_id AND c.kind = 'model') THEN 'aggregate' ELSE kind END AS kind, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 3 = 0 THEN 'unknown' ELSE 'ok' END AS status, epoch_us(ts) // 1000 AS start_ms,
        CASE WHEN t = 'GENERATION' THEN CASE event_id % 3 WHEN 0 THEN CAST(floor(value) AS BIGINT) WHEN 1 THEN CAST(floor(value) AS BIGINT) END END AS tokens_in, CASE WHEN t = 'GENERATION' AND event_id % 3 = 0 THEN event_id % 50 END AS cache_read, CASE WHEN t = 'GENERATION' AND event_id % 3 = 0 THEN 'input_excludes_cache_read' END AS token_basis,
        CASE WHEN kind = 'tool' AND t = 'SPAN' THEN 'c' || event_id END AS tool_call_id FROM k LEFT JOIN w ON w.id = k.event_id""")
def observation_events(spark, sf_dir):
    """Observations of three shapes of usage, as events; a span above a generation is an aggregate."""
    kind, at = F.col("event_type"), F.col("event_id")
    types = F.when(kind == "view", "GENERATION").when(kind == "click", "SPAN").when(kind == "error", "TOOL").otherwise("AGENT")
    details = F.when((kind == "view") & (at % 3 == 0), F.struct(F.floor("value").alias("input"), (at % 50).alias("cached_tokens")))
    older = F.when((kind == "view") & (at % 3 > 0), F.struct(F.when(at % 3 == 1, "TOKENS").otherwise("CHARACTERS").alias("unit"), F.floor("value").alias("input")))
    tool = F.when((kind == "click") & (at % 2 == 0), F.struct(F.concat(F.lit("c"), "event_id").alias("toolCallId")))
    row = F.struct(
        F.concat(F.lit("o"), "event_id").alias("id"),
        F.concat(F.lit("u"), "user_id").alias("traceId"),
        F.when(at % 4 == 0, F.concat(F.lit("o"), at - 1)).alias("parentObservationId"),
        types.alias("type"),
        F.when(kind == "error", "ERROR").when(at % 3 != 0, "DEFAULT").alias("level"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("startTime"),
        details.alias("usageDetails"),
        older.alias("usage"),
        tool.alias("metadata"),
    )
    pages = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(row).alias("data")).select(F.to_json(F.struct("data")).alias("value"))
    found = exports.observations(exports.text_parts(pages))[0]
    return found.select("run_id", "event_id", "kind", "status", "start_ms", "tokens_in", "cache_read", "token_basis", "tool_call_id")


_FEED_SQL = """f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders), bad AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 499 = 0 AND NOT (o_custkey % 2 = 1 AND o_orderkey % 4 = 0) UNION SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 41 = 0),
    k AS (SELECT o_custkey AS feed, 'id' || o_orderkey // 3 AS id, place, o_custkey % 2 = 1 AS ann, CASE o_orderkey % 5 WHEN 0 THEN 'banked' WHEN 1 THEN 'mixed' ELSE 'regular' END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN 'observed' ELSE 'x_post' END AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'broad' END AS scope, o_orderkey, o_orderdate FROM f WHERE o_custkey NOT IN (SELECT o_custkey FROM bad))"""


@query(f"""WITH {_FEED_SQL} SELECT feed, id, 'T ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'more' ELSE '' END AS title, o_orderdate AS announced_at, 'https://example.org/' || o_orderkey AS url, CASE WHEN ann OR kind <> 'regular' THEN 'announcement' ELSE 'history' END AS category,
        CASE WHEN kind = 'banked' THEN 'banked' WHEN kind <> 'regular' THEN 'credits' WHEN scope = 'broad' THEN 'global' ELSE 'reset' END AS reset_kind, source || ':' || kind AS source_type, CASE WHEN source = 'observed' THEN 'archive observation' WHEN kind <> 'regular' THEN 'announced credits' WHEN ann THEN 'reset announcement' ELSE 'reported reset' END AS status, scope,
        TIMESTAMP '2024-01-01 10:00:00' AS checked_at, feed % 3 = 0 AS stale FROM k WHERE NOT (ann AND source = 'observed') QUALIFY row_number() OVER (PARTITION BY feed, id ORDER BY place DESC) = 1""")
def reset_feed_items(spark, sf_dir):
    """A feed for each customer, with a record for each order."""
    return feeds.reset_items(_feeds(spark, sf_dir))[0]


@query(f"""WITH {_FEED_SQL} SELECT o_custkey AS feed, 'schema_changed' AS problem FROM bad UNION ALL SELECT DISTINCT o_custkey, 'pending_unavailable' FROM orders WHERE o_custkey % 7 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM bad)""")
def reset_feed_problems(spark, sf_dir):
    return feeds.reset_items(_feeds(spark, sf_dir))[1]


def _feeds(spark, sf_dir):
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(order % 5 == 0, "banked").when(order % 5 == 1, "mixed").otherwise("regular")
    scheme = F.when(order % 499 == 0, "ftp").otherwise("https")
    record = F.struct(
        F.concat(F.lit("id"), F.floor(order / 3)).alias("id"),
        F.struct(F.concat(F.lit("T "), order).alias("en")).alias("title"),
        F.struct(F.when(order % 2 == 0, "more").alias("en")).alias("summary"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("announcedAt"),
        kind.alias("kind"),
        F.when(order % 4 == 0, "observed").otherwise("x_post").alias("sourceKind"),
        F.concat(scheme, F.lit("://example.org/"), order).alias("sourceUrl"),
        F.when(order % 3 == 0, "broad").alias("scope"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), record.alias("r")))), lambda x: x["r"])
    by = table(spark, sf_dir, "orders").groupBy(cust.alias("feed")).agg(listed.alias("data"))
    meta = lambda at: F.struct(F.lit(at).alias("checked_at"), (F.col("feed") % 3 > 0).alias("fresh"))
    archive = F.when(F.col("feed") % 41 == 0, F.lit('{"data":{}}')).otherwise(F.to_json(F.struct("data", meta("2024-01-01T12:00:00Z").alias("meta"))))
    status = F.concat(F.lit('{"scheduled":'), F.when(F.col("feed") % 7 == 0, '{"when":"soon"}').otherwise("null"), F.lit(',"latest_update":null,"meta":'), F.to_json(meta("2024-01-01T10:00:00Z")), F.lit("}"))
    return by.select("feed", (F.col("feed") % 2 == 1).alias("announcements"), archive.alias("archive"), status.alias("status"))
