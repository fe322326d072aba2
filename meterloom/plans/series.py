"""Series, points, segments and other questions about time over `events`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meterloom.functions import periods, text
from meterloom.operators import aggregates, sequences
from meterloom.plans.registry import query, table

ZONE = "America/Chicago"
BY_USER = (["user_id"], ["ts", "event_id"])


@query("""SELECT user_id, event_type, date_trunc('hour', ts) AS hour, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY ALL""")
def bucket_build(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", periods.hour("ts").alias("hour")).agg(F.count("*").alias("calls"), aggregates.exact_sum("value").alias("total"))


@query("""SELECT CAST(timezone('America/Chicago', timezone('UTC', ts)) AS DATE) AS day, event_type, count(*) AS n,
        count(DISTINCT user_id) AS users, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY ALL""")
def local_day_series(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(periods.local_day("ts", ZONE).alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), aggregates.exact_sum("value").alias("total"))


@query("""SELECT strftime(timezone('America/Chicago', timezone('UTC', ts)), '%Y-%m') AS month, count(*) AS n FROM events GROUP BY ALL""")
def month_population(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(periods.local_month("ts", ZONE).alias("month")).agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS slot, count(*) AS n FROM events GROUP BY ALL")
def slot_15min(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(periods.slot("ts").alias("slot")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL),
    d AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM e),
    u AS (SELECT user_id, min(day) AS a, max(day) AS b FROM e GROUP BY user_id)
    SELECT u.user_id, d.day, coalesce(n, 0) AS n, CASE WHEN d.day < a OR d.day > b THEN 'missing' WHEN n IS NULL THEN 'zero' WHEN d.day = b THEN 'partial' ELSE 'observed' END AS state
    FROM u CROSS JOIN d LEFT JOIN e ON e.user_id = u.user_id AND e.day = d.day""")
def point_state(spark, sf_dir):
    """A point for each user and day of the whole range: days are made per user, not by a cross join."""
    days = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    bounds = days.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    whole = bounds.agg(F.min("a"), F.max("b")).first()
    points = bounds.select("user_id", "a", "b", F.explode(F.sequence(F.lit(whole[0]), F.lit(whole[1]))).alias("day"))
    state = F.when((F.col("day") < F.col("a")) | (F.col("day") > F.col("b")), "missing").when(F.col("n").isNull(), "zero").when(F.col("day") == F.col("b"), "partial").otherwise("observed")
    return points.join(days, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


@query("""SELECT count(*) FILTER (WHERE a >= '1996-01-01' AND b <= '1996-07-01') AS inside,
        count(*) FILTER (WHERE (a < '1996-01-01' AND b > '1996-01-01') OR (a < '1996-07-01' AND b > '1996-07-01')) AS straddling FROM
    (SELECT o_orderdate AS a, l_shipdate AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate)""")
def interval_inside_straddle(spark, sf_dir):
    start, end, a, b = F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-07-01").cast("timestamp_ntz"), F.col("o_orderdate"), F.col("l_shipdate")
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate"), "l_orderkey").where(b > a)
    return spans.agg(F.count_if((a >= start) & (b <= end)).alias("inside"), F.count_if(((a < start) & (b > start)) | ((a < end) & (b > end))).alias("straddling"))


@query("""SELECT event_id, nullif(event_type, 'error') AS kind FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-12'
        AND (event_type IN ('click', 'view') OR nullif(event_type, 'error') IS NULL)""")
def named_or_unknown(spark, sf_dir):
    kind = F.nullif("event_type", F.lit("error"))
    return table(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-05' AND ts < timestamp_ntz'2024-01-12'").select("event_id", kind.alias("kind")).where(F.col("kind").isin("click", "view") | F.col("kind").isNull())


@query("""SELECT user_id, count(*) AS covered, count(*) FILTER (WHERE event_type = 'purchase') AS matching,
        CAST(sum(CAST(value AS DECIMAL(18,6))) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS matching_value,
        count(DISTINCT event_type) FILTER (WHERE value > 50) AS kinds FROM events GROUP BY user_id""")
def matches_flag(spark, sf_dir):
    events, matches = table(spark, sf_dir, "events"), F.col("event_type") == "purchase"
    return events.groupBy("user_id").agg(
        F.count("*").alias("covered"), F.count_if(matches).alias("matching"), aggregates.exact_sum(F.when(matches, F.col("value"))).alias("matching_value"), F.count_distinct(F.when(F.col("value") > 50, F.col("event_type"))).alias("kinds")
    )


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    return aggregates.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", [("p50", 0.5), ("p90", 0.9)])


@query("""WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, value AS p25 FROM o WHERE i = CAST(floor((n - 1) * 0.25 + 0.5) AS BIGINT)""")
def rounded_percentile(spark, sf_dir):
    return aggregates.rounded_index(table(spark, sf_dir, "events"), ["user_id"], "value", 0.25, "p25")


@query("""WITH o AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS age FROM orders),
    w AS (SELECT *, sum(pow(0.8, age)) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, age) AS upto, sum(pow(0.8, age)) OVER (PARTITION BY o_custkey) AS total FROM o)
    SELECT o_custkey, min(o_totalprice) AS median FROM w WHERE upto * 2 >= total - 1e-9 GROUP BY o_custkey""")
def weighted_median(spark, sf_dir):
    age = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))) - 1
    return aggregates.weighted_median(table(spark, sf_dir, "orders").withColumn("age", age), ["o_custkey"], "o_totalprice", "age")


@query("""WITH p AS (SELECT event_id, user_id, CAST(round(value * 100) AS BIGINT) AS c, lag(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
    SELECT event_id, user_id, b IS NULL OR c < b AS is_reset, CASE WHEN b IS NULL OR c < b THEN c ELSE c - b END AS d_c FROM p""")
def lag_increments(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("c", F.round(F.col("value") * 100).cast("bigint"))
    return sequences.increments(events, *BY_USER, ["c"]).select("event_id", "user_id", "is_reset", "d_c")


@query("""WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM f""")
def series_islands(spark, sf_dir):
    return sequences.islands(table(spark, sf_dir, "events"), *BY_USER, sequences.changed(*BY_USER, "event_type")).select("event_id", "user_id", "island")


@query("""WITH f AS (SELECT *, lag(event_type) OVER w AS before_type, lag(value) OVER w AS before, lag(event_id) OVER w AS before_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, before_id, event_id, before, value FROM f WHERE event_type = before_type AND value - before >= 20 AND value >= 1.5 * before""")
def context_growth(spark, sf_dir):
    """Neighbours within a series of one type that grew by 20 and half."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("p", F.lag(F.struct("event_type", "value", "event_id")).over(w)).where(F.col("event_type") == F.col("p.event_type"))
    grown = (F.col("value") - F.col("p.value") >= 20) & (F.col("value") >= 1.5 * F.col("p.value"))
    return rows.where(grown).select("user_id", F.col("p.event_id").alias("before_id"), "event_id", F.col("p.value").alias("before"), "value")


@query("""WITH f AS (SELECT *, sum(CASE WHEN event_type IN ('error', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
    r AS (SELECT user_id, g, min(ts) AS run_start, count(*) AS run_length FROM f WHERE event_type IN ('error', 'click') GROUP BY user_id, g)
    SELECT user_id, run_start, run_length FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY run_length DESC, g) = 1""")
def retry_runs(spark, sf_dir):
    return sequences.longest_run(table(spark, sf_dir, "events"), *BY_USER, F.col("event_type").isin("error", "click"))


@query("""WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 3 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM f)
    SELECT user_id, CAST(segment AS BIGINT) AS segment, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY ALL""")
def session_segments(spark, sf_dir):
    cut = sequences.islands(table(spark, sf_dir, "events"), *BY_USER, sequences.gap_over(*BY_USER, "ts", 3 * 3600), "segment")
    return cut.groupBy("user_id", "segment").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL)
    SELECT hour, n, CAST(sum(n) OVER (ORDER BY hour RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS last_24h FROM h""")
def rolling_24h(spark, sf_dir):
    """Each hour is dealt to the 24 hours that it counts in, so no window holds the whole series."""
    hours = table(spark, sf_dir, "events").groupBy(periods.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    step = F.explode(F.sequence(F.lit(0), F.lit(23)))
    sums = hours.select(F.col("n").alias("m"), step.alias("k"), "hour").select((F.col("hour") + F.expr("make_dt_interval(0, k)")).alias("hour"), "m").groupBy("hour").agg(F.sum("m").alias("last_24h"))
    return hours.join(sums, "hour")


@query("""SELECT user_id, max(ts) AS newest, CAST(floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 60000000) AS BIGINT) AS age_minutes,
        CASE WHEN max(ts) < TIMESTAMP '2024-01-30' THEN 'expired' WHEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts)) > 22500000000 THEN 'stale' ELSE 'fresh' END AS state FROM events GROUP BY user_id""")
def freshness(spark, sf_dir):
    """With a cadence of three hours a reading is stale after 375 minutes; a passed reset goes before age."""
    newest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("newest"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    age = micros(F.lit("2024-01-31")) - micros(F.col("newest"))
    state = F.when(F.col("newest") < F.lit("2024-01-30").cast("timestamp_ntz"), "expired").when(age > F.lit(375 * 60_000_000), "stale").otherwise("fresh")
    return newest.select("user_id", "newest", F.floor(age / 60_000_000).alias("age_minutes"), state.alias("state"))


@query("SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT user_id AS account, event_type AS model, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS calls, count(*) FILTER (WHERE value > 200) AS late FROM events GROUP BY ALL)
    SELECT account, model, CAST(hour AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago' AS DATE) AS day, CAST(sum(calls) AS BIGINT) AS calls, count(*) AS buckets, count(*) FILTER (WHERE late > 0) AS partial_buckets, max(hour) AS last_hour FROM b GROUP BY ALL""")
def bucket_series(spark, sf_dir):
    """Buckets of an account and model by local day, and how many of them are still being written."""
    hours = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("account"), F.col("event_type").alias("model"), periods.hour("ts").alias("hour")).agg(F.count("*").alias("calls"), F.count_if(F.col("value") > 200).alias("late"))
    by = hours.groupBy("account", "model", periods.local_day("hour", "America/Chicago").alias("day"))
    return by.agg(F.sum("calls").alias("calls"), F.count("*").alias("buckets"), F.count_if(F.col("late") > 0).alias("partial_buckets"), F.max("hour").alias("last_hour"))


@query("""WITH h AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-19 15:00:00' AND ts < TIMESTAMP '2024-01-20 15:00:00' GROUP BY ALL)
    SELECT user_id, CAST(sum(n) AS BIGINT) AS last_24h, CAST(coalesce(sum(n) FILTER (WHERE hour >= TIMESTAMP '2024-01-20 09:00:00'), 0) AS BIGINT) AS last_6h, coalesce(sum(n) FILTER (WHERE hour >= TIMESTAMP '2024-01-20 09:00:00'), 0) / 6.0::DOUBLE AS mean_6h FROM h GROUP BY user_id""")
def recent_hours(spark, sf_dir):
    """The last 24 complete hours before half past three, and the mean of the last six; hours without rows count."""
    now = F.lit("2024-01-20 15:30:00").cast("timestamp_ntz")
    end = F.date_trunc("hour", now).cast("timestamp_ntz")
    back = lambda hours: end - F.expr(f"INTERVAL {hours} HOURS")
    rows = table(spark, sf_dir, "events").where((F.col("ts") >= back(24)) & (F.col("ts") < end))
    six = F.count_if(F.col("ts") >= back(6))
    return rows.groupBy("user_id").agg(F.count("*").alias("last_24h"), six.alias("last_6h"), (six / F.lit(6.0)).alias("mean_6h"))


@query("""WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, count(*) AS n, max(value) FILTER (WHERE k = ceil(n * 0.5)) AS p50, max(value) FILTER (WHERE k = ceil(n * 0.9)) AS p90, arg_max(event_id, (value, event_id)) AS slowest FROM r GROUP BY event_type""")
def slowest_calls(spark, sf_dir):
    """Percentiles of each kind, and the event that took longest."""
    events = table(spark, sf_dir, "events")
    ranks = aggregates.nearest_rank(events, ["event_type"], "value", [("p50", 0.5), ("p90", 0.9)])
    return ranks.join(events.groupBy("event_type").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("slowest")), "event_type")


@query("""SELECT doc_id, substr(trim(regexp_replace(text, '[\\x00-\\x1F\\x7F-\\x9F\\x{00AD}\\x{200B}-\\x{200F}\\x{2028}\\x{2029}\\x{FEFF}]', '', 'g'), ' '), 1, 120) AS shown FROM documents""")
def display_names(spark, sf_dir):
    """Names as they may be shown: no control, format or line-separator characters, trimmed, 120 code points."""
    return table(spark, sf_dir, "documents").select("doc_id", text.display("text").alias("shown"))
