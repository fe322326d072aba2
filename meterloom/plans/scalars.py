"""Names, hashes, paths, local time and counters as single expressions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.functions import numbers, periods, text
from meterloom.plans.registry import query, table

ZONE = "America/Chicago"
#: A wall clock of a zone as SQL has it, and the instant that a wall clock stands for outside gaps and overlaps.
_WALL = lambda at: f"({at} AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}')"
_AT = lambda wall: f"({wall} AT TIME ZONE '{ZONE}' AT TIME ZONE 'UTC')"


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","nested":{"a":[' || p_size || ',1],"z":true},"size":' || p_size || ',"type":null}') AS hash FROM part""")
def canonical_hash(spark, sf_dir):
    """Keys in any order and blanks anywhere give one hash; the order of an array counts."""
    loose = F.format_string('{ "size" : %d, "type": null,\n "nested": {"z": true , "a": [%d, 1]}, "brand":"%s" }', "p_size", "p_size", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", text.content_hash(loose).alias("hash"))


@query("""WITH o AS (SELECT p_partkey, p_size % 4 AS size, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brand FROM part)
    SELECT '{"brand":' || coalesce('"' || brand || '"', 'null') || ',"size":' || size || '}' AS content, count(*) AS sightings, min(p_partkey) AS first_key FROM o GROUP BY 1""")
def content_identity(spark, sf_dir):
    """What an object says without its own id: rows that agree in it are one observation seen again."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("size"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("brand")), {"ignoreNullFields": "false"}).alias("j"))
    content = text.canonical_json("j", without=("id",))
    return rows.groupBy(content.alias("content")).agg(F.count("*").alias("sightings"), F.min("p_partkey").alias("first_key"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size >= 10 WHEN 1 THEN false ELSE false END AS secret FROM part""")
def secret_names(spark, sf_dir):
    """Long opaque values count under sensitive names alone, and paths never do."""
    key = F.when(F.col("p_partkey") % 3 == 0, "API_KEY").when(F.col("p_partkey") % 3 == 1, "auth-token-file").otherwise("label")
    value = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("/etc/"), F.lpad(F.col("p_partkey").cast("string"), 20, "0"))).otherwise(F.when(F.col("p_size") >= 10, F.lpad(F.col("p_partkey").cast("string"), 16, "x")).otherwise("short"))
    return table(spark, sf_dir, "part").select("p_partkey", text.looks_secret(key, value).alias("secret"))


@query("""WITH c AS (SELECT o_orderkey, sha1(CAST(o_orderkey AS VARCHAR)) AS sha, CASE o_orderkey % 4 WHEN 0 THEN sha1(CAST(o_orderkey AS VARCHAR)) WHEN 1 THEN substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 9) WHEN 2 THEN '' END AS other FROM orders)
    SELECT o_orderkey, substr(sha, 1, 7) AS short, other IS NOT NULL AND other <> '' AND (starts_with(sha, other) OR starts_with(other, sha)) AS same FROM c""")
def commit_prefix(spark, sf_dir):
    sha, kind = F.sha1(F.col("o_orderkey").cast("string")), F.col("o_orderkey") % 4
    other = F.when(kind == 0, sha).when(kind == 1, F.substring(sha, 1, 9)).when(kind == 2, "")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.short_hash(sha).alias("short"), text.same_commit(sha, other).alias("same"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'h:' || substr(md5(CAST(l_partkey AS VARCHAR)), 1, 16) WHEN 2 THEN 'bash' WHEN 3 THEN NULL ELSE 'h:zz' END AS name,
        CASE WHEN l_partkey % 5 = 0 THEN 'Label' END AS label, CASE WHEN l_linenumber = 3 AND l_suppkey % 2 = 0 THEN 'builtin' ELSE 'mcp' END AS kind,
        CASE l_suppkey % 3 WHEN 0 THEN 'codex_apps:mail' WHEN 1 THEN 'h:' || substr(md5(CAST(l_suppkey AS VARCHAR)), 1, 16) END AS space FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN label IS NOT NULL THEN label WHEN regexp_full_match(name, 'h:[a-f0-9]{16}') THEN substr(name, 1, 6) || '…' WHEN name IS NOT NULL THEN name WHEN kind = 'builtin' THEN 'builtin (unnamed)' END AS shown,
        CASE WHEN starts_with(space, 'codex_apps:') THEN substr(space, 12) || ' (connector)' WHEN regexp_full_match(space, 'h:[a-f0-9]{16}') THEN substr(space, 1, 6) || '…' ELSE space END AS namespace FROM t""")
def tool_display(spark, sf_dir):
    line, digest = F.col("l_linenumber"), lambda c: F.concat(F.lit("h:"), F.substring(F.md5(F.col(c).cast("string")), 1, 16))
    name = F.when(line == 1, digest("l_partkey")).when(line == 2, "bash").when(line == 3, F.lit(None)).otherwise("h:zz")
    kind = F.when((line == 3) & (F.col("l_suppkey") % 2 == 0), "builtin").otherwise("mcp")
    space = F.when(F.col("l_suppkey") % 3 == 0, "codex_apps:mail").when(F.col("l_suppkey") % 3 == 1, digest("l_suppkey"))
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.shown_name(name, F.when(F.col("l_partkey") % 5 == 0, "Label"), kind).alias("shown"), text.shown_namespace(space, none).alias("namespace"))


@query("""SELECT p_partkey, trim(p_name) AS base, trim(regexp_replace(lower(trim(p_name)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS name FROM part""")
def section_titles(spark, sf_dir):
    """Copies of one section that were split or decorated read alike."""
    marks = F.element_at(F.array(*map(F.lit, (" (1/3)", ":", " (continued)", " (cont.):", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    title = F.concat("p_name", marks)
    return table(spark, sf_dir, "part").select("p_partkey", text.base_title(title).alias("base"), text.normal_title(title).alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '/srv/b/' || p_size WHEN 1 THEN 'c:/users/x' || p_size WHEN 2 THEN '/home/me/' || p_size || '/y' WHEN 3 THEN '/work/' || p_size END AS path FROM part""")
def path_keys(spark, sf_dir):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    raw = (
        F.when(kind == 0, F.concat(F.lit(" /srv/./a/../b//"), size, F.lit("/ ")))
        .when(kind == 1, F.concat(F.lit("C:\\Users\\X"), size))
        .when(kind == 2, F.concat(F.lit("~/"), size, F.lit("/x/../y")))
        .when(kind == 3, F.concat(F.lit('"./q/../'), size, F.lit('"')))
        .when(kind == 4, "https://example.org/a")
        .otherwise("$HOME/a")
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.normal_path(raw, home=F.lit("/home/me"), base=F.lit("/work")).alias("path"))


@query("""WITH f AS (SELECT l_orderkey, 'f' || l_linenumber AS name, CASE WHEN l_linenumber = 2 THEN 'added' ELSE 'modified' END AS status,
        CASE WHEN l_linenumber = 3 THEN 'blob:' || l_partkey || ':1:2' ELSE '+' || l_partkey || chr(10) || '-old' END AS lines FROM lineitem)
    SELECT l_orderkey, sha256(string_agg(name || chr(1) || status || chr(1) || '' || chr(1) || lines, chr(2) ORDER BY name, status, lines)) AS fingerprint FROM f GROUP BY l_orderkey""")
def diff_fingerprint(spark, sf_dir):
    """What a change does, wherever it sits: files in order, with the lines that they add and remove."""
    line, at = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    patch = F.when(line != 3, F.concat(F.lit("@@ -"), F.col("l_suppkey").cast("string"), F.lit(" +1 @@\n--- a\n+++ b\n same\n+"), at, F.lit("\n-old\n")))
    files = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.concat(F.lit("f"), line.cast("string")).alias("name"),
        F.when(line == 2, "added").otherwise("modified").alias("status"),
        F.coalesce(text.diff_lines(patch), F.concat(F.lit("blob:"), at, F.lit(":1:2"))).alias("lines"),
    )
    one = F.concat_ws("\x01", "name", "status", F.lit(""), "lines")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("name", one.alias("one")))), lambda x: x["one"])
    return files.groupBy("l_orderkey").agg(F.sha2(F.array_join(listed, "\x02"), 256).alias("fingerprint"))


@query(f"""SELECT event_id, {_AT(f"CAST(CAST({_WALL('ts')} AS DATE) AS TIMESTAMP)")} AS day_start, {_AT(f"CAST(CAST({_WALL('ts')} AS DATE) + 1 AS TIMESTAMP)")} AS next_day,
    {_AT(f"CAST(date_trunc('month', {_WALL('ts')}) AS TIMESTAMP)")} AS month_start FROM events""")
def local_bounds(spark, sf_dir):
    """Local days and months as instants; a day of the change of clocks has 23 or 25 hours."""
    start = periods.day_start("ts", ZONE)
    return table(spark, sf_dir, "events").select("event_id", start.alias("day_start"), periods.add_days(start, 1, ZONE).alias("next_day"), periods.month_start("ts", ZONE).alias("month_start"))


_NOW = "TIMESTAMP '2024-03-15 17:30:00'"


@query(f"""WITH r(preset, range_start, range_end) AS (VALUES ('today', TIMESTAMP '2024-03-15 05:00:00', {_NOW}), ('last_7_days', TIMESTAMP '2024-03-09 06:00:00', {_NOW}), ('last_30_days', TIMESTAMP '2024-02-15 06:00:00', {_NOW}),
        ('month_to_date', TIMESTAMP '2024-03-01 06:00:00', {_NOW}), ('previous_month', TIMESTAMP '2024-02-01 06:00:00', TIMESTAMP '2024-03-01 06:00:00'), ('custom', TIMESTAMP '2024-01-01 00:00:00', {_NOW}), ('backwards', NULL, NULL), ('too_long', NULL, NULL))
    SELECT preset, range_start, range_end, CAST(coalesce(len(range(CAST(date_trunc('month', {_WALL('range_start')}) AS TIMESTAMP), {_WALL("(range_end - INTERVAL 1 MICROSECOND)")} + INTERVAL 1 MICROSECOND, INTERVAL 1 MONTH)), -1) AS INTEGER) AS months FROM r""")
def preset_ranges(spark, sf_dir):
    now, at = F.lit("2024-03-15 17:30:00").cast("timestamp_ntz"), lambda x: F.lit(x).cast("timestamp_ntz")
    custom = {"custom": ("2024-01-01", "2024-06-01"), "backwards": ("2024-02-01", "2024-01-01"), "too_long": ("2022-01-01", "2024-02-01")}
    found = None
    for preset in ("today", "last_7_days", "last_30_days", "month_to_date", "previous_month", *custom):
        a, b = periods.preset_range("custom", now, ZONE, at(custom[preset][0]), at(custom[preset][1])) if preset in custom else periods.preset_range(preset, now, ZONE)
        row = spark.range(1).select(F.lit(preset).alias("preset"), a.alias("range_start"), b.alias("range_end"))
        found = row if found is None else found.unionByName(row)
    return found.withColumn("months", F.coalesce(F.size(F.when(F.col("range_start").isNotNull(), periods.months_within(F.col("range_start"), F.col("range_end"), ZONE))), F.lit(-1)).cast("int"))


_DAY = lambda at, back: _AT(f"CAST(CAST({_WALL(at)} AS DATE) - {back} AS TIMESTAMP)")
_MONTH = lambda at, back: _AT(f"CAST(date_trunc('month', {_WALL(at)}) - to_months({back}) AS TIMESTAMP)")
_RANGES_SQL = f"""e AS (SELECT event_id, ts, ts - to_days(CAST(event_id % 500 - 20 AS INTEGER)) AS a, least(ts, ts + to_days(CAST(event_id % 7 - 3 AS INTEGER))) AS b FROM events),
    r AS (SELECT event_id, 'today' AS preset, {_DAY('ts', 0)} AS range_start, ts AS range_end FROM e UNION ALL SELECT event_id, 'last_7_days', {_DAY('ts', 6)}, ts FROM e UNION ALL SELECT event_id, 'last_30_days', {_DAY('ts', 29)}, ts FROM e
        UNION ALL SELECT event_id, 'month_to_date', {_MONTH('ts', 0)}, ts FROM e UNION ALL SELECT event_id, 'previous_month', {_MONTH('ts', 1)}, {_MONTH('ts', 0)} FROM e
        UNION ALL SELECT event_id, 'custom', CASE WHEN b > a AND epoch_us(b) // 1000000 - epoch_us(a) // 1000000 <= 34560000 THEN a END, CASE WHEN b > a AND epoch_us(b) // 1000000 - epoch_us(a) // 1000000 <= 34560000 THEN b END FROM e)"""


@query(f"""WITH {_RANGES_SQL} SELECT event_id, preset, range_start, range_end, CASE WHEN range_end > range_start THEN 1 + CAST(date_diff('month', date_trunc('month', {_WALL('range_start')}), date_trunc('month', {_WALL("(range_end - INTERVAL 1 MICROSECOND)")})) AS INTEGER) ELSE -1 END AS months FROM r""")
def event_ranges(spark, sf_dir):
    """Every named range as it was at each event's instant, and the months that it touches."""
    now, number = F.col("ts"), F.col("event_id")
    start, end = now - F.make_dt_interval((number % 500 - 20).cast("int")), now + F.make_dt_interval((number % 7 - 3).cast("int"))
    ranges = {preset: periods.preset_range(preset, now, ZONE) for preset in ("today", "last_7_days", "last_30_days", "month_to_date", "previous_month")} | {"custom": periods.preset_range("custom", now, ZONE, start, end)}
    listed = F.array(*[F.struct(F.lit(preset).alias("preset"), a.cast("timestamp_ntz").alias("range_start"), b.cast("timestamp_ntz").alias("range_end")) for preset, (a, b) in ranges.items()])
    rows = table(spark, sf_dir, "events").select("event_id", F.inline(listed))
    months = F.size(F.when(F.col("range_end") > F.col("range_start"), periods.months_within(F.col("range_start"), F.col("range_end"), ZONE)))
    return rows.withColumn("months", F.when(F.col("range_end") > F.col("range_start"), months).otherwise(-1))


@query(f"""WITH g AS (SELECT user_id, max(ts) - to_days(CAST(5 + user_id % 20 AS INTEGER)) AS a, max(ts) AS b FROM events GROUP BY user_id), h AS (SELECT user_id, a, b, unnest(range(date_trunc('hour', a), b, INTERVAL 1 HOUR)) AS p FROM g WHERE user_id % 20 <= 9),
    d AS (SELECT user_id, a, b, unnest(range(CAST(CAST({_WALL('a')} AS DATE) AS TIMESTAMP), {_WALL('b')}, INTERVAL 1 DAY)) AS p FROM g WHERE user_id % 20 > 9)
    SELECT user_id, greatest(p, a) AS period_start, least(p + INTERVAL 1 HOUR, b) AS period_end FROM h UNION ALL SELECT user_id, greatest({_AT('p')}, a), least({_AT('(p + INTERVAL 1 DAY)')}, b) FROM d""")
def aligned_periods(spark, sf_dir):
    """Days and hours of each user's last days, cut to the range."""
    held = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("b"))
    start = F.col("b") - F.make_dt_interval((5 + F.col("user_id") % 20).cast("int"))
    return held.select("user_id", F.inline(periods.periods_within(start, F.col("b"), ZONE))).select("user_id", F.col("start").cast("timestamp_ntz").alias("period_start"), F.col("end").cast("timestamp_ntz").alias("period_end"))


@query("""WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS first FROM orders), d AS (SELECT first, CAST(unnest(range(first, CAST(first + INTERVAL 1 MONTH AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM m)
    SELECT strftime(first, '%Y-%m') AS month, strftime(day, '%Y-%m-%d') AS day, CAST((isodow(first) - 1 + date_diff('day', first, day)) // 7 AS INTEGER) AS week, CAST(isodow(day) - 1 AS INTEGER) AS weekday FROM d""")
def calendar_grid(spark, sf_dir):
    months = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("first")).distinct()
    cells = months.select(F.date_format("first", "yyyy-MM").alias("month"), F.posexplode(periods.calendar_cells(F.col("first"))).alias("at", "day")).where("day IS NOT NULL")
    return cells.select("month", "day", F.floor(F.col("at") / 7).cast("int").alias("week"), (F.col("at") % 7).alias("weekday"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(CASE WHEN event_type = 'view' THEN 1.5::DOUBLE ELSE 0 END) AS shared, sum(CASE WHEN event_type = 'click' THEN 2.0::DOUBLE ELSE 0 END) AS solo FROM events GROUP BY ALL)
    SELECT user_id, day, shared + solo AS booked, CASE WHEN isodow(day) < 6 THEN greatest(0.0::DOUBLE, 8.0 - (shared + solo)) END AS open, greatest(8.0::DOUBLE, shared + solo) AS scale FROM d""")
def working_load(spark, sf_dir):
    of = lambda kind, hours: F.sum(F.when(F.col("event_type") == kind, hours).otherwise(0.0))
    days = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(of("view", 1.5).alias("shared"), of("click", 2.0).alias("solo"))
    return days.select("user_id", "day", *periods.day_load(F.col("shared"), F.col("solo"), F.weekday("day") >= 5))


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, l_suppkey % 2 = 0 AS codex, CAST(floor(l_extendedprice) AS BIGINT) % 900 - 100 AS i, l_partkey % 300 AS c, CASE WHEN l_linenumber > 2 THEN l_suppkey % 90 END AS w, CASE WHEN l_linenumber < 6 THEN l_orderkey % 50 END AS o FROM lineitem),
    n AS (SELECT *, CASE WHEN i >= 0 THEN i ELSE 0 END AS ni, coalesce(w, 0) AS nw, coalesce(o, 0) AS no FROM u)
    SELECT l_orderkey, l_linenumber, CASE WHEN codex THEN greatest(ni - c - nw, 0) ELSE ni END AS fresh, CAST(c AS BIGINT) AS cached, CAST(nw AS BIGINT) AS cache_write, CAST(no AS BIGINT) AS output FROM n""")
def exclusive_components(spark, sf_dir):
    codex, size = F.col("l_suppkey") % 2 == 0, F.floor("l_extendedprice")
    cached, written = F.col("l_partkey") % 300, F.when(F.col("l_linenumber") > 2, F.col("l_suppkey") % 90)
    only = lambda c, when: F.when(when, c)
    usage = F.struct(
        (size % 900 - 100).alias("input_tokens"),
        only(cached, codex).alias("cached_input_tokens"),
        only(written, codex).alias("cache_write_input_tokens"),
        only(cached, ~codex).alias("cache_read_input_tokens"),
        only(written, ~codex).alias("cache_creation_input_tokens"),
        F.when(F.col("l_linenumber") < 6, F.col("l_orderkey") % 50).alias("output_tokens"),
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", codex.alias("codex"), usage.alias("usage"))
    return rows.select("l_orderkey", "l_linenumber", *numbers.components(F.when(F.col("codex"), "codex").otherwise("claude"), "usage"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN l_partkey WHEN 2 THEN l_partkey WHEN 3 THEN -l_partkey END AS n FROM lineitem""")
def tolerant_ints(spark, sf_dir):
    line, n = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    told = F.when(line == 1, F.concat(F.lit(" "), n, F.lit(" "))).when(line == 2, F.concat(n, F.lit(".0"))).when(line == 3, F.concat(F.lit("-"), n)).when(line == 4, F.concat(n, F.lit(".5"))).when(line == 5, "true")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.tolerant_int(told).alias("n"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS input, l_partkey % 60 - 5 AS cached, l_suppkey % 30 AS written, l_orderkey % 40 AS output, l_partkey % 50 AS reasoning FROM lineitem),
    c AS (SELECT *, least(input, greatest(0, cached)) AS c FROM p), w AS (SELECT *, least(greatest(0, input - c), greatest(0, written)) AS w FROM c)
    SELECT l_orderkey, l_linenumber, CAST(c AS BIGINT) AS cached, CAST(w AS BIGINT) AS written, CAST(greatest(0, input - c - w) AS BIGINT) AS uncached, CAST(least(output, reasoning) AS BIGINT) AS reasoning, CAST(greatest(0, output - least(output, reasoning)) AS BIGINT) AS other FROM w""")
def clamped_components(spark, sf_dir):
    """No part is below zero, and together they are the whole."""
    cached, written, uncached = numbers.exclusive(F.round("l_quantity").cast("bigint"), F.col("l_partkey") % 60 - 5, F.col("l_suppkey") % 30)
    reasoning, other = numbers.exclusive(F.col("l_orderkey") % 40, F.col("l_partkey") % 50)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cached.alias("cached"), written.alias("written"), uncached.alias("uncached"), reasoning.alias("reasoning"), other.alias("other"))
