"""Allowance readings: freshness, cycles between resets, pace, outlook, urgency, and what a point stands for.

Readings have a key (keys), a time, a tie (unique), used (percent), reset (when the window ends) and minutes
(the length of the window)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterloom.operators.canonical import top_n
from meterloom.operators.components import checkpointed
from meterloom.operators.joins import null_safe_join
from meterloom.plans.registry import query, table

#: Resets this close are one; a longer gap between readings breaks a pace; so far back does a segment go.
TOLERANCE_SECONDS, GAP_HOURS, SPAN_HOURS = 120, 3, 24
FLOOR_MINUTES, SLACK_MINUTES = 120, 15
#: Completed cycles that an outlook looks back on, and what each is worth against the one after it.
CYCLES, KEEP = 8, 0.8
TIGHT_REMAINING = 20.0


def _micros(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def _hours(a: Column, b: Column) -> Column:
    return (_micros(b) - _micros(a)) / 3.6e9


def freshness(observed: Column, reset: Column, now: Column, cadence_minutes: Column | int = 60) -> tuple[Column, Column]:
    """age in minutes, and why a reading is stale: its window has ended (expired), or it is older than two
    hours and than two cadences and a quarter of an hour (age); null where it is fresh."""
    cadence = F.lit(cadence_minutes) if isinstance(cadence_minutes, int) else cadence_minutes
    age = F.greatest((_micros(now) - _micros(observed)) / 6e7, F.lit(0.0))
    limit = F.greatest(F.lit(FLOOR_MINUTES), 2 * cadence + SLACK_MINUTES)
    return age, F.when(_micros(reset) <= _micros(now), "expired").when(age > limit, "age")


def paced(readings: DataFrame, keys: Sequence[str], *, now: Column, cadence_minutes: int = 60, gap_hours: float = GAP_HOURS, span_hours: float = SPAN_HOURS) -> DataFrame:
    """A row for each key: its newest reading, freshness, and the pace of the segment that ends there.

    A segment goes back while reset and window stay the same, nothing falls, no gap is over gap_hours and
    nothing is older than span_hours, so a key brings no more than that many hours to a task. A pace needs
    half an hour and a fresh reading. Projections start at the reading, not at `now`."""
    reading = F.struct("time", "tie", "used", "reset", "minutes")
    newest = readings.groupBy(*keys).agg(F.max(reading).alias("n"))
    near = null_safe_join(readings, newest, keys, "inner").where(_hours(F.col("time"), F.col("n.time")) <= span_hours)
    later = Window.partitionBy(*keys).orderBy(F.desc("time"), F.desc("tie"))
    after = F.lag(F.struct("used", "time")).over(later)
    broken = ~F.col("reset").eqNullSafe(F.col("n.reset")) | ~F.col("minutes").eqNullSafe(F.col("n.minutes")) | F.coalesce(F.col("used") > F.col("after.used"), F.lit(False)) | F.coalesce(_hours(F.col("time"), F.col("after.time")) > gap_hours, F.lit(False))
    cut = near.withColumn("after", after).withColumn("breaks", F.sum(broken.cast("int")).over(later.rowsBetween(Window.unboundedPreceding, 0))).where("breaks = 0")
    segment = cut.groupBy(*keys).agg(F.first("n").alias("n"), F.count("*").alias("readings"), F.min_by(F.struct("used", "time"), F.struct("time", "tie")).alias("f"))
    age, reason = freshness(F.col("n.time"), F.col("n.reset"), now, cadence_minutes)
    told = segment.select(*keys, "n.*", "readings", "f", age.alias("age_minutes"), reason.alias("stale_reason")).withColumn("hours", _hours(F.col("f.time"), F.col("time")))
    rate = F.when(F.col("stale_reason").isNull() & (F.col("hours") >= 0.5), (F.col("used") - F.col("f.used")) / F.col("hours"))
    told = told.withColumns({"rate": rate, "remaining": 100 - F.col("used"), "hours_left": _hours(F.col("time"), F.col("reset"))})
    return told.withColumn("sustainable_a_day", F.when(F.col("stale_reason").isNull() & (F.col("hours_left") > 0), F.col("remaining") / F.col("hours_left") * 24)).drop("f")


def _projected(df: DataFrame) -> DataFrame:
    """With the level at the reset, the hours to exhaustion, and whether it lasts, from `rate`."""
    to_end = F.when(F.col("rate") > 0, F.col("remaining") / F.col("rate"))
    lasts = F.when(F.col("rate").isNotNull(), (F.col("rate") == 0) | F.coalesce(to_end >= F.col("hours_left"), F.lit(True)))
    return df.withColumns({"projected": F.col("used") + F.col("rate") * F.col("hours_left"), "exhausted_in": to_end, "lasts": lasts})


def cycles(readings: DataFrame, keys: Sequence[str], *, now: Column, gap_hours: float = GAP_HOURS) -> tuple[DataFrame, DataFrame]:
    """(readings with their cycle's anchor, cycles). A reading joins the newest cycle of its window whose first
    reset lies within TOLERANCE_SECONDS of its own, or begins one; the newest reading names a cycle's reset.

    Which resets begin cycles follows from where each was first seen, so a key brings its distinct resets to
    one row, some for each window, not its readings."""
    keys = [*keys, "minutes"]
    at = F.struct("time", "tie")
    seen = readings.groupBy(*keys, "reset").agg(F.min(at).alias("at"))
    tolerance = TOLERANCE_SECONDS * 1_000_000
    close = lambda a, b: F.abs(_micros(a) - _micros(b)) <= tolerance
    order = F.array_sort(F.collect_list(F.struct("at", "reset")))
    begin = F.aggregate(order, F.filter(order, lambda _: F.lit(False)), lambda held, one: F.when(F.exists(held, lambda h: close(h["reset"], one["reset"])), held).otherwise(F.array_append(held, one)))
    anchors = seen.groupBy(*keys).agg(begin.alias("anchors"))
    own = F.filter("anchors", lambda a: close(a["reset"], F.col("reset")) & (a["at"] <= F.struct("time", "tie")))
    placed = readings.join(anchors, keys).withColumn("anchor", F.element_at(own, F.lit(-1))["reset"]).drop("anchors")
    placed = checkpointed(placed, "cycles")  # read for the cycles and for what is asked of them
    before = F.lag(F.struct("used", "time")).over(Window.partitionBy(*keys, "anchor").orderBy("time", "tie"))
    gap = _hours(F.col("before.time"), F.col("time"))
    breaks = F.coalesce((F.col("used") < F.col("before.used")) | (gap <= 0) | (gap > gap_hours), F.lit(False))
    told = placed.withColumn("before", before).withColumn("breaks", breaks)
    found = told.groupBy(*keys, "anchor").agg(
        F.max_by("reset", at).alias("reset_at"), F.count("*").alias("samples"), F.bool_or("breaks").alias("discontinuous"), F.min_by("used", at).alias("first_used"), F.max_by("used", at).alias("last_used"), F.min("time").alias("first"), F.max("time").alias("last")
    )
    hours = _hours(F.col("first"), F.col("last"))
    found = found.withColumns({"completed": _micros("reset_at") <= _micros(now), "hours": hours, "used_points": F.greatest(F.col("last_used") - F.col("first_used"), F.lit(0.0))})
    return placed, found.withColumn("pace", F.when(~F.col("discontinuous") & (F.col("hours") >= 0.5), F.col("used_points") / F.col("hours"))).drop("first_used", "last_used", "first", "last")


def weighted_middle(rates: Column) -> Column:
    """Of an array of (pace, age) the first pace, in order, at which the weights KEEP^age reach half."""
    ordered = F.array_sort(rates)
    weight = lambda x: F.pow(F.lit(KEEP), x["age"])
    total = F.aggregate(ordered, F.lit(0.0), lambda held, x: held + weight(x))
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("double").alias("pace"))
    step = lambda held, x: F.struct((held["upto"] + weight(x)).alias("upto"), F.coalesce(held["pace"], F.when(held["upto"] + weight(x) >= total / 2, x["pace"])).alias("pace"))
    return F.aggregate(ordered, start, step)["pace"]


def outlook(readings: DataFrame, keys: Sequence[str], *, now: Column, cadence_minutes: int = 60, gap_hours: float = GAP_HOURS, span_hours: float = SPAN_HOURS) -> DataFrame:
    """The pace of each key's current window, blended with that of its last CYCLES completed ones until it
    is warm. Readings marked history_only shape the history and never the present; a key that has no
    others gives no row."""
    placed, all_cycles = cycles(readings, keys, now=now, gap_hours=gap_hours)
    live = placed.where("NOT history_only")
    active = live.groupBy(*keys).agg(F.max_by(F.struct("minutes", "anchor"), F.struct("time", "tie")).alias("a")).select(*keys, "a.*")
    current = paced(live.join(active, [*keys, "minutes", "anchor"]), keys, now=now, cadence_minutes=cadence_minutes, gap_hours=gap_hours, span_hours=span_hours)
    others = all_cycles.join(active.select(*keys, F.col("minutes").alias("m"), F.col("anchor").alias("n")), list(keys)).where("completed AND pace IS NOT NULL AND NOT (minutes = m AND anchor = n)")
    past = top_n(others, keys, [F.desc("reset_at"), F.desc("minutes"), F.desc("anchor")], CYCLES, "age").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pace", (F.col("age") - 1).alias("age")))).alias("rates"))
    both = current.join(past, list(keys), "left").withColumn("rates", F.coalesce("rates", F.array().cast("array<struct<pace:double,age:int>>")))
    at = lambda share: F.try_element_at("rates", F.floor((F.size("rates") - 1) * share + 0.5).cast("int") + 1)["pace"]
    warm = F.least(F.lit(6.0), F.greatest(F.lit(1.0), F.col("minutes") / 60 * 0.1))
    both = both.withColumns({"current_pace": F.col("rate"), "past_pace": weighted_middle(F.col("rates")), "comparable": F.size("rates"), "past_low": F.when(F.size("rates") > 0, at(0.25)), "past_high": F.when(F.size("rates") > 0, at(0.75))})
    both = both.withColumn("live_weight", F.when(F.col("current_pace").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.col("hours") / warm)))
    source = (
        F.when(F.col("stale_reason").isNotNull(), "stale")
        .when(F.col("current_pace").isNull(), F.when(F.col("past_pace").isNull(), "unavailable").otherwise("historical"))
        .when(F.col("past_pace").isNotNull() & (F.col("live_weight") < 1), "blended")
        .otherwise("current_window")
    )
    blended = F.col("current_pace") * F.col("live_weight") + F.col("past_pace") * (1 - F.col("live_weight"))
    told = both.withColumn("source", source).withColumn("rate", F.when(F.col("source") == "historical", F.col("past_pace")).when(F.col("source") == "blended", blended).when(F.col("source") == "current_window", F.col("current_pace")))
    return _projected(told.drop("rates"))


TIERS = ("short", "exhausted", "tight", "steady", "history")


def urgency(outlooks: DataFrame) -> DataFrame:
    """outlooks with tier and remains (what is left at the reset): short of allowance before the reset first,
    then used up, tight, steady; a key without a current reading is history."""
    left = F.when(F.col("projected").isNotNull(), 100 - F.col("projected"))
    tier = F.when(F.col("used").isNull(), "history").when((F.col("remains") < 0) & (F.col("remaining") > 0), "short").when(F.col("remaining") <= 0, "exhausted").when(F.coalesce("remains", "remaining") < TIGHT_REMAINING, "tight").otherwise("steady")
    return outlooks.withColumn("remains", left).withColumn("tier", tier)


def by_urgency(rows: DataFrame, *last: str) -> list[Column]:
    """The order that rows with a tier are shown in: the sooner end of those that fall short, what is left of
    the others, the sooner reset, and the columns named last."""
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    end = F.when(F.col("tier") == "short", _micros("time") / 3.6e9 + F.col("exhausted_in"))
    return [rank, F.asc_nulls_last(end), F.asc_nulls_last(F.coalesce("remains", "remaining")), F.asc_nulls_last("reset"), *map(F.asc, last)]


NOW = "2024-01-31 12:00:00"
_GAP, _SPAN, _CADENCE = 96, 240, 1440


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that rise through each week, with some falls, resets that jitter, and a disabled reader."""
    week = F.date_trunc("week", "ts").cast("timestamp_ntz")
    used = F.floor((_micros("ts") - _micros(week)) / 6_720_000_000).cast("double") - F.when(F.col("event_id") % 17 == 0, 3.0).otherwise(0.0)
    reset = week + F.expr("INTERVAL 7 DAYS") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 7 * 50).cast("decimal(18,6)"))
    return table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("time"), F.col("event_id").alias("tie"), F.greatest(used, F.lit(0.0)).alias("used"), reset.alias("reset"), F.lit(10080).alias("minutes"), (F.col("event_type") == "error").alias("history_only"))


_H = lambda a, b: f"((epoch_us({b}) - epoch_us({a})) / 3.6e9)"
_READ_SQL = """r AS (SELECT user_id, ts AS time, event_id AS tie, greatest(CAST(floor((epoch_us(ts) - epoch_us(CAST(date_trunc('week', ts) AS TIMESTAMP))) / 6720000000) AS DOUBLE) - CASE WHEN event_id % 17 = 0 THEN 3 ELSE 0 END, 0.0::DOUBLE) AS used,
        CAST(date_trunc('week', ts) AS TIMESTAMP) + INTERVAL 7 DAY + to_seconds(event_id % 7 * 50) AS reset, 10080 AS minutes, event_type = 'error' AS history_only FROM events)"""
_CYCLE_SQL = f"""RECURSIVE {_READ_SQL},
    seen AS (SELECT user_id, reset, min((time, tie)) AS first_at FROM r GROUP BY ALL), nth AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_at, reset) AS n FROM seen),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS TIMESTAMP[]) AS held FROM (SELECT DISTINCT user_id FROM r)
        UNION ALL SELECT f.user_id, nth.n, CASE WHEN len(list_filter(held, lambda h: abs(epoch_us(h) - epoch_us(nth.reset)) <= 120000000)) > 0 THEN held ELSE list_append(held, nth.reset) END FROM f JOIN nth ON nth.user_id = f.user_id AND nth.n = f.n + 1),
    anchors AS (SELECT a.user_id, a.reset AS anchor, a.first_at, a.n FROM nth a JOIN (SELECT user_id, arg_max(held, n) AS held FROM f GROUP BY user_id) h ON h.user_id = a.user_id AND list_contains(held, a.reset)),
    placed AS (SELECT r.*, (SELECT arg_max(anchor, n) FROM anchors a WHERE a.user_id = r.user_id AND abs(epoch_us(anchor) - epoch_us(r.reset)) <= 120000000 AND a.first_at <= (r.time, r.tie)) AS anchor FROM r),
    stepped AS (SELECT *, lag(used) OVER w AS pu, lag(time) OVER w AS pt FROM placed WINDOW w AS (PARTITION BY user_id, anchor ORDER BY time, tie)),
    c AS (SELECT user_id, minutes, anchor, arg_max(reset, (time, tie)) AS reset_at, count(*) AS samples, coalesce(bool_or(used < pu OR time <= pt OR {_H('pt', 'time')} > {_GAP}), false) AS discontinuous, arg_min(used, (time, tie)) AS fu, arg_max(used, (time, tie)) AS lu, {_H('min(time)', 'max(time)')} AS hours FROM stepped GROUP BY user_id, minutes, anchor),
    cy AS (SELECT user_id, minutes, anchor, reset_at, samples, discontinuous, reset_at <= TIMESTAMP '{NOW}' AS completed, hours, greatest(lu - fu, 0.0::DOUBLE) AS used_points, CASE WHEN NOT discontinuous AND hours >= 0.5 THEN greatest(lu - fu, 0.0::DOUBLE) / hours END AS pace FROM c)"""


def _pace_sql(rows: str) -> str:
    return f"""newest AS (SELECT user_id, arg_max(used, (time, tie)) AS lu, arg_max(reset, (time, tie)) AS lr, max(time) AS lt, arg_max(minutes, (time, tie)) AS lm, max_by(tie, (time, tie)) AS ltie FROM {rows} GROUP BY user_id),
    back AS (SELECT x.*, lu, lr, lt, lag(x.used) OVER w AS au, lag(x.time) OVER w AS at2 FROM {rows} x JOIN newest USING (user_id) WHERE {_H('x.time', 'lt')} <= {_SPAN} WINDOW w AS (PARTITION BY user_id ORDER BY time DESC, tie DESC)),
    cut AS (SELECT *, sum(CASE WHEN reset <> lr OR coalesce(used > au, false) OR coalesce({_H('time', 'at2')} > {_GAP}, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY time DESC, tie DESC ROWS UNBOUNDED PRECEDING) AS b FROM back),
    seg AS (SELECT user_id, count(*) AS readings, arg_min(used, (time, tie)) AS fu, min(time) AS ft FROM cut WHERE b = 0 GROUP BY user_id),
    told AS (SELECT user_id, lt AS time, ltie AS tie, lu AS used, lr AS reset, lm AS minutes, readings, greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(lt)) / 6e7, 0) AS age_minutes, fu, {_H('ft', 'lt')} AS hours, 100 - lu AS remaining, {_H('lt', 'lr')} AS hours_left FROM newest JOIN seg USING (user_id)),
    stale AS (SELECT *, CASE WHEN reset <= TIMESTAMP '{NOW}' THEN 'expired' WHEN age_minutes > {max(120, 2 * _CADENCE + 15)} THEN 'age' END AS stale_reason FROM told),
    pace AS (SELECT * EXCLUDE (fu), CASE WHEN stale_reason IS NULL AND hours >= 0.5 THEN (used - fu) / hours END AS rate, CASE WHEN stale_reason IS NULL AND hours_left > 0 THEN remaining / hours_left * 24 END AS sustainable_a_day FROM stale)"""


_PROJECT_SQL = "used + rate * hours_left AS projected, CASE WHEN rate > 0 THEN remaining / rate END AS exhausted_in, CASE WHEN rate IS NOT NULL THEN rate = 0 OR coalesce(CASE WHEN rate > 0 THEN remaining / rate END >= hours_left, true) END AS lasts"


@query(f"WITH {_READ_SQL}, {_pace_sql('r')} SELECT *, {_PROJECT_SQL} FROM pace")
def quota_pace(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp_ntz")
    return _projected(paced(_readings(spark, sf_dir), ["user_id"], now=now, cadence_minutes=_CADENCE, gap_hours=_GAP, span_hours=_SPAN))


@query(f"WITH {_CYCLE_SQL} SELECT * FROM cy")
def quota_cycles(spark, sf_dir):
    return cycles(_readings(spark, sf_dir), ["user_id"], now=F.lit(NOW).cast("timestamp_ntz"), gap_hours=_GAP)[1]


_OUTLOOK_SQL = f"""{_CYCLE_SQL}, act AS (SELECT user_id, arg_max(anchor, (time, tie)) AS n FROM placed WHERE NOT history_only GROUP BY user_id), lv AS (SELECT p.* FROM placed p JOIN act ON act.user_id = p.user_id AND p.anchor = n WHERE NOT history_only),
    {_pace_sql('lv')}, past AS (SELECT cy.user_id, pace, row_number() OVER (PARTITION BY cy.user_id ORDER BY reset_at DESC, minutes DESC, anchor DESC) - 1 AS age FROM cy JOIN act USING (user_id) WHERE completed AND pace IS NOT NULL AND anchor <> n),
    few AS (SELECT * FROM past WHERE age < {CYCLES}), upto AS (SELECT *, sum(pow({KEEP}::DOUBLE, age)) OVER (PARTITION BY user_id ORDER BY pace, age ROWS UNBOUNDED PRECEDING) AS u, sum(pow({KEEP}::DOUBLE, age)) OVER (PARTITION BY user_id) AS t FROM few),
    hist AS (SELECT user_id, count(*) AS k, min(pace) FILTER (WHERE u >= t / 2 - 1e-12) AS past_pace, list(pace ORDER BY pace) AS l FROM upto GROUP BY user_id),
    j AS (SELECT pace.*, pace.rate AS current_pace, past_pace, CAST(coalesce(k, 0) AS INTEGER) AS comparable, l[CAST(floor((k - 1) * 0.25 + 0.5) AS INTEGER) + 1] AS past_low, l[CAST(floor((k - 1) * 0.75 + 0.5) AS INTEGER) + 1] AS past_high,
        CASE WHEN pace.rate IS NULL THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, hours / least(6.0::DOUBLE, greatest(1.0::DOUBLE, minutes / 60 * 0.1))) END AS live_weight FROM pace LEFT JOIN hist USING (user_id)),
    s AS (SELECT *, CASE WHEN stale_reason IS NOT NULL THEN 'stale' WHEN current_pace IS NULL AND past_pace IS NULL THEN 'unavailable' WHEN current_pace IS NULL THEN 'historical' WHEN past_pace IS NOT NULL AND live_weight < 1 THEN 'blended' ELSE 'current_window' END AS source FROM j),
    o AS (SELECT * REPLACE (CASE source WHEN 'historical' THEN past_pace WHEN 'blended' THEN current_pace * live_weight + past_pace * (1 - live_weight) WHEN 'current_window' THEN current_pace END AS rate) FROM s), ol AS (SELECT *, {_PROJECT_SQL} FROM o)"""


def _outlook(spark, sf_dir):
    return outlook(_readings(spark, sf_dir), ["user_id"], now=F.lit(NOW).cast("timestamp_ntz"), cadence_minutes=_CADENCE, gap_hours=_GAP, span_hours=_SPAN)


@query(f"WITH {_OUTLOOK_SQL} SELECT * FROM ol")
def quota_outlook(spark, sf_dir):
    return _outlook(spark, sf_dir)


@query(f"""WITH {_OUTLOOK_SQL}, u AS (SELECT user_id, time, reset, used, remaining, exhausted_in, CASE WHEN projected IS NOT NULL THEN 100 - projected END AS remains FROM ol),
    t AS (SELECT *, CASE WHEN remains < 0 AND remaining > 0 THEN 'short' WHEN remaining <= 0 THEN 'exhausted' WHEN coalesce(remains, remaining) < 20 THEN 'tight' ELSE 'steady' END AS tier FROM u)
    SELECT user_id, tier, remains, CAST(row_number() OVER (ORDER BY CASE tier WHEN 'short' THEN 0 WHEN 'exhausted' THEN 1 WHEN 'tight' THEN 2 ELSE 3 END, CASE WHEN tier = 'short' THEN epoch_us(time) / 3.6e9 + exhausted_in END NULLS LAST, coalesce(remains, remaining) NULLS LAST, reset, user_id) AS INTEGER) AS place
    FROM t QUALIFY place <= 25""")
def urgency_tiers(spark, sf_dir):
    """The 25 most urgent windows: one sorted list that is cut, so each task sends no more than that."""
    told = urgency(_outlook(spark, sf_dir))
    first = told.orderBy(*by_urgency(told, "user_id")).limit(25)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*by_urgency(first, "user_id")))).select("user_id", "tier", "remains", "place")


def calibrations(readings: DataFrame, keys: Sequence[str], local: DataFrame, *, least_hours: float = 2.0, least_readings: int = 3, least_points: float = 3.0, gap_hours: float = GAP_HOURS) -> DataFrame:
    """What an allowance point stands for in each spell of readings, or why it can't be told: at least two
    hours, three readings and three points, continuous, with local tokens (keys, tokens) in them."""
    keys = [*keys, "spell"]
    before = F.lag(F.struct("used", "time", "reset", "minutes")).over(Window.partitionBy(*keys).orderBy("time", "tie"))
    b = lambda c: F.col(f"before.{c}")
    continuous = b("reset").eqNullSafe(F.col("reset")) & b("minutes").eqNullSafe(F.col("minutes")) & (b("used") <= F.col("used")) & (_hours(b("time"), F.col("time")) > 0) & (_hours(b("time"), F.col("time")) <= gap_hours)
    at = F.struct("time", "tie")
    spells = readings.withColumn("before", before).withColumn("breaks", F.col("before").isNotNull() & ~F.coalesce(continuous, F.lit(False))).groupBy(*keys).agg(
        F.count("*").alias("readings"), F.bool_or("breaks").alias("broken"), (F.max_by("used", at) - F.min_by("used", at)).alias("points"), _hours(F.min("time"), F.max("time")).alias("hours")
    )
    told = spells.join(local, keys, "left")
    reason = (
        F.when(F.col("hours") < least_hours, "too_short")
        .when((F.col("readings") < least_readings) | F.col("broken"), "not_continuous")
        .when(F.col("points") < least_points, "too_few_points")
        .when(~F.coalesce(F.col("tokens") > 0, F.lit(False)), "no_local_tokens")
    )
    return told.withColumn("reason", reason).withColumn("tokens_a_point", F.when(F.col("reason").isNull(), F.col("tokens") / F.col("points")))


def baseline(found: DataFrame, keys: Sequence[str], *, most: int = 5, spread: float = 0.35) -> DataFrame:
    """The median of each key's newest baselines (start, end, confirmed, rate), at most five that don't overlap;
    null with a reason where they disagree by more than a third of it.

    A round takes the newest of each key that overlaps none taken before, and leaves out what overlaps it, so
    a key's baselines are never in one row, however many they are."""
    keys, place = list(keys), ["o", "s", "e", "rate"]
    left = found.select(*keys, (-_micros("confirmed")).alias("o"), _micros("start").alias("s"), _micros("end").alias("e"), "rate")
    taken = None
    for turn in range(most):
        best = left.groupBy(*keys).agg(F.min(F.struct(*place)).alias("t"))
        taken = best if taken is None else taken.unionByName(best)
        if turn + 1 < most:
            rest = null_safe_join(left, best, keys, "inner").where(~((F.col("s") < F.col("t.e")) & (F.col("e") > F.col("t.s"))) & (F.struct(*place) > F.col("t")))
            left = checkpointed(rest.drop("t"), "baselines")
            if left.isEmpty():
                break
    rows = taken.groupBy(*keys).agg(F.array_sort(F.collect_list("t.rate")).alias("rates"))
    n, at = F.size("rates"), lambda i: F.element_at("rates", i.cast("int"))
    middle = (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2
    wide = (at(n) - at(F.lit(1))) / F.col("middle") > spread
    return rows.withColumn("middle", middle).select(*keys, n.alias("baselines"), F.when(wide, "baselines_disagree").alias("reason"), F.when(~wide, F.col("middle")).alias("rate"))


@query(f"""WITH {_READ_SQL}, s AS (SELECT *, tie % 3 AS spell FROM r), l AS (SELECT *, lag(used) OVER w AS pu, lag(time) OVER w AS pt, lag(reset) OVER w AS pr FROM s WINDOW w AS (PARTITION BY user_id, spell ORDER BY time, tie)),
    g AS (SELECT user_id, spell, count(*) AS readings, bool_or(pt IS NOT NULL AND NOT (pr = reset AND pu <= used AND time > pt AND {_H('pt', 'time')} <= 400)) AS broken, arg_max(used, (time, tie)) - arg_min(used, (time, tie)) AS points, {_H('min(time)', 'max(time)')} AS hours FROM l GROUP BY user_id, spell),
    t AS (SELECT user_id, event_id % 3 AS spell, CAST(sum(event_id % 100) AS BIGINT) AS tokens FROM events WHERE event_type = 'click' GROUP BY ALL),
    w AS (SELECT g.*, tokens, CASE WHEN hours < 2 THEN 'too_short' WHEN readings < 3 OR broken THEN 'not_continuous' WHEN points < 3 THEN 'too_few_points' WHEN NOT coalesce(tokens > 0, false) THEN 'no_local_tokens' END AS reason FROM g LEFT JOIN t USING (user_id, spell))
    SELECT *, CASE WHEN reason IS NULL THEN tokens / points END AS tokens_a_point FROM w""")
def calibration(spark, sf_dir):
    spell = (F.col("tie") % 3).alias("spell")
    rows = _readings(spark, sf_dir).select("*", spell)
    local = table(spark, sf_dir, "events").where("event_type = 'click'").groupBy("user_id", (F.col("event_id") % 3).alias("spell")).agg(F.sum(F.col("event_id") % 100).alias("tokens"))
    return calibrations(rows, ["user_id"], local, gap_hours=400)


@query("""WITH RECURSIVE b AS (SELECT l_suppkey, l_shipdate AS s, l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS e, l_extendedprice / 50 AS rate, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate + to_days(CAST(l_quantity AS INTEGER)) DESC, l_shipdate, l_extendedprice) AS n FROM lineitem),
    f AS (SELECT l_suppkey, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(s TIMESTAMP, e TIMESTAMP, rate DOUBLE)[]) AS h FROM (SELECT DISTINCT l_suppkey FROM b)
        UNION ALL SELECT f.l_suppkey, b.n, CASE WHEN len(h) < 5 AND len(list_filter(h, lambda y: b.s < y.e AND b.e > y.s)) = 0 THEN list_append(h, {'s': b.s, 'e': b.e, 'rate': b.rate}) ELSE h END FROM f JOIN b ON b.l_suppkey = f.l_suppkey AND b.n = f.n + 1),
    t AS (SELECT l_suppkey, list_sort(list_transform(arg_max(h, n), lambda x: x.rate)) AS r FROM f GROUP BY l_suppkey), m AS (SELECT *, len(r) AS k, (r[(len(r) + 1) // 2] + r[len(r) // 2 + 1]) / 2 AS mid FROM t)
    SELECT l_suppkey, CAST(k AS INTEGER) AS baselines, CASE WHEN (r[k] - r[1]) / mid > 0.35 THEN 'baselines_disagree' END AS reason, CASE WHEN NOT (r[k] - r[1]) / mid > 0.35 THEN mid END AS rate FROM m""")
def baseline_median(spark, sf_dir):
    end = F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").alias("start"), end.alias("end"), end.alias("confirmed"), (F.col("l_extendedprice") / 50).alias("rate"))
    return baseline(rows, ["l_suppkey"])


@query(f"""WITH {_READ_SQL}, k AS (SELECT user_id, CASE user_id % 3 WHEN 0 THEN 15 WHEN 1 THEN 600 ELSE 1440 END AS cadence, arg_max(used, (time, tie)) AS used, max(time) AS time, arg_max(reset, (time, tie)) AS reset FROM r WHERE NOT history_only GROUP BY user_id)
    SELECT user_id, used, time, greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(time)) / 6e7, 0) AS age_minutes, CASE WHEN reset <= TIMESTAMP '{NOW}' THEN 'expired' WHEN (epoch_us(TIMESTAMP '{NOW}') - epoch_us(time)) / 6e7 > greatest(120, 2 * cadence + 15) THEN 'age' END AS stale_reason FROM k""")
def current_allowance(spark, sf_dir):
    """The newest reading of each key from readers that are still enabled, each with its own cadence."""
    held = _readings(spark, sf_dir).where("NOT history_only").groupBy("user_id").agg(F.max(F.struct("time", "tie", "used", "reset")).alias("n"))
    cadence = F.when(F.col("user_id") % 3 == 0, 15).when(F.col("user_id") % 3 == 1, 600).otherwise(1440)
    age, reason = freshness(F.col("n.time"), F.col("n.reset"), F.lit(NOW).cast("timestamp_ntz"), cadence)
    return held.select("user_id", "n.used", "n.time", age.alias("age_minutes"), reason.alias("stale_reason"))
