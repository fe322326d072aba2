"""Scenario estimates from model calls, composition of totals, and monthly reports where the ledger has nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.functions import numbers, periods
from meterloom.operators.canonical import winner
from meterloom.plans.registry import query, table
from meterloom.plans.requests import BUCKETS_SQL, REQUESTS_SQL, ZONE, account_months

#: Fixed values of the method: Wh a call, millilitres and litres, kilograms, and what they are compared with.
THRESHOLD_TOKENS = 50_000
WH = {"floor": 0.24, "frontier_typical": 0.34, "reasoning_heavy": 4.32, "long_context_upper": 33.0}
WATER_ML_FLOOR, LITRES_PLANNING, LITRES_UPPER = 0.26, 0.3, 1.9
KG_FLOOR, KG_GRID = 0.00003, 0.394
SHOWER_LITRES, HOME_KWH_DAY, PHONE_KWH, TREE_KG, MILE_KG = 75.70823568, 28.43835616, 0.019, 60.0, 0.393
CLASSES = {"frontier_typical": "frontier_typical", "reasoning_heavy": "high_context_per_call"}


def classified(calls: Column, raw_tokens: Column) -> tuple[Column, Column]:
    """factor and Wh a call of a whole population by its mean raw tokens a call; null without calls."""
    factor = F.when(calls > 0, F.when(raw_tokens / calls >= THRESHOLD_TOKENS, "reasoning_heavy").otherwise("frontier_typical"))
    return factor, F.when(factor == "reasoning_heavy", WH["reasoning_heavy"]).when(factor.isNotNull(), WH["frontier_typical"])


def scenarios(calls: Column, wh: Column) -> dict[str, Column]:
    """Energy, water and carbon of so many calls: the floor, at the planning factor, and the upper end."""
    planning, upper = calls * wh / 1000, calls * WH["long_context_upper"] / 1000
    return {
        "kwh_floor": calls * WH["floor"] / 1000,
        "kwh_planning": planning,
        "kwh_upper": upper,
        "litres_floor": calls * WATER_ML_FLOOR / 1000,
        "litres_planning": planning * LITRES_PLANNING,
        "litres_upper": upper * LITRES_UPPER,
        "kg_floor": calls * KG_FLOOR,
        "kg_planning": planning * KG_GRID,
        "kg_upper": upper * KG_GRID,
    }


def cohorts(months: DataFrame) -> DataFrame:
    """months (account_id, month, calls, raw_tokens, selected_calls) with their class, which the whole
    month decides, and the scenarios of the selected calls, unrounded."""
    factor, wh = classified(F.col("calls"), F.col("raw_tokens"))
    told = months.withColumns({"factor": factor, "wh": wh})
    selected = F.col("selected_calls").cast("double")
    return told.withColumns({"workload_class": F.when(F.col("factor") == "reasoning_heavy", CLASSES["reasoning_heavy"]).otherwise(F.col("factor")), **scenarios(selected, F.col("wh"))})


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole months, heavier for some accounts, of which calls after a day are selected."""
    weight = F.substring("account_id", 6, 1).cast("int") + 1
    whole = account_months(spark, sf_dir).withColumn("raw_tokens", F.col("raw_tokens") * weight)
    return whole.withColumn("selected_calls", F.floor(F.col("calls") / 2))


_NAMES = ("kwh_floor", "kwh_planning", "kwh_upper", "litres_floor", "litres_planning", "litres_upper", "kg_floor", "kg_planning", "kg_upper")
_MONTHS_SQL = f"""{REQUESTS_SQL}, {BUCKETS_SQL}, m AS (SELECT account_id, strftime(hour AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}', '%Y-%m') AS month, CAST(sum(calls) AS DOUBLE) AS calls,
        CAST(sum(total_tokens) AS DOUBLE) * (CAST(substr(account_id, 6, 1) AS INTEGER) + 1) AS raw_tokens, CAST(floor(CAST(sum(calls) AS DOUBLE) / 2) AS BIGINT) AS selected_calls FROM buckets GROUP BY 1, 2),
    k AS (SELECT *, CASE WHEN raw_tokens / calls >= 50000 THEN 'high_context_per_call' ELSE 'frontier_typical' END AS workload_class, CASE WHEN raw_tokens / calls >= 50000 THEN 4.32::DOUBLE ELSE 0.34::DOUBLE END AS wh, CAST(selected_calls AS DOUBLE) AS n FROM m),
    s AS (SELECT *, n * 0.24::DOUBLE / 1000 AS kwh_floor, n * wh / 1000 AS kwh_planning, n * 33.0::DOUBLE / 1000 AS kwh_upper, n * 0.26::DOUBLE / 1000 AS litres_floor, n * wh / 1000 * 0.3::DOUBLE AS litres_planning, n * 33.0::DOUBLE / 1000 * 1.9::DOUBLE AS litres_upper,
        n * 0.00003::DOUBLE AS kg_floor, n * wh / 1000 * 0.394::DOUBLE AS kg_planning, n * 33.0::DOUBLE / 1000 * 0.394::DOUBLE AS kg_upper FROM k)"""


@query(f"WITH {_MONTHS_SQL} SELECT account_id, month, workload_class FROM s")
def cohort_class(spark, sf_dir):
    """The class follows from a whole month's mean, whatever is selected."""
    return cohorts(_months(spark, sf_dir)).select("account_id", "month", "workload_class")


@query(f"WITH {_MONTHS_SQL} SELECT account_id, month, calls, raw_tokens, selected_calls, workload_class, wh, " + ", ".join(f"floor({c} * 1e6 + 0.5) / 1e6 AS {c}" for c in _NAMES) + " FROM s")
def env_scenarios(spark, sf_dir):
    found = cohorts(_months(spark, sf_dir))
    return found.select("account_id", "month", "calls", "raw_tokens", "selected_calls", "workload_class", "wh", *[numbers.round6(F.col(c)).alias(c) for c in _NAMES])


@query(f"""WITH {_MONTHS_SQL}, t AS (SELECT CAST(sum(CAST(kwh_planning AS DECIMAL(38,12))) AS DOUBLE) AS kwh, CAST(sum(CAST(litres_planning AS DECIMAL(38,12))) AS DOUBLE) AS litres, CAST(sum(CAST(kg_planning AS DECIMAL(38,12))) AS DOUBLE) AS kg,
        CAST(sum(CAST(kg_upper AS DECIMAL(38,12))) AS DOUBLE) AS kg_cover, CAST(sum(selected_calls) AS BIGINT) AS calls, count(*) AS cohorts FROM s)
    SELECT calls, cohorts, floor(kwh * 1e6 + 0.5) / 1e6 AS kwh, floor(litres / 75.70823568::DOUBLE * 1e6 + 0.5) / 1e6 AS showers, floor(kwh / 28.43835616::DOUBLE * 1e6 + 0.5) / 1e6 AS home_days, floor(kwh / 0.019::DOUBLE * 1e6 + 0.5) / 1e6 AS phone_charges,
        floor(kg / 60.0::DOUBLE * 1e6 + 0.5) / 1e6 AS trees, floor(kg / 0.393::DOUBLE * 1e6 + 0.5) / 1e6 AS miles, floor(calls * 0.1::DOUBLE * 1e6 + 0.5) / 1e6 AS calls_avoided, floor(kwh * 0.1::DOUBLE * 1e6 + 0.5) / 1e6 AS kwh_avoided,
        floor(litres * 0.1::DOUBLE * 1e6 + 0.5) / 1e6 AS litres_avoided, floor(kg * 0.1::DOUBLE * 1e6 + 0.5) / 1e6 AS kg_avoided, floor(kg_cover * 1e6 + 0.5) / 1e6 AS kg_to_cover FROM t""")
def scenario_comparisons(spark, sf_dir):
    """Cohorts are summed under their own classes; comparisons and what a tenth less would save come last."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,12)")).cast("double")
    total = cohorts(_months(spark, sf_dir)).agg(exact("kwh_planning").alias("kwh"), exact("litres_planning").alias("litres"), exact("kg_planning").alias("kg"), exact("kg_upper").alias("cover"), F.sum("selected_calls").alias("calls"), F.count("*").alias("cohorts"))
    kwh, litres, kg = F.col("kwh"), F.col("litres"), F.col("kg")
    found = {
        "kwh": kwh,
        "showers": litres / SHOWER_LITRES,
        "home_days": kwh / HOME_KWH_DAY,
        "phone_charges": kwh / PHONE_KWH,
        "trees": kg / TREE_KG,
        "miles": kg / MILE_KG,
        "calls_avoided": F.col("calls") * 0.1,
        "kwh_avoided": kwh * 0.1,
        "litres_avoided": litres * 0.1,
        "kg_avoided": kg * 0.1,
        "kg_to_cover": F.col("cover"),
    }
    return total.select("calls", "cohorts", *[numbers.round6(c).alias(name) for name, c in found.items()])


SEGMENTS = ("input_fresh", "input_cached", "input_cache_write", "output", "unclassified")


def composition_view(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each exclusive segment of a total: what no segment explains joins the unclassified one, and
    shares are withheld where segments exceed the total."""
    classified = sum((F.coalesce(c, F.lit(0)) for c in SEGMENTS), F.lit(0))
    told = totals.withColumn("classified", classified).withColumn("remainder", F.greatest(F.col("total_tokens") - F.col("classified"), F.lit(0))).withColumn("inconsistent", F.col("classified") > F.col("total_tokens"))
    parts = [F.struct(F.lit(c).alias("segment"), (F.coalesce(c, F.lit(0)) + (F.col("remainder") if c == "unclassified" else F.lit(0))).alias("tokens")) for c in SEGMENTS]
    rows = told.select(*keys, "total_tokens", "remainder", "inconsistent", F.inline(F.array(*parts)))
    return rows.withColumn("share", F.when(~F.col("inconsistent") & (F.col("total_tokens") > 0), F.col("tokens") / F.col("total_tokens")))


@query(f"""WITH {REQUESTS_SQL}, t AS (SELECT account_id, model, CAST(sum(total_tokens + CASE WHEN model = 'gamma' THEN -request_key % 3 * 20000 ELSE request_key % 5 END) AS BIGINT) AS total_tokens,
        {', '.join(f'CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}' for c in SEGMENTS)} FROM requests GROUP BY ALL), c AS (SELECT *, {' + '.join(SEGMENTS)} AS classified FROM t),
    s AS (""" + " UNION ALL ".join(f"SELECT account_id, model, total_tokens, greatest(total_tokens - classified, 0) AS remainder, classified > total_tokens AS inconsistent, '{c}' AS segment, {c}{' + greatest(total_tokens - classified, 0)' if c == 'unclassified' else ''} AS tokens FROM c" for c in SEGMENTS) + """)
    SELECT *, CASE WHEN NOT inconsistent AND total_tokens > 0 THEN tokens / total_tokens END AS share FROM s""")
def composition_segments(spark, sf_dir):
    from meterloom.plans.requests import requests

    off = F.when(F.col("model") == "gamma", -(F.col("request_key") % 3) * 20_000).otherwise(F.col("request_key") % 5)
    totals = requests(spark, sf_dir).groupBy("account_id", "model").agg(F.sum(F.col("total_tokens") + off).alias("total_tokens"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SEGMENTS])
    return composition_view(totals, ["account_id", "model"])


def monthly_snapshots(revisions: DataFrame, months: Sequence[str], closed: Sequence[str]) -> DataFrame:
    """For each month and subject the report that counts: of a closed month a complete one first, then the
    newest. Failed ones never do. Figures are read out of the payload; a missing one is null."""
    held = revisions.where((F.col("status") != "failed") & F.col("period_key").isin(*months))
    whole = F.col("period_key").isin(*closed) & (F.col("status") == "complete")
    best = winner(held, ["period_key", "subject_key"], [whole, "produced_at", "received_at"], ["status", "produced_at", "payload"])
    total = lambda name: F.get_json_object("payload", f"$.report.current.totals.{name}").try_cast("double")
    daily = F.from_json(F.get_json_object("payload", "$.report.current.daily"), "array<struct<date:string,total_tokens:double,calls:double>>")
    return best.select("period_key", "subject_key", "status", "produced_at", total("total_tokens").alias("total_tokens"), total("calls").alias("calls"), F.coalesce(daily, F.array()).alias("daily"))


def merged_snapshots(snapshots: DataFrame, subjects: DataFrame, covered: DataFrame, *, start: Column, end: Column, zone: str, accounts: Sequence[str]) -> DataFrame:
    """Snapshots with what of them joins the totals of a range, or the reason why nothing does.

    subjects (subject_key, account_id, source_timezone) maps reports to accounts; covered (account_id,
    month) is what the hourly ledger holds, which is never added to. A month inside the range merges whole;
    of another only whole days of the display zone can be placed, if the report's days are that zone's."""
    told = snapshots.join(subjects, "subject_key", "left").join(covered.select("account_id", F.col("month").alias("period_key"), F.lit(True).alias("_covered")), ["account_id", "period_key"], "left")
    first = periods.instant_of(F.to_date(F.concat("period_key", F.lit("-01"))), zone)
    inside = (first >= start) & (periods.month_start(first, zone, 1) <= end)
    same = F.col("source_timezone") == zone
    begin = lambda d, n=0: periods.instant_of(F.date_add(F.to_date(d["date"]), n), zone)
    days = F.filter("daily", lambda d: (begin(d) >= start) & (begin(d, 1) <= end))
    told = told.withColumn("_days", F.when(same, days))
    reason = (
        F.when(F.col("account_id").isNull(), "subject_not_mapped")
        .when(~F.col("account_id").isin(*accounts), "account_not_selected")
        .when(F.col("_covered"), "hourly_ledger_covers_month")
        .when(inside, F.lit(None))
        .when(F.col("source_timezone").isNull(), "source_timezone_unknown_whole_month_only")
        .when(~same, "source_timezone_differs_from_display")
        .when(F.size("_days") == 0, "no_whole_source_day_in_range")
    )
    told = told.withColumn("reason", reason).withColumn("merged", F.when(F.col("reason").isNotNull(), "none").when(inside & ~F.coalesce(same, F.lit(False)), "month").otherwise("days"))
    total = lambda c: F.aggregate("_days", F.lit(0.0), lambda held, d: held + F.coalesce(d[c], F.lit(0.0)))
    of = lambda c: F.when(F.col("merged") == "none", 0.0).when(inside, F.col(c)).otherwise(total(c))
    return told.select("period_key", "subject_key", "account_id", "status", "merged", "reason", of("total_tokens").alias("merged_tokens"), of("calls").alias("merged_calls"))


_START, _END = "TIMESTAMP '1996-02-11 06:00:00'", "TIMESTAMP '1996-06-20 05:00:00'"
MONTHS = ("1996-02", "1996-03", "1996-04", "1996-05", "1996-06")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyy-MM")
    day = lambda d, c: F.struct(F.concat(month, F.lit(d)).alias("date"), c.alias("total_tokens"), F.lit(1).alias("calls"))
    daily = F.array(day("-03", F.col("o_orderkey") % 1000), day("-17", F.col("o_custkey") % 500))
    totals = F.struct(F.floor("o_totalprice").alias("total_tokens"), (F.col("o_orderkey") % 50).alias("calls"))
    payload = F.to_json(F.struct(F.struct(F.struct(totals.alias("totals"), daily.alias("daily")).alias("current")).alias("report")))
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "partial").otherwise("failed")
    return table(spark, sf_dir, "orders").select(month.alias("period_key"), (F.col("o_custkey") % 24).alias("subject_key"), status.alias("status"), F.col("o_orderdate").alias("produced_at"), F.col("o_orderkey").alias("received_at"), payload.alias("payload"))


_SNAPSHOT_SQL = """r AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS period_key, o_custkey % 24 AS subject_key, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'partial' ELSE 'failed' END AS status FROM orders),
    b AS (SELECT * FROM r WHERE status <> 'failed' AND period_key BETWEEN '1996-02' AND '1996-06' QUALIFY row_number() OVER (PARTITION BY period_key, subject_key ORDER BY CASE WHEN period_key <= '1996-05' AND status = 'complete' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey DESC) = 1)"""


@query(f"WITH {_SNAPSHOT_SQL} SELECT period_key, subject_key, status, o_orderdate AS produced_at, floor(o_totalprice) AS total_tokens, CAST(o_orderkey % 50 AS DOUBLE) AS calls FROM b")
def monthly_reports(spark, sf_dir):
    return monthly_snapshots(_reports(spark, sf_dir), MONTHS, MONTHS[:-1]).drop("daily")


@query(f"""WITH {_SNAPSHOT_SQL}, m AS (SELECT *, CASE WHEN subject_key % 4 < 3 THEN 'acct-' || subject_key % 4 END AS account_id, CASE subject_key % 3 WHEN 0 THEN 'America/Chicago' WHEN 2 THEN 'Europe/Berlin' END AS tz,
        floor(o_totalprice) AS total, CAST(o_orderkey % 50 AS DOUBLE) AS calls, period_key IN ('1996-03', '1996-04', '1996-05') AS inside,
        CASE WHEN period_key = '1996-02' THEN CAST(o_custkey % 500 AS DOUBLE) WHEN period_key = '1996-06' THEN CAST(o_orderkey % 1000 + o_custkey % 500 AS DOUBLE) END AS dt, CASE WHEN period_key = '1996-02' THEN 1.0::DOUBLE WHEN period_key = '1996-06' THEN 2.0::DOUBLE END AS dc FROM b),
    w AS (SELECT *, CASE WHEN account_id IS NULL THEN 'subject_not_mapped' WHEN account_id = 'acct-2' THEN 'account_not_selected' WHEN account_id = 'acct-1' AND period_key = '1996-04' THEN 'hourly_ledger_covers_month' WHEN inside THEN NULL
        WHEN tz IS NULL THEN 'source_timezone_unknown_whole_month_only' WHEN tz <> 'America/Chicago' THEN 'source_timezone_differs_from_display' END AS reason FROM m)
    SELECT period_key, subject_key, account_id, status, CASE WHEN reason IS NOT NULL THEN 'none' WHEN inside AND tz IS DISTINCT FROM 'America/Chicago' THEN 'month' ELSE 'days' END AS merged, reason,
        CASE WHEN reason IS NOT NULL THEN 0.0::DOUBLE WHEN inside THEN total ELSE dt END AS merged_tokens, CASE WHEN reason IS NOT NULL THEN 0.0::DOUBLE WHEN inside THEN calls ELSE dc END AS merged_calls FROM w""")
def snapshot_merge(spark, sf_dir):
    key = F.col("id")
    account = F.when(key % 4 < 3, F.concat(F.lit("acct-"), (key % 4).cast("string")))
    subjects = spark.range(24).select(key.alias("subject_key"), account.alias("account_id"), F.when(key % 3 == 0, "America/Chicago").when(key % 3 == 2, "Europe/Berlin").alias("source_timezone"))
    covered = spark.createDataFrame([("acct-1", "1996-04")], "account_id string, month string")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    found = monthly_snapshots(_reports(spark, sf_dir), MONTHS, MONTHS[:-1])
    return merged_snapshots(found, subjects, covered, start=at("1996-02-11 06:00:00"), end=at("1996-06-20 05:00:00"), zone=ZONE, accounts=["acct-0", "acct-1"])
