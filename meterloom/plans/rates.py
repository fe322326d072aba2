"""Prices of request groups by catalogue, period, tier and context band, and what is left unpriced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.functions import numbers, periods
from meterloom.functions.text import model_name
from meterloom.plans.registry import query, small_table
from meterloom.plans.requests import GROUPS_SQL, ZONE, groups

REASONS = ("model_not_in_catalog", "no_rate_for_event_date", "service_tier_or_context_not_priced", "legacy_total_only")
COSTS = ("input_cost", "cached_cost", "write_cost", "reasoning_cost", "other_cost")
SUMS = ("calls", "total_tokens", "input_tokens", "cached_tokens", "write_tokens", "output_tokens", "reasoning_tokens", "priced_tokens", "unpriced_tokens", "long_calls", "assumed_standard_calls", "assumed_ttl_calls", "priority_at_standard_calls")
#: The catalogue that a provider's models are sought in; those of other providers are sought in all.
PROVIDERS = {"codex": "openai", "openai_api": "openai", "claude": "anthropic", "anthropic_api": "anthropic", "xai": "xai"}

#: A catalogue of our own, since rates are data: names (catalogue, name as looked up, canonical model, write
#: multipliers), periods (model, from, until, version, alias of the priority tier), rates (model, from, tier, band).
NAMES = (("openai", "alpha", "alpha", 1.0, 2.0), ("openai", "alpha-xl", "alpha", 1.0, 2.0), ("anthropic", "beta", "beta", 1.25, 2.0), ("xai", "gamma", "gamma", 1.0, 2.0))
PERIODS = (("alpha", "0000-01-01", "1997-06-01", "a1", "priority"), ("alpha", "1995-01-01", "1997-06-01", "a2", "fast"), ("alpha", "1997-06-01", "9999-12-31", "a3", "priority"), ("beta", "1996-01-01", "9999-12-31", "b1", "standard"), ("gamma", "1993-01-01", "1998-01-01", "g1", "priority"))
RATES = (
    ("alpha", "a1", "standard", "short", 2.0, 0.5, 8.0),
    ("alpha", "a2", "standard", "short", 2.5, 0.25, 10.0),
    ("alpha", "a2", "fast", "short", 5.0, 0.5, 20.0),
    ("alpha", "a2", "standard", "long", 4.0, 0.5, 16.0),
    ("alpha", "a3", "standard", "short", 1.5, 0.125, 6.0),
    ("alpha", "a3", "priority", "short", 3.0, 0.25, 12.0),
    ("beta", "b1", "standard", "short", 3.0, 0.3, 15.0),
    ("beta", "b1", "standard", "long", 3.0, 0.3, 15.0),
    ("beta", "b1", "fast", "short", 30.0, 3.0, 150.0),
    ("gamma", "g1", "standard", "short", 0.2, 0.05, 0.5),
)
UNIT = 1_000_000


def catalogue(spark: SparkSession) -> DataFrame:
    """One row for each name that may be looked up, with its periods, and in each its rates by tier and band."""
    names = small_table(spark, NAMES, "catalog string, name string, canonical string, write_times double, write_1h_times double")
    rates = small_table(spark, RATES, "canonical string, version string, tier string, band string, input double, cached double, output double")
    held = rates.groupBy("canonical", "version").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "tier", "band"), F.struct("input", "cached", "output")))).alias("rates"))
    spans = small_table(spark, PERIODS, "canonical string, since string, until string, version string, priority_as string").join(held, ["canonical", "version"])
    listed = spans.groupBy("canonical").agg(F.array_sort(F.collect_list(F.struct("since", "until", "version", "priority_as"))).alias("periods"), F.map_from_entries(F.collect_list(F.struct("version", "rates"))).alias("by_version"))
    return names.join(listed, "canonical")


def _tier(column: str) -> tuple[Column, Column]:
    """The tier that a recorded one prices as, and whether that is an assumption."""
    tier = F.lower(F.trim(F.coalesce(column, F.lit(""))))
    assumed = tier.isin("", "unknown", "assumed_standard")
    return F.when(assumed | (tier == "default"), "standard").otherwise(tier), assumed


def priced(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows (request groups with rate_date, over_short, over_long) with the model's catalogue, the parts of
    their cost, priced and unpriced tokens, reason, and what had to be assumed.

    A name is sought as it is, then without the date at its end (Claude's alone are dated). The latest period that
    holds the date counts, the band is that of the catalogue's own threshold, and `fast` is chosen by the
    recorded speed where a catalogue prices it. How the catalogue is joined is Spark's choice, by its size."""
    listed = names
    provider = F.coalesce(*[F.when(F.col("provider") == p, c) for p, c in PROVIDERS.items()])
    sought = rows.withColumns({"_in": provider, "_name": model_name("model"), "_undated": model_name("model", dated=False)})
    sought = sought.join(listed.select(F.col("name").alias("_name"), F.struct("catalog", "canonical", "write_times", "write_1h_times", "periods", "by_version").alias("_own")), "_name", "left")
    undated = listed.where("catalog = 'anthropic'").select(F.col("name").alias("_undated"), F.struct("catalog", "canonical", "write_times", "write_1h_times", "periods", "by_version").alias("_later"))
    sought = sought.join(undated, "_undated", "left")
    fits = lambda c: F.when(F.col("_in").isNull() | (F.col(f"{c}.catalog") == F.col("_in")), F.col(c))
    found = sought.withColumn("_m", F.coalesce(fits("_own"), fits("_later"))).withColumn("catalog", F.col("_m.catalog"))
    spans = F.filter("_m.periods", lambda p: (p["since"] <= F.col("rate_date")) & (F.col("rate_date") < p["until"]))
    tier, assumed = _tier("service_tier")
    found = found.withColumns({"_p": F.try_element_at(spans, F.lit(-1)), "_tier": tier, "_assumed": assumed, "band": F.when(F.when(F.coalesce("catalog", "_in") == "anthropic", F.col("over_long")).otherwise(F.col("over_short")) & F.coalesce("catalog", "_in").isNotNull(), "long").otherwise("short")})
    found = found.withColumn("_rates", F.try_element_at("_m.by_version", F.col("_p.version")))
    has_fast = F.exists(F.map_keys("_rates"), lambda k: F.startswith(k, F.lit("fast/")))
    by_speed = F.col("catalog").isin("anthropic", "xai") & (F.lower("speed") == "fast") & has_fast
    found = found.withColumn("pricing_tier", F.when(F.col("_p").isNotNull(), F.when(F.coalesce(by_speed, F.lit(False)), "fast").when(F.col("_tier") == "priority", F.col("_p.priority_as")).otherwise(F.col("_tier"))))
    found = found.withColumn("_r", F.try_element_at("_rates", F.concat_ws("/", "pricing_tier", "band")))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    inputs = n("input_fresh") + n("input_cached") + n("input_cache_write")
    cached, written, fresh = numbers.exclusive(inputs, n("input_cached"), n("input_cache_write"))
    reasoning, other = numbers.exclusive(n("output"), n("reasoning"))
    hour = F.lower(F.coalesce("cache_write_ttl", F.lit("")))
    times = F.when((F.col("catalog") == "anthropic") & (hour == "1h"), F.col("_m.write_1h_times")).otherwise(F.col("_m.write_times"))
    good, dated = F.col("_r").isNotNull(), F.col("_p").isNotNull()
    cost = lambda tokens, rate: F.when(good, tokens / UNIT * rate).otherwise(0.0)
    calls = lambda when: F.when(F.coalesce(when, F.lit(False)), F.col("calls")).otherwise(0)
    reason = F.when(F.col("_m").isNull(), REASONS[0]).when(~dated, REASONS[1]).when(~good, REASONS[2]).when(F.col("total_tokens") > inputs + n("output"), REASONS[3])
    parts = {
        "input_tokens": inputs,
        "cached_tokens": n("input_cached"),
        "write_tokens": n("input_cache_write"),
        "output_tokens": n("output"),
        "reasoning_tokens": n("reasoning"),
        "input_cost": cost(fresh, F.col("_r.input")),
        "cached_cost": cost(cached, F.col("_r.cached")),
        "write_cost": cost(written, F.col("_r.input") * times),
        "reasoning_cost": cost(reasoning, F.col("_r.output")),
        "other_cost": cost(other, F.col("_r.output")),
        "priced_tokens": F.when(good, inputs + n("output")).otherwise(0),
        "unpriced_tokens": F.when(good, F.greatest(F.col("total_tokens") - inputs - n("output"), F.lit(0))).otherwise(F.col("total_tokens")),
        "reason": reason,
        "long_calls": calls(dated & (F.col("band") == "long")),
        "assumed_standard_calls": calls(dated & F.col("_assumed")),
        "assumed_ttl_calls": calls(good & (F.col("catalog") == "anthropic") & (written > 0) & ~hour.isin("1h", "5m")),
        "priority_at_standard_calls": calls(dated & (F.col("catalog") == "anthropic") & (F.col("_tier") == "priority")),
        "rate_version": F.col("_p.version"),
    }
    return found.withColumns(parts).drop("_in", "_name", "_undated", "_own", "_later", "_m", "_p", "_tier", "_assumed", "_rates", "_r")


def dimensions(rows: DataFrame) -> DataFrame:
    """Priced rows by model, effort and tier, unrounded: sums, tokens by reason, tiers and versions used."""
    told = lambda c, word: F.coalesce(c, F.lit(word))
    keys = [told("model", "unknown").alias("model"), told("reasoning_effort", "unknown").alias("effort"), told("service_tier", "assumed_standard").alias("tier")]
    return rows.groupBy(*keys).agg(*_sums(), F.array_sort(F.collect_set("pricing_tier")).alias("pricing_tiers"), F.array_sort(F.collect_set("rate_version")).alias("rate_versions"), *[F.sum(F.when(F.col("reason") == r, F.col("unpriced_tokens")).otherwise(0)).alias(r) for r in REASONS])


def _sums() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in SUMS], *[F.sum(F.col(c).cast("decimal(38,12)")).alias(c) for c in COSTS]]


def finished(rows: DataFrame) -> DataFrame:
    """The whole cost from its unrounded parts, then all rounded."""
    total = sum((F.col(c) for c in COSTS), F.lit(0).cast("decimal(38,12)"))
    return rows.withColumn("cost", numbers.round6(total.cast("double"))).withColumns({c: numbers.round6(F.col(c).cast("double")) for c in COSTS})


def marginals(rows: DataFrame) -> DataFrame:
    """The four marginals of the priced cross: by all three, by model, by effort, by tier (others `*`).

    The rows are reduced to the cross first; sums of sums are the sums, so its few rows alone are spread."""
    cross = dimensions(rows)
    a, b, c = F.col("model"), F.col("effort"), F.col("tier")
    agg = [*[F.sum(x).alias(x) for x in (*SUMS, *COSTS, *REASONS)], F.array_sort(F.array_distinct(F.flatten(F.collect_list("pricing_tiers")))).alias("pricing_tiers"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rate_versions")))).alias("rate_versions")]
    found = cross.groupingSets([[a, b, c], [a], [b], [c]], a, b, c).agg(F.grouping_id().alias("level"), *agg)
    return finished(found).select(*[F.coalesce(x, F.lit("*")).alias(x) for x in ("model", "effort", "tier")], F.element_at(F.create_map(F.lit(0), F.lit("all"), F.lit(3), F.lit("model"), F.lit(5), F.lit("effort"), F.lit(6), F.lit("tier")), F.col("level").cast("int")).alias("marginal"), *SUMS, *COSTS, "cost", *REASONS, F.array_join("pricing_tiers", ",").alias("pricing_tiers"), F.array_join("rate_versions", ",").alias("rate_versions"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = groups(spark, sf_dir).withColumn("rate_date", F.date_format(periods.local("slot", ZONE), "yyyy-MM-dd"))
    return priced(dated, catalogue(spark))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in row) + ")" for row in rows)


#: Priced rows as the rules have them: lookup, period, tier, band, parts.
_PRICED_SQL = f"""{GROUPS_SQL},
    names(catalog, name, canonical, wt, wt1) AS (VALUES {_values(NAMES)}), spans(canonical, since, until, version, priority_as) AS (VALUES {_values(PERIODS)}), rates(canonical, version, tier, band, i, c, o) AS (VALUES {_values(RATES)}),
    g AS (SELECT *, row_number() OVER () AS rid, strftime(slot AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}', '%Y-%m-%d') AS rate_date, lower(trim(model)) AS name, CASE provider WHEN 'codex' THEN 'openai' WHEN 'openai_api' THEN 'openai' WHEN 'claude' THEN 'anthropic' WHEN 'anthropic_api' THEN 'anthropic' END AS k,
        CASE WHEN service_tier IS NULL OR trim(lower(service_tier)) IN ('', 'unknown', 'assumed_standard', 'default') THEN 'standard' ELSE trim(lower(service_tier)) END AS t, service_tier IS NULL OR trim(lower(service_tier)) IN ('', 'unknown', 'assumed_standard') AS assumed FROM groups),
    hit AS (SELECT rid, names.*, row_number() OVER (PARTITION BY rid ORDER BY CASE WHEN names.name = g.name THEN 0 ELSE 1 END) AS nth FROM g JOIN names ON (k IS NULL OR k = catalog) AND (names.name = g.name OR (catalog = 'anthropic' AND names.name = regexp_replace(g.name, '-[0-9]{{8}}$', '')))),
    span AS (SELECT g.rid, spans.*, row_number() OVER (PARTITION BY g.rid ORDER BY since DESC) AS nth FROM g JOIN hit ON hit.rid = g.rid AND hit.nth = 1 JOIN spans ON spans.canonical = hit.canonical AND since <= rate_date AND rate_date < until),
    w AS (SELECT g.*, hit.catalog, hit.wt, hit.wt1, hit.canonical AS canon, span.version AS version, span.priority_as,
        CASE WHEN coalesce(hit.catalog, k) = 'anthropic' THEN CASE WHEN over_long THEN 'long' ELSE 'short' END WHEN coalesce(hit.catalog, k) IS NOT NULL AND over_short THEN 'long' ELSE 'short' END AS band
        FROM g LEFT JOIN hit ON hit.rid = g.rid AND hit.nth = 1 LEFT JOIN span ON span.rid = g.rid AND span.nth = 1),
    x AS (SELECT *, CASE WHEN version IS NULL THEN NULL WHEN catalog IN ('anthropic', 'xai') AND lower(speed) = 'fast' AND EXISTS (SELECT 1 FROM rates r WHERE r.canonical = canon AND r.version = w.version AND r.tier = 'fast') THEN 'fast' WHEN t = 'priority' THEN priority_as ELSE t END AS pt,
        coalesce(input_fresh, 0) + coalesce(input_cached, 0) + coalesce(input_cache_write, 0) AS inp, coalesce(output, 0) AS outp FROM w),
    y AS (SELECT x.*, r.i, r.c, r.o, least(inp, greatest(0, coalesce(input_cached, 0))) AS cc FROM x LEFT JOIN rates r ON r.canonical = canon AND r.version = x.version AND r.tier = pt AND r.band = x.band),
    z AS (SELECT *, least(greatest(0, inp - cc), greatest(0, coalesce(input_cache_write, 0))) AS cw, least(outp, greatest(0, coalesce(reasoning, 0))) AS re FROM y),
    p AS (SELECT coalesce(model, 'unknown') AS model, coalesce(reasoning_effort, 'unknown') AS effort, coalesce(service_tier, 'assumed_standard') AS tier, rate_date, catalog, pt, version, calls, total_tokens, inp AS input_tokens, coalesce(input_cached, 0) AS cached_tokens,
        coalesce(input_cache_write, 0) AS write_tokens, outp AS output_tokens, coalesce(reasoning, 0) AS reasoning_tokens,
        coalesce(greatest(0, inp - cc - cw) / 1e6 * i, 0) AS input_cost, coalesce(cc / 1e6 * c, 0) AS cached_cost, coalesce(cw / 1e6 * (i * CASE WHEN catalog = 'anthropic' AND lower(coalesce(cache_write_ttl, '')) = '1h' THEN wt1 ELSE wt END), 0) AS write_cost,
        coalesce(re / 1e6 * o, 0) AS reasoning_cost, coalesce(greatest(0, outp - re) / 1e6 * o, 0) AS other_cost,
        CASE WHEN i IS NOT NULL THEN inp + outp ELSE 0 END AS priced_tokens, CASE WHEN i IS NOT NULL THEN greatest(total_tokens - inp - outp, 0) ELSE total_tokens END AS unpriced_tokens,
        CASE WHEN canon IS NULL THEN 'model_not_in_catalog' WHEN version IS NULL THEN 'no_rate_for_event_date' WHEN i IS NULL THEN 'service_tier_or_context_not_priced' WHEN total_tokens > inp + outp THEN 'legacy_total_only' END AS reason,
        CASE WHEN version IS NOT NULL AND band = 'long' THEN calls ELSE 0 END AS long_calls, CASE WHEN version IS NOT NULL AND assumed THEN calls ELSE 0 END AS assumed_standard_calls,
        CASE WHEN i IS NOT NULL AND catalog = 'anthropic' AND cw > 0 AND lower(coalesce(cache_write_ttl, '')) NOT IN ('1h', '5m') THEN calls ELSE 0 END AS assumed_ttl_calls, CASE WHEN version IS NOT NULL AND catalog = 'anthropic' AND t = 'priority' THEN calls ELSE 0 END AS priority_at_standard_calls FROM z)"""
_SUM_SQL = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in SUMS)
_COST_SQL = ", ".join(f"floor(CAST(sum(CAST({c} AS DECIMAL(38,12))) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS {c}" for c in COSTS)
_WHOLE_SQL = "floor(CAST(" + " + ".join(f"sum(CAST({c} AS DECIMAL(38,12)))" for c in COSTS) + " AS DOUBLE) * 1e6 + 0.5) / 1e6 AS cost"
_REASON_SQL = ", ".join(f"CAST(coalesce(sum(unpriced_tokens) FILTER (WHERE reason = '{r}'), 0) AS BIGINT) AS {r}" for r in REASONS)
_LIST_SQL = "coalesce(string_agg(DISTINCT pt, ',' ORDER BY pt), '') AS pricing_tiers, coalesce(string_agg(DISTINCT version, ',' ORDER BY version), '') AS rate_versions"


@query(f"""WITH {_PRICED_SQL} SELECT coalesce(model, '*') AS model, coalesce(effort, '*') AS effort, coalesce(tier, '*') AS tier, CASE grouping_id(model, effort, tier) WHEN 0 THEN 'all' WHEN 3 THEN 'model' WHEN 5 THEN 'effort' ELSE 'tier' END AS marginal,
    {_SUM_SQL}, {_COST_SQL}, {_WHOLE_SQL}, {_REASON_SQL}, {_LIST_SQL} FROM p GROUP BY GROUPING SETS ((model, effort, tier), (model), (effort), (tier))""")
def usage_prices(spark, sf_dir):
    return marginals(_rows(spark, sf_dir))


@query(f"WITH {_PRICED_SQL} SELECT rate_date, model, {_SUM_SQL}, {_COST_SQL}, {_WHOLE_SQL}, {_REASON_SQL}, {_LIST_SQL} FROM p GROUP BY rate_date, model")
def price_series(spark, sf_dir):
    """A row for each day and model that was seen: days without one are gaps, not free."""
    found = _rows(spark, sf_dir).groupBy("rate_date", F.coalesce("model", F.lit("unknown")).alias("model"))
    sums = found.agg(*_sums(), F.array_join(F.array_sort(F.collect_set("pricing_tier")), ",").alias("pricing_tiers"), F.array_join(F.array_sort(F.collect_set("rate_version")), ",").alias("rate_versions"), *[F.sum(F.when(F.col("reason") == r, F.col("unpriced_tokens")).otherwise(0)).alias(r) for r in REASONS])
    return finished(sums)


@query(f"""WITH {_PRICED_SQL}, s AS (SELECT CAST(sum(priced_tokens) AS BIGINT) AS priced_tokens, CAST(sum(unpriced_tokens) AS BIGINT) AS unpriced_tokens, {_WHOLE_SQL}, string_agg(DISTINCT catalog, ',' ORDER BY catalog) AS catalogs FROM p)
    SELECT *, CASE WHEN priced_tokens + unpriced_tokens > 0 THEN priced_tokens / (priced_tokens + unpriced_tokens) ELSE 0 END AS coverage FROM s""")
def price_summary(spark, sf_dir):
    total = sum((F.sum(F.col(c).cast("decimal(38,12)")) for c in COSTS), F.lit(0).cast("decimal(38,12)"))
    sums = _rows(spark, sf_dir).agg(F.sum("priced_tokens").alias("priced_tokens"), F.sum("unpriced_tokens").alias("unpriced_tokens"), numbers.round6(total.cast("double")).alias("cost"), F.array_join(F.array_sort(F.collect_set("catalog")), ",").alias("catalogs"))
    both = F.col("priced_tokens") + F.col("unpriced_tokens")
    return sums.withColumn("coverage", F.when(both > 0, F.col("priced_tokens") / both).otherwise(0.0))
