"""The registered queries of the library, gathered from its plan modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterloom.plans import allowance, collector, content, contracts, estimates, evidence, forecast, knowledge, ledger, pages, pricing, rates, requests, reviews, revisions, scalars, scope_rule, series, settings_cases, settings_diff, span_runs, threads, tools, traces, usage  # noqa: F401  they register their queries
from meterloom.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly usage by event type: the series that most questions start from."""
    return QUERIES["usage_hourly_series"](spark, sf_dir)
