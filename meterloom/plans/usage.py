"""Usage questions over the `events` table, used as a ledger of observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.functions import periods
from meterloom.plans.registry import query, table


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n_events,
        count(DISTINCT user_id) AS n_users, max(value) AS max_value FROM events GROUP BY ALL""")
def usage_hourly_series(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy(periods.hour("ts").alias("hour"), "event_type").agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users"), F.max("value").alias("max_value"))
