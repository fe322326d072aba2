"""Local time at the change of clocks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterloom.functions import periods

ZONE = "America/Chicago"


@pytest.mark.parametrize(
    "wall, instant",
    [
        ("2024-01-15 00:00", "2024-01-15 06:00"),
        ("2024-11-03 01:30", "2024-11-03 06:30"),  # shown twice: the earlier counts
        ("2024-03-10 02:30", "2024-03-10 08:30"),  # never shown: what follows the gap
    ],
)
def test_instants_of_wall_clocks(spark, wall, instant):
    row = spark.range(1).select(periods.instant_of(F.lit(wall).cast("timestamp_ntz"), ZONE).alias("at")).first()
    assert row.at == dt.datetime.fromisoformat(instant)


def test_days_of_23_and_25_hours(spark):
    hours = []
    for day in ("2024-03-10 12:00", "2024-11-03 12:00", "2024-06-01 12:00"):
        start = periods.day_start(F.lit(day).cast("timestamp_ntz"), ZONE)
        row = spark.range(1).select(start.alias("a"), periods.add_days(start, 1, ZONE).alias("b")).first()
        hours.append((row.b - row.a).total_seconds() / 3600)
    assert hours == [23, 25, 24]
