"""Local days, months and slots of instants. Instants are timestamps without zone that mean UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def local(column: str | Column, zone: str) -> Column:
    """The wall clock in a zone."""
    column = F.col(column) if isinstance(column, str) else column
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), column.cast("timestamp_ntz"))


def local_day(column: str | Column, zone: str) -> Column:
    return local(column, zone).cast("date")


def local_month(column: str | Column, zone: str) -> Column:
    return F.date_format(local(column, zone), "yyyy-MM")


def hour(column: str) -> Column:
    return F.date_trunc("hour", F.col(column)).cast("timestamp_ntz")


def slot(column: str, minutes: int = 15) -> Column:
    """The start of the slot of so many minutes."""
    return F.window(F.col(column), f"{minutes} minutes").getField("start")


def calendar(bounds: DataFrame, first: str, last: str, name: str = "day") -> DataFrame:
    """Each day from the least `first` to the greatest `last`."""
    return bounds.agg(F.min(first).alias("a"), F.max(last).alias("b")).select(F.explode(F.sequence("a", "b")).alias(name))


def instant_of(wall: Column, zone: str) -> Column:
    """The instant at which a zone's clock shows `wall`: the earlier of two, and in a gap what follows it."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall.cast("timestamp_ntz"))


def day_start(instant: Column | str, zone: str) -> Column:
    return instant_of(local_day(instant, zone), zone)


def add_days(start: Column, days: int, zone: str) -> Column:
    """The start of the local day so many days on; days of 23 or 25 hours keep their length."""
    return instant_of(F.date_add(local_day(start, zone), days), zone)


def month_start(instant: Column | str, zone: str, months: int = 0) -> Column:
    return instant_of(F.add_months(F.trunc(local_day(instant, zone), "month"), months), zone)


def preset_range(preset: str, now: Column, zone: str, start: Column | None = None, end: Column | None = None, most_days: int = 400) -> tuple[Column, Column]:
    """start and end of a range that has a name, at local boundaries; null for a custom one that is empty,
    runs backwards or is longer than most_days. A custom end is never after now."""
    today = day_start(now, zone)
    if preset == "custom":
        end = F.least(end, now)
        good = (end > start) & (F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp")) <= most_days * 86_400)
        return F.when(good, start), F.when(good, end)
    if preset == "previous_month":
        return month_start(now, zone, -1), month_start(now, zone)
    return {"today": today, "last_7_days": add_days(today, -6, zone), "last_30_days": add_days(today, -29, zone), "month_to_date": month_start(now, zone)}[preset], now


def months_within(start: Column, end: Column, zone: str) -> Column:
    """yyyy-MM of each local month that a half-open range touches, oldest first."""
    first = F.trunc(local_day(start, zone), "month")
    last = F.trunc(local_day(end - F.expr("INTERVAL 1 MICROSECOND"), zone), "month")
    return F.transform(F.sequence(first, last, F.expr("INTERVAL 1 MONTH")), lambda m: F.date_format(m, "yyyy-MM"))


def periods_within(start: Column, end: Column, zone: str, hourly_days: int = 14) -> Column:
    """The aligned periods that a half-open range touches, cut to it, as an array of (start, end): hours for a range of
    up to hourly_days days, local days for a longer one. A day of the change of clocks has its own length."""
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    hour = F.expr("INTERVAL 1 HOUR")
    final = end - F.expr("INTERVAL 1 MICROSECOND")
    hours = F.transform(F.sequence(F.date_trunc("hour", start).cast("timestamp_ntz"), F.date_trunc("hour", final).cast("timestamp_ntz"), hour), lambda h: F.struct(F.greatest(h, start).alias("start"), F.least(h + hour, end).alias("end")))
    days = F.transform(F.sequence(local_day(start, zone), local_day(final, zone), F.expr("INTERVAL 1 DAY")), lambda d: F.struct(F.greatest(instant_of(d, zone), start).alias("start"), F.least(instant_of(F.date_add(d, 1), zone), end).alias("end")))
    return F.when(end > start, F.when(seconds(end) - seconds(start) <= hourly_days * 86_400, hours).otherwise(days))


def calendar_cells(month: Column) -> Column:
    """The days of a month (a date in it) in weeks from Monday on, with nulls before and after."""
    first = F.trunc(month, "month")
    ahead, count = F.weekday(first), F.dayofmonth(F.last_day(first))
    cells = F.sequence(F.lit(0), F.ceil((ahead + count) / 7).cast("int") * 7 - 1)
    return F.transform(cells, lambda i: F.when((i >= ahead) & (i < ahead + count), F.date_format(F.date_add(first, (i - ahead).cast("int")), "yyyy-MM-dd")))


def day_load(shared: Column, solo: Column, weekend: Column, workday: float = 8.0) -> list[Column]:
    """booked hours of a day, open ones (null on a weekend, never below zero) and the scale to draw them by."""
    booked = shared + solo
    return [booked.alias("booked"), F.when(~weekend, F.greatest(F.lit(0.0), workday - booked)).alias("open"), F.greatest(F.lit(workday), booked).alias("scale")]


def uuid7_seconds(column: str | Column) -> Column:
    """Seconds since 1970 that an id of version 7 was made at; null for any other text."""
    column = F.col(column) if isinstance(column, str) else column
    digits = F.substring(F.regexp_replace(column, "-", ""), 1, 12)
    return F.when((F.substring(column, 15, 1) == "7") & digits.rlike("^[0-9A-Fa-f]{12}$"), F.conv(digits, 16, 10).cast("bigint") / 1000)
