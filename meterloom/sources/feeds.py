"""Feeds of resets that others publish, as items of one shape: an archive and a status document each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How much of a feed is read, and the words that its records may have.
MOST_ITEMS = 1000
KINDS, SOURCES = ("regular", "banked", "compensation", "mixed"), ("x_post", "observed")


def _text(v: Column, path: str, longest: int = 1200) -> Column:
    own = F.try_variant_get(v, path, "variant")
    return F.substring(F.trim(F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get(v, path, "string"))), 1, longest)


def _time(v: Column, path: str) -> Column:
    return F.try_to_timestamp(_text(v, path))


def _true(v: Column, path: str) -> Column:
    own = F.try_variant_get(v, path, "variant")
    return F.coalesce((F.schema_of_variant(own) == "BOOLEAN") & F.try_variant_get(v, path, "boolean"), F.lit(False))


def reset_item(v: Column, announcements: Column, pending: bool = False) -> Column:
    """A record as an item; null where it is none: without id, time and title, of an unknown kind or source, or with a link
    that is not https or names a user. An archive tells what was said, never that a window was reset."""
    kind, source, scope = _text(v, "$.kind"), _text(v, "$.sourceKind"), _text(v, "$.scope", 100)
    name, said, link = _text(v, "$.title.en"), _text(v, "$.summary.en"), _text(v, "$.sourceUrl", 2048)
    regular = kind == "regular"
    fits = kind.isin(*KINDS) & source.isin(*SOURCES) & link.rlike(r"(?i)^https://[^/?#@\s]+(?:[/?#]\S*)?$") & (_text(v, "$.id", 160) != "") & _time(v, "$.announcedAt").isNotNull() & (name != "")
    status = F.lit("pending announcement") if pending else F.when(source == "observed", "archive observation").when(~regular, "announced credits").when(announcements, "reset announcement").otherwise("reported reset")
    item = F.struct(
        _text(v, "$.id", 160).alias("id"),
        F.when(said != "", F.concat(name, F.lit("\n"), said)).otherwise(name).alias("title"),
        _time(v, "$.announcedAt").cast("timestamp_ntz").alias("announced_at"),
        link.alias("url"),
        F.when(F.lit(pending) | announcements | ~regular, "announcement").otherwise("history").alias("category"),
        F.when(kind == "banked", "banked").when(~regular, "credits").when(scope == "broad", "global").otherwise("reset").alias("reset_kind"),
        F.concat_ws(":", source, kind).alias("source_type"),
        status.alias("status"),
        F.nullif(scope, F.lit("")).alias("scope"),
    )
    return F.when(F.coalesce(fits, F.lit(False)), item)


def reset_items(feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, problems) of feeds (feed, announcements: boolean, archive and status: JSON text).

    The first MOST_ITEMS records of an archive count, the newest one of its status, and what is scheduled. Of an id that
    comes again the last record counts. A feed whose documents have another shape, or a record that is no
    item, is a problem as a whole; a scheduled one of another shape is a gap that is told, and the rest stands. Feeds
    of announcements leave observed records out. checked_at is the earlier look of both documents."""
    a, s = F.try_parse_json("archive"), F.try_parse_json("status")
    held = feeds.select("feed", F.coalesce("announcements", F.lit(False)).alias("announcements"), a.alias("a"), s.alias("s"))
    has_plan = F.coalesce(F.map_contains_key(F.try_variant_get("s", "$", "map<string,variant>"), F.lit("scheduled")), F.lit(False))
    whole = F.try_variant_get("a", "$.data", "array<variant>")
    checked = F.least(_time(F.col("a"), "$.meta.checked_at"), _time(F.col("s"), "$.meta.checked_at"))
    both = _time(F.col("a"), "$.meta.checked_at").isNotNull() & _time(F.col("s"), "$.meta.checked_at").isNotNull()
    plan = F.try_variant_get("s", "$.scheduled", "variant")
    planned = plan.isNotNull() & (F.to_json(plan) != "null")
    fresh = _true(F.col("a"), "$.meta.fresh") & _true(F.col("s"), "$.meta.fresh") & ~_true(F.col("a"), "$.meta.saved_snapshot") & ~_true(F.col("s"), "$.meta.saved_snapshot")
    newest = F.try_variant_get("s", "$.latest_update", "variant")
    records = F.filter(F.concat(F.slice(whole, 1, MOST_ITEMS), F.array(newest)), lambda v: v.isNotNull() & ~F.to_json(v).isin("null", "false", "0", '""'))
    records = F.filter(records, lambda v: ~(F.col("announcements") & F.coalesce(_text(v, "$.sourceKind") == "observed", F.lit(False))))
    read = held.withColumns({"records": records, "fault": F.when(~both | whole.isNull() | ~has_plan, "schema_changed"), "checked_at": checked.cast("timestamp_ntz"), "stale": ~fresh, "plan": F.when(planned, plan)})
    read = read.withColumn("items", F.transform("records", lambda v: reset_item(v, F.col("announcements")))).withColumn("pending", F.when(F.col("plan").isNotNull(), reset_item(F.col("plan"), F.lit(True), pending=True)))
    fault = F.coalesce("fault", F.when(F.exists("items", lambda x: x.isNull()), "schema_changed"))
    read = read.withColumn("fault", fault)
    problems = read.where("fault IS NOT NULL").select("feed", F.col("fault").alias("problem")).unionByName(read.where("fault IS NULL AND plan IS NOT NULL AND pending IS NULL").select("feed", F.lit("pending_unavailable").alias("problem")))
    good = read.where("fault IS NULL").select("feed", "checked_at", "stale", F.posexplode(F.when(F.col("pending").isNotNull(), F.array_append("items", F.col("pending"))).otherwise(F.col("items"))).alias("at_place", "item"))
    last = good.groupBy("feed", F.col("item.id").alias("id")).agg(F.max_by(F.struct("checked_at", "stale", "item"), "at_place").alias("x"))
    return last.select("feed", "x.item.*", "x.checked_at", "x.stale"), problems
