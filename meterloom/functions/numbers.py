from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round6(column: Column) -> Column:
    """Six decimals, halves towards plus infinity."""
    return F.floor(column * 1e6 + 0.5) / 1e6


def exclusive(total: Column, *parts: Column) -> list[Column]:
    """Parts cut so that none is below zero and together they don't exceed the total, and the rest."""
    left, found = total, []
    for part in parts:
        cut = F.greatest(F.least(part, left), F.lit(0))
        found.append(cut)
        left = left - cut
    return [*found, left]


def non_negative(column: Column) -> Column:
    """A counter: whole, and 0 where it is missing or below zero."""
    return F.coalesce(F.when(column >= 0, F.floor(column.cast("double")).cast("bigint")), F.lit(0).cast("bigint"))


def components(provider: Column, usage: str) -> list[Column]:
    """fresh, cached, cache_write and output tokens of a usage struct, exclusive of each other. One
    provider counts cached and written input within its input, the others beside it."""
    c = lambda name: non_negative(F.col(f"{usage}.{name}"))
    inside = provider == "codex"
    cached = F.when(inside, c("cached_input_tokens")).otherwise(c("cache_read_input_tokens"))
    written = F.when(inside, c("cache_write_input_tokens")).otherwise(c("cache_creation_input_tokens"))
    fresh = F.when(inside, F.greatest(c("input_tokens") - cached - written, F.lit(0))).otherwise(c("input_tokens"))
    return [fresh.alias("fresh"), cached.alias("cached"), written.alias("cache_write"), c("output_tokens").alias("output")]


def tolerant_int(text: Column) -> Column:
    """A whole number out of its text: digits, or a decimal whose fraction is zero; null for anything else."""
    trimmed = F.trim(text)
    whole = F.when(trimmed.rlike(r"^-*\d+$"), trimmed.try_cast("bigint"))
    return F.coalesce(whole, F.when(trimmed.rlike(r"^-?\d+\.0*$"), trimmed.try_cast("double").try_cast("bigint")))
