"""Which revision of a key counts. Winners don't depend on the order of arrival.

A winner is an aggregate, not a sorted window: every task first reduces its own rows of a key to one, so a
key that holds a third of all rows costs no task more than its share, and nothing is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def winner(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str] | None = None) -> DataFrame:
    """The row of each key with the largest `order`, compared from left to right; nulls are smallest.
    The order has to end in something unique. `columns` beside the keys are kept, all by default."""
    kept = [c for c in (columns or df.columns) if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct(*_numbered(order))).alias("best"))
    return best.select(*keys, "best.*")


def _numbered(order: Sequence[Column | str]) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)]


def two_winners(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], evidence_order: Sequence[Column | str], evidence: Sequence[str]) -> DataFrame:
    """winner(), but with `evidence` columns (as best_<name>) from the winner by another order: one pass."""
    kept = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.max_by(F.struct(*kept), F.struct(*_numbered(order))).alias("best"),
        F.max_by(F.struct(*evidence), F.struct(*_numbered(evidence_order))).alias("proof"),
    )
    return best.select(*keys, "best.*", *[F.col(f"proof.{c}").alias(f"best_{c}") for c in evidence])


def registers(df: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str], order: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    """One row for each key with the latest row of each kind, independently (<kind>_<column>), null
    where there is none. It equals a full outer join of one winner for each kind, without the join."""
    of = lambda k: F.col(kind) == k
    aggregates = [F.max_by(F.when(of(k), F.struct(*columns)), F.when(of(k), F.struct(*_numbered(order)))).alias(f"r_{k}") for k in kinds]
    return df.where(F.col(kind).isin(*kinds)).groupBy(*keys).agg(*aggregates).select(*keys, *[F.col(f"r_{k}.{c}").alias(f"{k}_{c}") for k in kinds for c in columns])


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; each task cuts its own rows to n before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def component_max(df: DataFrame, keys: Sequence[str], counters: Sequence[str], labels: Sequence[str] = (), unknown: str = "unknown") -> DataFrame:
    """Repeated sightings of an event: each counter's maximum, each label's smallest known value."""
    known = lambda c: F.min(F.when(F.col(c) != unknown, F.col(c)))
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in counters], *[F.coalesce(known(c), F.lit(unknown)).alias(c) for c in labels])


def earliest_of_equal(df: DataFrame, content: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The earliest sighting of rows that agree in all content columns, nulls being equal to nulls."""
    others = [c for c in df.columns if c not in content]
    return df.groupBy(*content).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("first")).select(*content, "first.*")


def append_new(held: DataFrame, arrived: DataFrame, revision: Sequence[str]) -> DataFrame:
    """The rows of `arrived` whose revision key isn't held yet, each once."""
    return arrived.dropDuplicates(list(revision)).join(held.select(*revision).distinct(), list(revision), "left_anti")


def conflicts(df: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """Keys that were sent with more than one content."""
    return df.groupBy(*keys).agg(F.count_distinct(content).alias("contents")).where("contents > 1")
