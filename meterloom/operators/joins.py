"""Joins that ledgers need beside the built-in ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.operators.canonical import winner


def latest_join(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    """left with `columns` of the newest matching row of right: right is reduced to one row a key first."""
    return left.join(winner(right, keys, order, columns), list(keys), "left")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """An equality join in which null matches null. right's keys are dropped."""
    renamed = right.select([F.col(c).alias(f"right_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for c in keys:
        condition = condition & F.col(c).eqNullSafe(F.col(f"right_{c}"))
    return left.join(renamed, condition, how).drop(*[f"right_{c}" for c in keys])


def overlaps(intervals: DataFrame, points: DataFrame, keys: Sequence[str], *, start: str, end: str, from_: str, until: str, step: int) -> DataFrame:
    """Rows of both sides whose half-open ranges of whole seconds overlap, with `seconds` of overlap.

    Both sides are dealt to the steps (of `step` seconds) that they touch and joined by equality on
    step and keys; a pair counts at the step where its overlap begins, so none comes twice. A range
    of many steps costs a row for each, never a comparison with rows far from it."""
    def dealt(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.where(F.col(b) > F.col(a)).withColumn("step", F.explode(F.sequence(F.floor(F.col(a) / step), F.floor((F.col(b) - 1) / step))))

    both = dealt(intervals, start, end).join(dealt(points, from_, until), [*keys, "step"])
    begin, finish = F.greatest(start, from_), F.least(end, until)
    return both.where((begin < finish) & (F.floor(begin / step) == F.col("step"))).withColumn("seconds", finish - begin).drop("step")


def longest_prefix(df: DataFrame, path: str, roots: DataFrame, root: str, columns: Sequence[str], separator: str = "/") -> DataFrame:
    """df with `columns` of the deepest root that is its path or a directory above it; null without. Of equal roots
    the one with the least columns counts, from left to right.

    A path is compared with its own ancestors by equality, not with every root. Each distinct path is
    resolved once."""
    parts = F.split(F.col(path), separator)
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), separator).alias(root)))
    chains = df.where(F.col(path).isNotNull()).select(path).distinct().select(path, F.explode(ancestors).alias("up")).select(path, "up.*")
    found = chains.join(roots.select(root, *[c for c in columns if c != root]), root).groupBy(path).agg(F.min_by(F.struct(*columns), F.struct((-F.col("depth")).alias("up"), *columns)).alias("found"))
    return df.join(found, path, "left").select(*df.columns, *[F.col(f"found.{c}").alias(c) for c in columns])


def keyed_diff(base: DataFrame, head: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """keys and change (added, removed, changed, same) between two snapshots with one row a key.

    The two sides are stacked and grouped: one shuffle, with partial aggregation, for a full outer join."""
    side = lambda df, name: df.select(*keys, F.struct(*content).alias("content"), F.lit(name).alias("side"))
    of = lambda name: F.max(F.when(F.col("side") == name, F.col("content"))).alias(name)
    both = side(base, "base").unionByName(side(head, "head")).groupBy(*keys).agg(of("base"), of("head"))
    change = F.when(F.col("base").isNull(), "added").when(F.col("head").isNull(), "removed").when(F.col("base").eqNullSafe(F.col("head")), "same").otherwise("changed")
    return both.select(*keys, change.alias("change"))
