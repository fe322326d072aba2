"""Aggregates with the ledgers' own definitions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.operators.joins import null_safe_join


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator)


def exact_sum(column: str | Column, scale: int = 6) -> Column:
    """The same double whatever the order of the rows: summed as decimals."""
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(column.cast(f"decimal(18,{scale})")).cast("double")


def at_ranks(df: DataFrame, keys: Sequence[str], value: str, wanted: Sequence[tuple[str, float, Callable[[Column], Column]]], *, accuracy: int = 10_000) -> DataFrame:
    """keys, n and, under each name of `wanted` (name, share, rank of n from 1), the value at that rank.

    An approximate percentile on either side of a share brackets the rank: what lies below is counted, and
    only values within the bracket, a few ten-thousandths of a group, are put in order. So a key with a third
    of all rows is reduced in every task before any sorts. The bracket is as wide as the approximation can
    err twice; if it still misses the rank, that is an error, not a wrong value."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    slack = 2 / accuracy
    ends = [x for _, share, _ in wanted for x in (max(0.0, share - slack), min(1.0, share + slack))]
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_v", ends, accuracy).alias("ends"))
    many = F.col("n") > accuracy
    marks = [F.struct(F.lit(i).alias("i"), rank(F.col("n")).cast("bigint").alias("rank"), F.when(many, F.col("ends")[2 * i]).alias("lo"), F.when(many, F.col("ends")[2 * i + 1]).alias("hi")) for i, (_, _, rank) in enumerate(wanted)]
    marked = null_safe_join(rows, found.select(*keys, "n", F.array(*marks).alias("marks")), keys, "inner")
    placed = F.transform(F.filter("marks", lambda m: m["hi"].isNull() | (F.col("_v") <= m["hi"])), lambda m: F.struct(m["i"].alias("i"), m["rank"].alias("rank"), F.when(m["lo"].isNull() | (F.col("_v") >= m["lo"]), F.col("_v")).alias("v")))
    counted = marked.select(*keys, "n", F.inline(placed)).groupBy(*keys, "n", "i", "rank", "v").agg(F.count("*").alias("times"))
    upto = F.sum("times").over(Window.partitionBy(*keys, "i").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    there = F.col("upto") >= F.col("rank")
    reached = counted.withColumn("upto", upto).groupBy(*keys, "n", "i", "rank").agg(F.min_by(F.when(there, F.col("v")), F.when(there, F.col("upto"))).alias("v"))
    sure = F.when(F.col("v").isNull(), F.raise_error(F.lit("a percentile lies outside its bracket")).cast(df.schema[value].dataType)).otherwise(F.col("v"))
    told = reached.withColumn("v", sure)
    return told.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("v"))).alias(name) for i, (name, _, _) in enumerate(wanted)])


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """keys, n and nearest-rank percentiles: of n values in order the one at place ceil(n * share)."""
    return at_ranks(df, keys, value, [(name, share, lambda n, s=share: F.greatest(F.ceil(n * s), F.lit(1))) for name, share in shares])


def rounded_index(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """The value at place round((n - 1) * share), half up, of those in order from 0."""
    return at_ranks(df, keys, value, [(name, share, lambda n: F.floor((n - 1) * share + 0.5) + 1)]).drop("n")


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, age: str, *, keep: float = 0.8, name: str = "median") -> DataFrame:
    """The first value, in order, at which the weights keep**age reach half of their sum. Meant for groups of
    some tens, such as past cycles: a group's rows are sorted by one task."""
    window = Window.partitionBy(*keys)
    weight = F.pow(F.lit(keep), F.col(age))
    placed = df.withColumn("weight", weight).withColumn("upto", F.sum("weight").over(window.orderBy(value, age))).withColumn("total", F.sum("weight").over(window))
    return placed.where(F.col("upto") * 2 >= F.col("total") - 1e-9).groupBy(*keys).agg(F.min(value).alias(name))


def field_coverage(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """present, partial or absent for each field and group."""
    state = lambda c: F.when(F.count(c) == F.count("*"), "present").when(F.count(c) == 0, "absent").otherwise("partial").alias(f"{c}_state")
    return df.groupBy(*keys).agg(*[state(c) for c in fields])


def state_counts(df: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """A map from each value of `kind` to its count, in order of the values, for each group."""
    counted = df.groupBy(*keys, kind).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("counts"))
