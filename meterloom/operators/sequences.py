"""What depends on the row before: increments, series, segments, chains."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.operators.components import checkpointed
from meterloom.operators.joins import null_safe_join


def increments(df: DataFrame, keys: Sequence[str], order: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Cumulative counters as increments (d_<name>): the counters themselves where there is no row before
    or any of them fell, which is a reset."""
    window = Window.partitionBy(*keys).orderBy(*order)
    before = df.withColumn("before", F.lag(F.struct(*counters)).over(window))
    fell = F.col("before").isNull()
    for c in counters:
        fell = fell | (F.col(c) < F.col(f"before.{c}"))
    marked = before.withColumn("is_reset", fell)
    return marked.select("*", *[F.when(F.col("is_reset"), F.col(c)).otherwise(F.col(c) - F.col(f"before.{c}")).alias(f"d_{c}") for c in counters]).drop("before")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column, name: str = "island") -> DataFrame:
    """A number for each stretch of rows of a key; `breaks` holds on the first row of a new stretch and may
    use lag() over `keys` and `order`."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_breaks", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn(name, F.sum("_breaks").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_breaks")


def changed(keys: Sequence[str], order: Sequence[str], *columns: str) -> Column:
    """Whether any of the columns differs from the row before; false on the first row."""
    window = Window.partitionBy(*keys).orderBy(*order)
    found = F.lit(False)
    for c in columns:
        found = found | ~F.col(c).eqNullSafe(F.lag(c).over(window))
    return found & (F.row_number().over(window) > 1)


def gap_over(keys: Sequence[str], order: Sequence[str], time: str, seconds: int) -> Column:
    window = Window.partitionBy(*keys).orderBy(*order)
    return (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(F.col(time).cast("timestamp")).over(window))) > seconds * 1_000_000


def longest_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """The longest stretch of rows of a key on which flag holds, the earliest of equals: run_start (the
    first order column there) and run_length."""
    window = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_flag", flag.cast("int")).withColumn("_group", F.sum(1 - F.col("_flag")).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.where("_flag = 1").groupBy(*keys, "_group").agg(F.min(order[0]).alias("run_start"), F.count("*").alias("run_length"))
    return runs.groupBy(*keys).agg(F.max_by(F.struct("run_start", "run_length"), F.struct("run_length", -F.col("_group"))).alias("best")).select(*keys, "best.*")


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], *, cut: Callable[[DataFrame, str], DataFrame] = checkpointed) -> DataFrame:
    """df with running sums over each key's rows up to and with each, in an order that tells its rows apart.

    Rows are dealt to ranges of key and order, so a key with a third of all rows lies in many tasks; each task sums
    up its own part of a key, and what stood in the parts before is added, a row for each key and task. Null
    keys are a key of their own; nulls count as 0 in sums and come first in the order."""
    keys, order = list(keys), list(order)
    placed = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = placed.groupBy(*keys, "_part").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_{name}") for name in sums])
    own = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(name) for name, c in sums.items()])
    both = null_safe_join(summed, offsets, [*keys, "_part"], "inner")
    return both.select(*df.columns, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in sums])


def only_open(points: DataFrame, calls: DataFrame, keys: Sequence[str], *, at: str, opened: str, closed: str, call: str, name: str = "enclosing") -> DataFrame:
    """points with `name`, the one call that is open at their place, and `open`, how many are: null for none or several.

    A call is open behind its own place up to that of its end, or on without one. Places tell the rows of a key
    apart. What opens and closes is summed up along the places, numbers of calls too: where one is open,
    the sum is its number. No point meets a call that isn't its own."""
    keys = list(keys)
    held = calls.where(F.col(opened).isNotNull() & (F.col(closed).isNull() | (F.col(closed) > F.col(opened)))).select(*keys, F.col(opened).alias("_o"), F.col(closed).alias("_c"), F.xxhash64(F.col(call).cast("string")).cast("decimal(38,0)").alias("_n"), F.col(call).alias(name))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    nothing = F.lit(0).cast("decimal(38,0)")
    edges = held.select(*keys, F.col("_o").alias("_at"), one.alias("_d"), F.col("_n").alias("_s")).unionByName(held.where("_c IS NOT NULL").select(*keys, F.col("_c").alias("_at"), (-one).alias("_d"), (-F.col("_n")).alias("_s")))
    asked = points.select(*keys, F.col(at).alias("_at")).where("_at IS NOT NULL").distinct().select("*", none.alias("_d"), nothing.alias("_s"))
    steps = edges.unionByName(asked).groupBy(*keys, "_at").agg(F.sum("_d").alias("_d"), F.sum("_s").alias("_s"), F.count_if(F.col("_d") == 0).alias("_asked"))
    # What opens at a point's own place is not open there yet, and what closes there no longer counts.
    opens = held.groupBy(*keys, F.col("_o").alias("_at")).agg(F.count("*").alias("_new"), F.sum("_n").alias("_sum"))
    run = prefix_sums(steps, keys, ["_at"], {"_open": F.col("_d"), "_total": F.col("_s")}).where("_asked > 0")
    run = null_safe_join(run, opens, [*keys, "_at"], "left").select(*keys, "_at", (F.col("_open") - F.coalesce("_new", none)).alias("open"), (F.col("_total") - F.coalesce("_sum", nothing)).alias("_n"))
    named = null_safe_join(run, held.select(*keys, "_n", name).dropDuplicates([*keys, "_n"]), [*keys, "_n"], "left").withColumn(name, F.when(F.col("open") == 1, F.col(name)))
    told = null_safe_join(points.withColumn("_at", F.col(at)), named.drop("_n"), [*keys, "_at"], "left")
    return told.select(*points.columns, name, F.coalesce("open", none).alias("open"))
