"""Append-only ingest of envelopes and rebuilding of the winners that they touch.

Late rows need no watermark: a batch appends the revisions that are new, and the keys in it get their
winner from their whole history. What arrives twice, or in another order, gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterloom.operators.canonical import append_new, winner
from meterloom.operators.joins import null_safe_join


def _held(spark: SparkSession, path: str, schema) -> DataFrame:
    """What was appended; nothing where nothing was yet. Any other fault in reading it is an error: a ledger
    that only seems empty would get everything again."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def rejected(df: DataFrame, now: Column, *, time: str, required: Sequence[str], ahead_minutes: int = 5) -> Column:
    """The first reason for which a row is set aside; null for a good one."""
    reason = F.lit(None).cast("string")
    for c in reversed(required):
        reason = F.when(F.col(c).isNull(), f"missing_{c}").otherwise(reason)
    return F.when(F.col(time) > now + F.expr(f"INTERVAL {ahead_minutes} MINUTES"), "clock_ahead").otherwise(reason)


#: Column by whose values the ledger is laid out, a folder for each.
PART = "_part"


def _part(keys: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def appender(path: str, quarantine: str, *, revision: Sequence[str], required: Sequence[str], time: str, keys: Sequence[str] = (), now: Callable[[], Column] = F.current_timestamp, parts: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: bad rows go to quarantine, revisions that aren't held yet to path. A batch
    that is tried again appends nothing twice. The ledger lies in `parts` folders by a hash of `keys`, which
    are some of the revision's columns (all by default), and a batch reads the folders that it touches, as
    winners() of its keys does."""
    if set(keys) - set(revision):
        raise ValueError("keys have to be part of the revision")

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marked = batch.withColumn("reason", rejected(batch, now(), time=time, required=required)).withColumn(PART, _part(keys or revision, parts)).persist()
        try:
            marked.where("reason IS NOT NULL").drop(PART).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
            good = marked.where("reason IS NULL").drop("reason")
            touched = [row[0] for row in good.select(PART).distinct().collect()]  # no more than `parts`
            held = _held(spark, path, good.schema).where(F.col(PART).isin(touched))
            append_new(held, good, revision).write.mode("append").partitionBy(PART).parquet(path)
        finally:
            marked.unpersist()

    return append


def released(spark: SparkSession, quarantine: str, now: Column, *, time: str, required: Sequence[str]) -> DataFrame:
    """Rows of the quarantine for which no reason stands any more, say since the clock has caught up, as they came:
    to be appended once more, which adds none twice."""
    rows = spark.read.parquet(quarantine).drop("reason", "batch_id", "batch")
    return rows.where(rejected(rows, now, time=time, required=required).isNull())


def start(stream: DataFrame, append: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything that is available now, in batches, then an end."""
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def winners(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[Column | str], touched: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Winners of the appended revisions, of the touched keys alone where they are given. With the number of parts
    of a ledger that is laid out by these keys, only the folders of touched keys are read."""
    held = spark.read.parquet(path)
    if touched is not None:
        wanted = touched.select(*keys).distinct()
        if parts:
            held = held.where(F.col(PART).isin([row[0] for row in wanted.select(_part(keys, parts)).distinct().collect()]))
        held = null_safe_join(held, wanted, keys, "left_semi")
    return winner(held.drop(PART), keys, order)


def hourly_counts(stream: DataFrame, *, time: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Counts by hour for displays that may leave out what comes later than `late`."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), *keys, "n")
