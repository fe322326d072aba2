"""Envelopes of mixed records into a table for each type, all visible at once or not at all.

A batch writes each table's new rows, the records that it refuses, those that wait, and its receipts into
folders of its own number; one last file, which appears by a rename, commits them. Readers see batches up to
the newest commit. What a batch left behind that ended midway is no batch that anyone sees, and the
next try writes the same folders anew. Batches are numbered in turn and run one after the other, as
foreachBatch runs them.

A record that names another one (its route's `needs`) waits until that one is held, whatever came first, and
is refused by no one for being early."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meterloom.streaming.ingest import PART, rejected

_REFUSED = "install_id string, record_type string, payload string, reason string"
_RECEIPT = "install_id string, record_type string, received bigint, accepted bigint, duplicate bigint, refused bigint, deferred bigint, released bigint"
_KINDS = ("received", "accepted", "refused", "deferred", "released")


@dataclass(frozen=True)
class Route:
    """A type of record: its payload's columns (DDL), the keys its table is laid out by, what tells revisions apart
    (with the keys), what may not be missing, its time, and a table (names, by type) that has to hold a row (needs:
    that table's keys by our column names, in its keys' order)."""

    record_type: str
    columns: str
    keys: Sequence[str]
    revision: Sequence[str]
    required: Sequence[str]
    time: str
    names: str | None = None
    needs: Sequence[str] = field(default_factory=tuple)


def _read(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, base: str) -> int:
    """The newest batch that is visible; -1 before the first."""
    newest = _read(spark, f"{base}/commits", "batch bigint").agg(F.max("batch")).first()[0]
    return -1 if newest is None else int(newest)


def _table_schema(route: Route) -> StructType:
    return StructType.fromDDL(f"install_id string, {route.columns}, {PART} int, batch bigint")


def visible(spark: SparkSession, base: str, route: Route, upto: int | None = None) -> DataFrame:
    """The rows of a type that are committed. Batch and part are folders, so a filter on either prunes files."""
    upto = committed(spark, base) if upto is None else upto
    return _read(spark, f"{base}/tables/{route.record_type}", _table_schema(route)).where(F.col("batch") <= upto)


def receipts(spark: SparkSession, base: str) -> DataFrame:
    """batch and, for each install and type, what became of its records. received = accepted + duplicate + refused +
    deferred; released are accepted ones of earlier batches that had waited."""
    return _read(spark, f"{base}/receipts", f"{_RECEIPT}, batch bigint").where(F.col("batch") <= committed(spark, base))


def waiting(spark: SparkSession, base: str, route: Route) -> DataFrame:
    """The rows that wait for what they name."""
    last = committed(spark, base)
    return _read(spark, f"{base}/pending/{route.record_type}", _table_schema(route)).where(F.col("batch") == last).drop("batch", PART)


def first_of_each(rows: DataFrame, revision: Sequence[str]) -> DataFrame:
    """One row of each revision, by content and not by arrival: the least of its other columns, with the keys as they are."""
    others = [c for c in rows.columns if c not in revision]
    return rows.groupBy(*revision).agg(F.min(F.struct(*others)).alias("_first")).select(*revision, "_first.*").select(*rows.columns)


def sorted_out(arrived: DataFrame, held: DataFrame, revision: Sequence[str], targets: DataFrame | None = None, needs: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows that are new, rows that wait): each revision of arrived once that held has not; where `needs` is given
    those whose values are no row of `targets` (as columns of the same names) wait. None needed is no wait."""
    new = first_of_each(arrived, revision).join(held.select(*revision).distinct(), list(revision), "left_anti")
    if targets is None:
        return new, new.where("false")
    known = targets.select(*needs).distinct().withColumn("_known", F.lit(True))
    free = F.lit(False)
    for c in needs:
        free = free | F.col(c).isNull()
    marked = new.join(known, list(needs), "left").withColumn("_known", F.coalesce("_known", free))
    return marked.where("_known").select(*new.columns), marked.where("NOT _known").select(*new.columns)


def counted(**kinds: DataFrame) -> DataFrame:
    """Receipts of one type from the rows (install_id, ...) of each kind; what was received and has no other end was
    a duplicate."""
    stacked = None
    for kind in _KINDS:
        rows = kinds[kind].groupBy("install_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind)
    found = stacked.groupBy("install_id").agg(*[of(kind) for kind in _KINDS])
    return found.withColumn("duplicate", F.col("received") - F.col("accepted") - F.col("refused") - F.col("deferred"))


def ingester(base: str, routes: Sequence[Route], *, now: Callable[[], Column] = F.current_timestamp, parts: int = 64, stop_after: Callable[[str], None] = lambda step: None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for rows (install_id, record_type, payload: JSON text).

    Of a revision that comes more than once, one row stays and the others are duplicates in the receipts. Records
    of an unknown type, without a required column or from the future are refused, with the reason. Routes are
    worked on in the order of their needs, so what a batch brings together meets in it. stop_after is called
    after each table is written, with its name."""
    by_type: Mapping[str, Route] = {route.record_type: route for route in routes}
    for route in routes:
        if not re.fullmatch(r"[\w.-]+", route.record_type) or (route.names and len(by_type[route.names].keys) != len(route.needs)):
            raise ValueError(f"not a route: {route.record_type}")
    order = [r for r in routes if not r.names] + [r for r in routes if r.names]

    def part(columns: Sequence[str | Column]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")

    def put(df: DataFrame, name: str, batch_id: int, *by: str) -> None:
        df.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch_id}", partitionBy=list(by) or None)
        stop_after(name)

    def ingest(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = committed(spark, base)
        if batch_id <= last:  # tried again after its commit
            return
        batch = batch.select("install_id", "record_type", "payload").persist()
        kept = [batch]
        try:
            unknown = batch.where(~F.coalesce(F.col("record_type").isin(*by_type), F.lit(False))).withColumn("reason", F.lit("unknown_record_type"))
            refused, told = unknown, None
            for route in order:
                own = batch.where(F.col("record_type") == route.record_type).withColumn("j", F.from_json("payload", f"{route.columns}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
                names = StructType.fromDDL(route.columns).names
                rows = own.select("install_id", "record_type", "payload", F.when(F.col("j").isNull() | F.col("j._bad").isNotNull(), "not_json").alias("_fault"), *[F.col(f"j.{c}").alias(c) for c in names])
                rows = rows.withColumn("reason", F.coalesce("_fault", rejected(rows, now(), time=route.time, required=route.required)))
                bad = rows.where("reason IS NOT NULL").select("install_id", "record_type", "payload", "reason")
                good = rows.where("reason IS NULL").select("install_id", *names)
                refused = refused.unionByName(bad)
                before = _read(spark, f"{base}/pending/{route.record_type}", _table_schema(route)).where(F.col("batch") == last).select("install_id", *names)
                revision = list(dict.fromkeys([*route.keys, *route.revision]))
                both = good.withColumn("_late", F.lit(False)).unionByName(before.withColumn("_late", F.lit(True))).withColumn(PART, part(route.keys)).persist()
                kept.append(both)
                touched = [r[0] for r in both.select(PART).distinct().collect()]  # no more than `parts`
                held = visible(spark, base, route, last).where(F.col(PART).isin(touched))
                targets = None
                if route.names:
                    target = by_type[route.names]
                    asked = [r[0] for r in both.select(part(route.needs).alias("p")).distinct().collect()]
                    mine = _read(spark, f"{base}/tables/{target.record_type}", _table_schema(target)).where((F.col("batch") <= last) | (F.col("batch") == batch_id)).where(F.col(PART).isin(asked))
                    targets = mine.select(*[F.col(a).alias(b) for a, b in zip(target.keys, route.needs)])
                new, late = sorted_out(both, held, revision, targets, route.needs)
                put(new.drop("_late"), f"tables/{route.record_type}", batch_id, PART)
                put(late.drop("_late"), f"pending/{route.record_type}", batch_id, PART)
                found = counted(received=own, accepted=new.where("NOT _late"), refused=bad, deferred=late.where("NOT _late"), released=new.where("_late")).withColumn("record_type", F.lit(route.record_type))
                told = found if told is None else told.unionByName(found)
            other = unknown.groupBy("install_id", F.coalesce("record_type", F.lit("")).alias("record_type")).agg(F.count("*").alias("received")).select("*", F.col("received").alias("refused"), *[F.lit(0).cast("bigint").alias(c) for c in ("accepted", "duplicate", "deferred", "released")])
            put(refused.select("install_id", "record_type", "payload", "reason"), "refused", batch_id)
            put(told.unionByName(other).select(*StructType.fromDDL(_RECEIPT).names), "receipts", batch_id)
            # One file, which a rename makes visible.
            spark.range(1).select(F.lit("committed").alias("state")).coalesce(1).write.mode("overwrite").parquet(f"{base}/commits/batch={batch_id}")
        finally:
            for frame in kept:
                frame.unpersist()

    return ingest
