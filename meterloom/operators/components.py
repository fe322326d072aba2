"""Connected components of pairs by alternating stars."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of this driver's tables in the shared one; it goes when the driver ends.
_OWN: list[str] = []


def _own_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="meterloom-"))
    base = context.getCheckpointDir().rstrip("/")
    if not _OWN or not _OWN[-1].startswith(base):
        _OWN.append(f"{base}/meterloom-{uuid.uuid4().hex}")
        atexit.register(_removed, context, _OWN[-1])
    return _OWN[-1]


def _removed(context: SparkContext, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have gone before us, and its folder with it
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """df cut from its lineage: written to the folder that driver and executors share and read again, so a lost
    executor costs nothing that was finished. A folder of our own serves a local session alone."""
    path = f"{_own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame, cut: Callable[[DataFrame, str], DataFrame] = checkpointed) -> DataFrame:
    """node and root (the smallest node of its component) for every node of links (a, b).

    In turns, each node ties its larger neighbours, then its smaller ones and itself, to the least
    node that it knows; that keeps components whole and ends with each node tied to its root. A turn
    is a few joins on nodes, and `cut` ends its lineage in shared storage, so none grows and no group is
    ever gathered. An empty table gives an empty table."""
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = cut(pairs, "links"), None
    while True:
        pairs = cut(_small_star(_large_star(pairs)), "stars")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v").distinct())


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    tied = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()
