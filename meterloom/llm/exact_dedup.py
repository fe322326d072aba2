"""Exact duplicates by a content sort, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.llm.common import unused, written

#: Characters of the text that splitters are sampled from. Equal texts begin alike, and samples,
#: which the driver gathers, stay small however long texts are; a hash of the whole text orders those
#: that begin alike.
SPLITTER_CHARS = 32
#: A text is spread over lanes where it has more copies than this and than its share of all rows, so
#: at most HEAVY_SHARE texts are.
HEAVY_ROWS, HEAVY_SHARE = 64, 10_000


def normalised(text: str | Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _in_order(df: DataFrame, lanes: int, own: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns `own` of df beside its normalised texts in order: norm, the three columns that rows are
    dealt by, and begins, which holds where a text differs from the one before it."""
    norm, head, mark, lane, begins, copies = (unused(df, f"_{name}") for name in ("norm", "head", "mark", "lane", "begins", "copies"))
    docs = df.select(*own, normalised("text").alias(norm))
    docs = docs.select("*", F.substring(norm, 1, SPLITTER_CHARS).alias(head), F.xxhash64(norm).alias(mark))
    many = max(HEAVY_ROWS, df.count() // HEAVY_SHARE)
    heavy = docs.groupBy(head, mark).agg(F.count("*").alias(copies)).where(F.col(copies) > many)
    # At most HEAVY_SHARE rows of some 50 bytes.
    docs = docs.join(F.broadcast(heavy), [head, mark], "left")
    docs = docs.withColumn(lane, F.when(F.col(copies).isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(lanes))).otherwise(-1).cast("int")).drop(copies)
    order = Window.partitionBy(head, mark, lane).orderBy(norm, F.asc_nulls_last("doc_id"))
    differs = F.coalesce(F.col(norm) != F.lag(norm).over(order), F.lit(True))
    return docs.repartitionByRange(head, mark, lane).withColumn(begins, differs), [norm, head, mark, lane, begins]


def exact_duplicates(df: DataFrame, *, lanes: int = 256) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of df (doc_id, text).

    Normalised texts are dealt to ranges between sampled splitters and sorted there, on disk where
    memory does not do, so that equal ones lie next to each other; each is compared in full with the
    one before it, and where they differ a group begins. The order is that of the first characters,
    of a hash for texts that share those, and of the whole text. So that no range has to take a text
    that very many rows share, such a text has `lanes` places in the order, to which its rows are
    dealt by doc_id; the texts that begin its lanes are compared in full once more, a row a lane.

    Of equal texts the smallest doc_id stays, null ids being largest. Null counts as empty. Repeated rows
    are each counted, and of rows with the same text and doc_id one is kept. An empty table gives an
    empty table."""
    ranged, (norm, head, mark, lane, begins) = _in_order(df.select("doc_id", "text"), lanes, ["doc_id"])
    place = [head, mark, lane]
    upto = Window.partitionBy(*place).orderBy(norm, F.asc_nulls_last("doc_id")).rowsBetween(Window.unboundedPreceding, 0)
    cut = ranged.select(
        "doc_id",
        *place,
        F.sum(F.col(begins).cast("int")).over(upto).alias("run"),
        F.sha2(norm, 256).alias("text_sha256"),
        F.when(F.col(begins) & (F.col(lane) >= 0), F.col(norm)).alias("shown"),
        begins,
    )
    run = Window.partitionBy(*place, "run")
    runs = written(cut.withColumns({"keep_id": F.min("doc_id").over(run), "group_size": F.count("*").over(run)}), "runs")
    # What the lanes of a few texts hold is put together by the texts themselves.
    equal = Window.partitionBy(head, mark, "shown")
    firsts = runs.where(F.col(begins) & (F.col(lane) >= 0))
    whole = firsts.select(*place, "run", F.min("keep_id").over(equal).alias("keep_id"), F.sum("group_size").over(equal).alias("group_size"))
    in_lanes = runs.where(F.col(lane) >= 0).drop("keep_id", "group_size").join(whole, [*place, "run"])
    return runs.where(F.col(lane) < 0).unionByName(in_lanes).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col(begins) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def keep_one(df: DataFrame, *, lanes: int = 256) -> DataFrame:
    """The rows of df (doc_id, text and others) that stay, with all their columns. Of rows that
    repeat doc_id and text one stays.

    Whole rows are put in order, so those that begin a group are what stays, without a join. The
    beginnings of a text's lanes meet once more, and the smallest doc_id of them stays."""
    ranged, (norm, head, mark, lane, begins) = _in_order(df, lanes, df.columns)
    firsts = ranged.where(begins)
    first = F.row_number().over(Window.partitionBy(head, mark, norm).orderBy(F.asc_nulls_last("doc_id")))
    in_lanes = firsts.where(F.col(lane) >= 0).withColumn(begins, first == 1).where(begins)
    return firsts.where(F.col(lane) < 0).unionByName(in_lanes).select(*df.columns)
