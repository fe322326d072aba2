"""Lines that many documents share, dropped from all but one of them, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import numbered, written

#: Stripped at both ends of a line.
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that are looked up by broadcast: those with more than the HEAVY_KEYS-th part of all shared lines,
#: so at most so many, of some 50 bytes each.
HEAVY_KEYS = 100_000
_HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A to Z lower-cased. lower() takes the same letters where
    all are ASCII, and a line of other letters goes through the slower translate()."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _looked_up(lines: DataFrame, keys: DataFrame, count: str) -> DataFrame:
    """Rows of lines joined with the table `keys` by their hashes. A key with a large share of all rows would
    be one task of a shuffle, so those are sent to the rows; the others have few rows each, and where
    none can be left no shuffle is planned."""
    total, least = keys.agg(F.sum(count), F.min(count)).first()
    bound = (total or 0) // HEAVY_KEYS
    found = lines.join(F.broadcast(keys.where(F.col(count) > bound)), _HASH)
    if least is None or least > bound:
        return found
    return found.unionByName(lines.join(keys.where(F.col(count) <= bound).hint("shuffle_hash"), _HASH))


def shared_lines(docs: DataFrame, row: str, *, least_chars: int, least_documents: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: where lines stand (row, doc_id, pos, h1, h2) whose key may be shared, and the keys that
    are (h1, h2, documents, last: the largest doc_id).

    Keys are told apart by two 64-bit hashes. Lines are counted by key first, where tasks add up their own;
    only those met least_documents times at all are looked at by document."""
    line = F.col("line")
    lines = docs.select(F.col(row).alias("row"), "doc_id", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.where(F.length(F.btrim(line, F.lit(BLANK))) >= least_chars).withColumn("key", line_key(line))
    lines = lines.select("row", "doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    met = written(lines.groupBy(_HASH).agg(F.count("*").alias("met")).where(F.col("met") >= least_documents), "line-keys")
    placed = written(_looked_up(lines, met, "met").drop("met"), "line-places")
    within = placed.groupBy("row", "doc_id", *_HASH).agg(F.count("*").alias("times"))
    keys = within.groupBy(_HASH).agg(F.count("*").alias("documents"), F.sum("times").alias("times"), F.max("doc_id").alias("last"))
    return placed, written(keys.where(F.col("documents") >= least_documents), "line-shared")


def drop_shared_lines(df: DataFrame, *, least_chars: int = 40, least_documents: int = 5) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped and kept (the text that stays) for each row of df
    (doc_id, text).

    A text is split at \\n; a null or empty one is one empty line. Lines are equal where they are so
    without white space at their ends and with A to Z lower-cased. A line of at least least_chars
    code points that least_documents documents hold stays in the one with the largest doc_id, however
    often it stands there, and goes from all others. Rows are documents: repeated rows count each, and rows
    that share the largest doc_id keep the line alike. A null doc_id is smaller than any; a line that only
    such rows hold stays in them. An empty table gives an empty table.

    Places of dropped lines meet their document by row, whose other lines are put together in order:
    a set difference of places, so a text of very many lines takes time in proportion."""
    docs, row = numbered(df.select("doc_id", "text"))
    placed, keys = shared_lines(docs, row, least_chars=least_chars, least_documents=least_documents)
    goes = _looked_up(placed, keys, "times").where(~F.col("doc_id").eqNullSafe(F.col("last")))
    places = goes.groupBy("row").agg(F.collect_list("pos").alias("places"))
    lines = _lines(F.col("text"))
    found = docs.select(F.col(row).alias("row"), "doc_id", "text").join(places.hint("shuffle_hash"), "row", "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "places")
    return found.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")).alias("kept"),
    )
