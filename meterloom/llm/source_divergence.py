"""How far the sources of a language differ in their words, by joint histograms of counts.

Terms are counted by source within each language, and those of enough documents are kept. With p a term's
smoothed share of its group in thousand millionths, two groups differ by the sum of |p - q| over
all kept terms. Shares depend on a term's two counts alone, so for each pair of sources the terms are
tallied by (count, count) and |p - q| is worked out once for each combination, times its tally.

Most cells of such a tally hold a zero, and those are never made term by term: a block of terms gives the
combinations in which both sources count, and the rest follows from each source's own histogram.
With h the tally and H a source's histogram, h(a, 0) = H(a) - sum of h(a, b) over b > 0, and h(0, 0) is the
number of kept terms less all of these, so signed tallies of the four kinds add up to the whole one."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.llm.common import written

UNIT = 1_000_000_000
#: A to Z lower-cased; what is neither a letter of ASCII nor a byte of a longer character is a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text whose terms are listed at once.
PIECE = 1 << 20
#: Entries of some 300 bytes that a task gathers before it passes on what it has, looked at after so many rows.
FLUSH_TERMS, FLUSH_ROWS = 1_000_000, 256
#: Cells (term, source) of a block on average.
BLOCK_CELLS = 100_000
#: Places of a dense tally; a source with more combinations of counts in a block is tallied by sorting.
DENSE = 1 << 22
#: Rows of a table that is broadcast, of some 100 bytes; larger ones are shuffled.
SMALL_ROWS = 100_000
_COUNTS = "lang string, source string, term string, n bigint, documents bigint"
_TALLY = "lang string, a string, b string, ca bigint, cb bigint, times bigint"


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a list for each piece; pieces end between terms."""
    flat, start = text.translate(_BYTES), 0
    while start < len(flat):
        end = flat.find(b" ", start + PIECE)
        end = len(flat) if end < 0 else end
        yield flat[start:end].split()
        start = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, added up within the task."""
    counts: dict[tuple, tuple[Counter, Counter]] = {}
    rows = 0

    def gathered() -> pa.RecordBatch:
        of_group = np.repeat(np.arange(len(counts)), [len(own) for own, _ in counts.values()])
        lang, source = (pa.array(names, pa.string()).take(pa.array(of_group)) for names in (zip(*counts) if counts else ([], [])))
        term, n, documents = [], [], []
        for own, within in counts.values():
            term += own.keys()
            n += own.values()
            documents += map(within.__getitem__, own)
        counts.clear()
        terms = pa.array(term, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([lang, source, terms, pa.array(n, pa.int64()), pa.array(documents, pa.int64())], names=["lang", "source", "term", "n", "documents"])

    for batch in batches:
        groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for group, text in zip(groups, batch.column(2)):
            own, documents = counts.setdefault(group, (Counter(), Counter()))
            within: set[bytes] = set()
            for terms in term_lists(text.as_py()):
                own.update(terms)
                within.update(terms)
            documents.update(within)
            rows += 1
            if rows % FLUSH_ROWS == 0 and sum(len(own) for own, _ in counts.values()) > FLUSH_TERMS:
                yield gathered()
    yield gathered()


def _tallied(cells: pa.Table) -> pa.Table:
    """How many terms of a block have each combination of counts, for each pair of sources that both have them."""
    names = sorted(set(cells["source"].to_pylist()))
    column = np.searchsorted(np.array(names, object), cells["source"].to_numpy())
    row = cells["term"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    values, code = np.unique(cells["n"].to_numpy(), return_inverse=True)
    order = np.lexsort((column, row))
    row, column, code, size = row[order], column[order], code[order].astype(np.int64), len(values)
    stops = np.searchsorted(row, row, side="right")
    own_cells = np.split(np.argsort(column, kind="stable"), np.searchsorted(np.sort(column), np.arange(1, len(names))))
    firsts, keys, tallies = [], [], []
    for a, own in enumerate(own_cells):
        # Of each term of this source, the cells of the sources behind it.
        behind = stops[own] - own - 1
        at = np.arange(behind.sum()) + np.repeat(own + 1 - np.cumsum(behind) + behind, behind)
        key = (column[at] * size + np.repeat(code[own], behind)) * size + code[at]
        if len(names) * size * size <= DENSE:
            met = np.bincount(key)
            key = np.flatnonzero(met)
            times = met[key]
        else:
            key, times = np.unique(key, return_counts=True)
        firsts.append(np.full(len(key), a))
        keys.append(key)
        tallies.append(times)
    first, key, times = (np.concatenate(x).astype(np.int64) for x in (firsts, keys, tallies))
    shown = pa.array(names, pa.string())
    columns = [pa.array([cells["lang"][0].as_py()] * len(key), pa.string()), shown.take(pa.array(first)), shown.take(pa.array(key // (size * size)))]
    return pa.Table.from_arrays([*columns, pa.array(values[key // size % size]), pa.array(values[key % size]), pa.array(times)], names=["lang", "a", "b", "ca", "cb", "times"])


def _share(count: str, total: str, terms: str, smooth: int) -> Column:
    """1 + floor(UNIT * (count + smooth) / (total + smooth * terms)), in whole numbers of up to 38 digits."""
    above = (F.col(count) + smooth).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", above, (F.col(total) + F.col(terms) * smooth).cast("decimal(19,0)")) + 1


def _small(df: DataFrame) -> DataFrame:
    """df, which has been written, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def kept_terms(df: DataFrame, least_documents: int) -> DataFrame:
    """lang, source, term, n and lang_n (occurrences in the group and in the language) of the terms that
    least_documents documents of the language hold, in the groups that have them."""
    docs = df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    cells = docs.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    same = Window.partitionBy("lang", "term")
    cells = cells.withColumns({"lang_n": F.sum("n").over(same), "documents": F.sum("documents").over(same)})
    return cells.where(F.col("documents") >= least_documents).drop("documents")


def _groups(df: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (occurrences of kept terms), terms (kept ones of the language) and lang_total."""
    named = df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    return named.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["total", "terms", "lang_total"])


def joint_histograms(kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, a, b, ca, cb and times for each of pairs (lang, a, b, terms; a before b): how many of the
    language's kept terms a has ca times and b has cb times, zeros included."""
    blocks = max(1, kept.count() // BLOCK_CELLS)
    placed = kept.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))
    both = placed.groupBy("lang", "block").applyInArrow(_tallied, _TALLY)
    both = written(both.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("times").alias("times")), "tallies")
    own = written(kept.groupBy("lang", "source", F.col("n").alias("c")).agg(F.count("*").alias("times")), "histograms")
    own, zero = _small(own), F.lit(0).cast("long")
    of_a, of_b = (pairs.select("lang", "a", "b").join(own.withColumnRenamed("source", side), ["lang", side]) for side in "ab")

    def signed(df: DataFrame, ca: str | None, cb: str | None, times: Column) -> DataFrame:
        return df.select("lang", "a", "b", *((F.col(c) if c else zero).alias(name) for c, name in ((ca, "ca"), (cb, "cb"))), times.alias("times"))

    once = F.col("times")
    found = signed(pairs, None, None, F.col("terms"))
    for part in (
        signed(both, "ca", "cb", once),
        signed(both, "ca", None, -once),
        signed(both, None, "cb", -once),
        signed(both, None, None, once),
        signed(of_a, "c", None, once),
        signed(of_a, None, None, -once),
        signed(of_b, None, "c", once),
        signed(of_b, None, None, -once),
    ):
        found = found.unionByName(part)
    return found.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("times").alias("times")).where("times <> 0")


def audit(df: DataFrame, *, least_documents: int = 30, smooth: int = 5, terms_shown: int = 50) -> DataFrame:
    """lang, source, part, item, value and rank for each group (lang, source) of df (text, lang, source).

    Part `pair` has a row for each other source of the language: the sum of |p - q| over the language's
    kept terms, 0 without any. Part `term` has the terms_shown terms of the group whose share is most
    above that of the whole language. Ranks go by value descending, then by item in order of UTF-8.

    Null text, lang and source count as empty, repeated rows each as a document; a text without letters has no
    terms, and its group is paired all the same; the only source of a language has no pairs. An empty table gives an empty table.

    Texts are counted where they are read; what is shuffled is a task's counts, so a source or a word that a
    third of all rows has is one row a task or so. Pairs are as many as the result has rows."""
    kept = written(kept_terms(df, least_documents), "terms")
    groups = _small(written(_groups(df, kept), "groups"))
    one, two = (groups.select("lang", F.col("source").alias(side), F.col("total").alias(f"n{side}")) for side in "ab")
    pairs = written(one.join(two, "lang").where("a < b").join(groups.select("lang", "terms").distinct(), "lang"), "pairs")
    shown = [_share("ca", "na", "terms", smooth), _share("cb", "nb", "terms", smooth)]
    values = joint_histograms(kept, pairs).join(_small(pairs), ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(F.abs(shown[0] - shown[1]) * F.col("times")).alias("value"))
    values = pairs.join(values, ["lang", "a", "b"], "left").select("lang", "a", "b", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    sides = F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_pair = values.select("lang", F.inline(sides), F.lit("pair").alias("part"), "value").withColumn("rank", F.row_number().over(order))
    above = kept.join(groups, ["lang", "source"]).withColumn("value", _share("n", "total", "terms", smooth) - _share("lang_n", "lang_total", "terms", smooth))
    above = above.where("value > 0").select("lang", "source", F.col("term").alias("item"), F.lit("term").alias("part"), "value")
    # Tasks keep terms_shown rows of a group before rows are dealt by group.
    by_term = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms_shown)
    return by_pair.unionByName(by_term).select("lang", "source", "part", "item", "value", "rank")
