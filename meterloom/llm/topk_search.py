"""Exact top-k inner products by no-random-access aggregation of sorted lists.

Vectors are dealt to blocks, and within a block each dimension is a list of its components in order.
For a query, each list is read in order from the end that the query's component favours, a stretch at
a time. What a vector has from the lists in which it was met is its score so far; each other list can
add what was reached there at most, and what its far end holds at least. A vector whose upper bound lies
below the k-th best lower bound is out for good, and so is whatever was not met yet once the lists as
reached can't add up to that. Reading stops when few are left, and these get their scores in full.
Blocks answer each on its own, and the best of their answers are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.llm.common import written

_LONG = np.iinfo(np.int64)


def integer_vectors(df: DataFrame, *, scale: int = 1024) -> DataFrame:
    """vec_id and v (floor(scale * x) of each component) of the rows of df (vec_id, embedding) whose
    vectors are whole: no null vector, no null, infinite or NaN component. Rows without vec_id take no part."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole).select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of integers, exact at any size; none is further from zero than the largest long."""
    sizes = [int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) for x in (vectors, query)]
    if sizes[0] * sizes[1] * max(1, len(query)) <= _LONG.max:
        return vectors @ query
    exact = vectors.astype(object) @ query.astype(object)
    return np.array([min(max(int(s), -_LONG.max), _LONG.max) for s in exact], dtype=np.int64)


class SortedLists:
    """A block of vectors with a sorted list for each dimension."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, self.order, axis=0).astype(np.float64)

    def read(self, query: np.ndarray, k: int, *, first: int = 64, step: int = 8, few: int = 16) -> tuple[np.ndarray, int]:
        """Rows that may be among the k best for a query, at most few * k of them unless the lists had to be
        read to their ends, and the number of list entries that were read. Each stretch is `step` times as
        long as what was read before; a last one to the ends leaves nothing to bound, so its rows are
        given as they are."""
        n, lists = len(self.vectors), np.nonzero(query)[0]
        if n <= few * k or not len(lists):
            return np.arange(n), 0
        weight = query[lists].astype(np.float64)
        top, bottom = (self.values[np.where(weight > 0, a, b), lists] * weight for a, b in ((n - 1, 0), (0, n - 1)))
        # Sums are rounded; nothing that rounding may have hidden is left out.
        slack = 8 * (len(lists) + 4) * np.finfo(np.float64).eps * float(np.maximum(np.abs(top), np.abs(bottom)).sum())
        so_far, missing = np.zeros(n), np.ones((n, len(lists)))
        met, out, before, depth = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool), 0, first
        while depth < n:
            places = np.arange(before, depth)[:, None]
            at = np.where(weight > 0, n - 1 - places, places)
            rows = self.order[at, lists]
            so_far += np.bincount(rows.ravel(), (self.values[at, lists] * weight).ravel(), n)
            missing[rows, np.arange(len(lists))] = 0
            met[rows] = True
            reached = self.values[np.where(weight > 0, n - depth, depth - 1), lists] * weight
            alive = np.nonzero(met & ~out)[0]
            upper, lower = so_far[alive] + (missing[alive] @ np.column_stack([reached, bottom])).T
            bar = np.partition(lower, len(lower) - k)[len(lower) - k] - slack if len(lower) >= k else -np.inf
            out[alive[upper < bar]] = True
            alive = alive[upper >= bar]
            if reached.sum() < bar:  # whatever was not met yet
                out |= ~met
            if len(alive) <= few * k and (out | met).all():
                return alive, depth * len(lists)
            before, depth = depth, step * depth
        return np.nonzero(~out)[0], n * len(lists)


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    found = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        found[i, : len(v)] = v
    return found


_FOUND = "asker bigint, query_id bigint, vec_id bigint, score bigint, same boolean, block int, entries_read bigint, entries bigint"


def _answers(df: DataFrame, queries: DataFrame, k: int, scale: int, block_rows: int, query_rows: int) -> DataFrame:
    """For each query and block the k + 1 best rows, the query's own among them."""
    vectors = written(integer_vectors(df, scale=scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = written(integer_vectors(queries, scale=scale).withColumn("row", F.monotonically_increasing_id()), "queries")
    n_blocks, n_groups = max(1, -(-vectors.count() // block_rows)), max(1, -(-asked.count() // query_rows))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = vectors.select("vec_id", "v", dealt(n_blocks).alias("block"), everywhere(n_groups).alias("group"))
    asked = asked.select("row", "vec_id", "v", dealt(n_groups).alias("group"), everywhere(n_blocks).alias("block"))

    def run(key: tuple, rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(wanted):
            width = max(max(map(len, rows["v"])), max(map(len, wanted["v"])))
            ids, vectors = rows["vec_id"].to_numpy(), _matrix(rows["v"], width)
            lists, lengths = SortedLists(vectors), rows["v"].map(len).to_numpy()
            for asker, query_id, v, query in zip(wanted["row"], wanted["vec_id"], wanted["v"], _matrix(wanted["v"], width)):
                left, entries = lists.read(query, k + 1)
                own = scores(vectors if len(left) == len(vectors) else vectors[left], query)
                if len(own) > k + 1:
                    high = own >= np.partition(own, len(own) - k - 1)[len(own) - k - 1]
                    left, own = left[high], own[high]
                same = (ids[left] == query_id) & (lengths[left] == len(v)) & (vectors[left] == query).all(axis=1)
                best = np.lexsort((~same, ids[left], -own))[: k + 1]
                found.append((np.full(len(best), asker), np.full(len(best), query_id), ids[left][best], own[best], same[best], np.full(len(best), key[0]), np.full(len(best), entries), np.full(len(best), vectors.size)))
        columns = map(np.concatenate, zip(*found)) if found else [[]] * len(_FOUND.split(", "))
        return pd.DataFrame({c.split()[0]: x for c, x in zip(_FOUND.split(", "), columns)})

    return candidates.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInPandas(run, _FOUND)


def top_k(df: DataFrame, queries: DataFrame, *, k: int = 10, scale: int = 1024, block_rows: int = 4096, query_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (vec_id, embedding) the k other rows of df
    (vec_id, embedding) that have the highest inner products of integer components.

    The queries are rows of df: of the rows that equal a query in id and vector one is its own and is left
    out, any other is a candidate. Rows that repeat a vec_id are candidates each, and queries each with
    a ranking of its own. Ties go to the smaller vec_id. Vectors with missing components take no part; a
    shorter vector has zeros at its end. Scores are exact, and clamped to a long. Both sides are
    numbered and written, then dealt to blocks by row counts, whatever their ids, and each pair of blocks
    is a task's work: nothing is broadcast."""
    best = _answers(df, queries, k, scale, block_rows, query_rows).drop("block", "entries_read", "entries")
    first = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", F.desc("same"))
    best = best.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    own = F.min(F.when(F.col("same"), F.col("place"))).over(Window.partitionBy("asker"))
    best = best.withColumn("own", own).where(~F.col("place").eqNullSafe(F.col("own")))
    rank = (F.col("place") - F.when(F.col("own") < F.col("place"), 1).otherwise(0)).cast("int")
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def reading(df: DataFrame, queries: DataFrame, *, k: int = 10, scale: int = 1024, block_rows: int = 4096, query_rows: int = 16_384) -> DataFrame:
    """query_id, entries_read and entries: how much of the sorted lists each query read before it stopped."""
    answers = _answers(df, queries, k, scale, block_rows, query_rows)
    blocks = answers.select("asker", "query_id", "block", "entries_read", "entries").distinct()
    return blocks.groupBy("asker", "query_id").agg(F.sum("entries_read").alias("entries_read"), F.sum("entries").alias("entries")).drop("asker")
