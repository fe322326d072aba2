"""Exact search against all inner products."""

import math
import random

from meterloom.llm import topk_search

ROW = "vec_id bigint, embedding array<float>, score string"


def brute(rows, k):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for q, a in whole:
        if q % 10 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:k]
            found += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(found)


def test_top_k(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * (0.05 if i % 3 else 1) for _ in range(12)], "x") for i in range(400)]
    rows = [(i, [float(f"{x:.4f}") for x in v], s) for i, v, s in rows]
    rows += [(400 + i, [0.5] * 12, "same") for i in range(60)] + [(500, None, ""), (510, [None] * 12, ""), (520, [math.nan] * 12, ""), (530, [math.inf] * 12, ""), (540, [0.0] * 12, ""), (550, [], "")]
    df = spark.createDataFrame(rows, ROW)
    rows = [tuple(r) for r in df.collect()]
    for block_rows, query_rows in ((4096, 512), (50, 7)):
        found = topk_search.top_k(df, df.where("vec_id % 10 = 0"), k=10, block_rows=block_rows, query_rows=query_rows).collect()
        assert sorted(map(tuple, found)) == brute(rows, 10)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0], ""), (10, [2.0], "")], ROW)
    assert sorted(map(tuple, topk_search.top_k(df, df).collect())) == [(0, 1, 10, 2 * 1024 * 1024), (10, 1, 0, 2 * 1024 * 1024)]
    assert topk_search.top_k(df.where("false"), df).count() == 0


def by_row(rows, k):
    """Every row but the query's own, repeated ids included; exact integers."""
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    found = []
    for at, (q, a) in enumerate(whole):
        if q % 10 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for n, (i, b) in enumerate(whole) if n != at)[:k]
            found += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(found)


def test_repeated_ids_are_rows_of_their_own_and_large_components_stay_exact(spark):
    rng = random.Random(8)
    draw = lambda size: [float(rng.randrange(-size, size)) for _ in range(16)]
    rows = [(i, draw(20_000)) for i in range(300)] + [(100, draw(20_000)), (100, [20_000.0] * 16), (100, [20_000.0] * 16), (7, [20_000.0] * 16), (110, draw(5))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for block_rows in (4096, 64):
        found = topk_search.top_k(df, df.where("vec_id % 10 = 0"), k=10, block_rows=block_rows).collect()
        assert sorted(map(tuple, found)) == by_row(rows, 10)
    far = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40]), (2, [-(2.0**40)])], "vec_id bigint, embedding array<double>")
    largest = 2**63 - 1
    assert sorted(map(tuple, topk_search.top_k(far, far.where("vec_id = 0")).collect())) == [(0, 1, 1, largest), (0, 2, 2, -largest)]


def test_lists_are_read_only_until_outsiders_cannot_qualify(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * 0.01 for _ in range(8)]) for i in range(3000)] + [(5000 + i, [1.0 + i / 100] * 8) for i in range(40)] + [(6000, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = df.where("vec_id = 6000")
    assert sorted(map(tuple, topk_search.top_k(df, asked).collect())) == [r for r in by_row(rows, 10) if r[0] == 6000]
    (row,) = topk_search.reading(df, asked).collect()
    assert row.entries == 8 * len(rows) and 0 < row.entries_read < row.entries / 10
