"""Percentiles of groups that are larger than what is sorted, against all values in order."""

import math
import random

from meterloom.operators import aggregates


def test_ranks_of_large_and_small_groups(spark):
    rng = random.Random(3)
    groups = {"large": [rng.gauss(0, 1) for _ in range(30_000)], "ties": [float(rng.randrange(4)) for _ in range(20_000)], "small": [rng.random() for _ in range(68)], "one": [1.5], "none": [None]}
    df = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values], "k string, v double")
    shares = [("p0", 0.0), ("p50", 0.5), ("p90", 0.9), ("p999", 0.999), ("p100", 1.0)]
    found = {r.k: r for r in aggregates.nearest_rank(df, ["k"], "v", shares).collect()}
    quarter = {r.k: r.q for r in aggregates.rounded_index(df, ["k"], "v", 0.25, "q").collect()}
    assert set(found) == set(quarter) == {"large", "ties", "small", "one"}
    for k in found:
        values = sorted(groups[k])
        assert found[k].n == len(values) and all(found[k][name] == values[max(1, math.ceil(len(values) * s)) - 1] for name, s in shares)
        assert quarter[k] == values[math.floor((len(values) - 1) * 0.25 + 0.5)]


def test_groups_with_null_keys(spark):
    rows = [(k, j, float(v)) for k in ("a", None) for j in (1, None) for v in range(11)] + [("a", 1, None)]
    df = spark.createDataFrame(rows, "k string, j int, v double")
    found = aggregates.nearest_rank(df, ["k", "j"], "v", [("p50", 0.5)]).collect()
    assert sorted((str(r.k), str(r.j), r.n, r.p50) for r in found) == sorted((str(k), str(j), 11, 5.0) for k in ("a", None) for j in (1, None))
