"""Trees deeper than any bound, forests with circles, and what hangs on them, against a walk of each node."""

import random

from pyspark.sql import functions as F

from meterloom.operators.components import checkpointed
from meterloom.operators.trees import climbed, nearest_above, with_below
from meterloom.plans.collector import descendants
from meterloom.plans.evidence import depths
from meterloom.sources.exports import ancestors


def walked(parents):
    """node: (root, depth, circle, below) by walking up from each node."""
    below, found = dict.fromkeys(parents, 0), {}
    for n in parents:
        path, at = [n], parents[n]
        while at is not None and at not in path:
            path.append(at)
            at = parents[at]
        loop = path[path.index(at) :] if at is not None else []
        for a in set(path[1:]) | (set(loop) if n in loop else set()):
            below[a] += 1
        if at is None:
            found[n] = (path[-1], len(path) - 1, None)
        elif n in loop:
            found[n] = (n, 0, min(loop))
        else:
            found[n] = (at, path.index(at), None)
    return {n: (*found[n], below[n]) for n in parents}


def test_random_forests_with_circles(spark):
    rng = random.Random(5)
    for size, back in ((1, 0), (150, 0.05)):
        parents = {i: None if rng.random() < 0.1 else rng.randrange(size) if rng.random() < back else (rng.randrange(i) if i else None) for i in range(size)}
        rows = [(k, n, p) for k in ("a", "b") for n, p in parents.items()]
        found = climbed(spark.createDataFrame(rows, "k string, id int, up int"), node="id", parent="up", keys=["k"]).collect()
        assert len(found) == 2 * size
        assert {(r.id, r.root, r.depth, r.circle, r.below) for r in found} == {(n, *x) for n, x in walked(parents).items()}


def test_a_chain_of_ten_thousand(spark):
    chain = spark.range(10_000).select(F.col("id").alias("n"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"), F.lit("t").alias("k"))
    found = {r.n: r.below for r in descendants(chain, ["k"], "n", "p").where("n % 1000 = 0").collect()}
    assert found == {n: 9_999 - n for n in range(0, 10_000, 1000)}
    up = ancestors(chain.where("n = 9999").select(F.col("k").alias("trace"), F.col("p").alias("parent")), chain.select(F.col("k").alias("trace"), F.col("n").alias("id"), F.col("p").alias("parent")))
    assert up.count() == 9_999


def test_marks_repeated_rows_and_parents_outside(spark):
    rows = [("a", None, False), ("b", "a", False), ("c", "b", True), ("c", "b", False), ("d", "gone", True), ("e", "d", False), ("x", "x", True), (None, "a", True)]
    tree = spark.createDataFrame(rows, "n string, p string, m boolean")
    assert {r.n for r in with_below(tree, F.col("m"), node="n", parent="p").collect()} == {"a", "b", "x"}
    assert climbed(tree.where("false"), node="n", parent="p").count() == 0


def test_trees_of_many_blocks(spark):
    """With blocks of a few nodes each, ways and circles lead through many; ids in and without the order of parents."""
    rng = random.Random(9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for back, near in ((0, 3), (0.05, 200), (0.1, 4)):
            parents = {i: None if rng.random() < 0.03 else rng.randrange(120) if rng.random() < back else (rng.randrange(max(0, i - near), i) if i else None) for i in range(120)}
            parents |= {40: 61, 61: 40} if back else {}
            rows = [(k, n, p) for k in ("a", "b") for n, p in parents.items()]
            tree = spark.createDataFrame(rows, "k string, id int, up int")
            found = climbed(tree, node="id", parent="up", keys=["k"]).collect()
            assert len(found) == 240
            assert {(r.id, r.root, r.depth, r.circle, r.below) for r in found} == {(n, *x) for n, x in walked(parents).items()}
            told = {r.id: r.answer for r in nearest_above(tree, F.when(F.col("id") % 9 == 0, F.col("id")), node="id", parent="up", keys=["k"]).collect()}
            for n in parents:
                at, seen = n, set()
                while at is not None and at % 9 and at not in seen:
                    seen.add(at)
                    at = parents[at]
                assert told[n] == (at if at is not None and at % 9 == 0 else None)
            known = {r.id: (r.root, r.depth) for r in depths(tree.where("k = 'a'"), node="id", parent="up").collect()}
            whole = walked(parents)
            on = {n for n, x in whole.items() if x[2] is not None}
            assert known == {n: (None, None) if n in on or x[0] in on else x[:2] for n, x in whole.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_joins_take_only_what_leaves_its_block(spark):
    """A chain whose ids follow each other leaves next to nothing to the rounds of joins."""
    written = {}

    def cut(df, name):
        kept = checkpointed(df, name)
        written[name] = max(written.get(name, 0), kept.count())
        return kept

    chain = spark.range(20_000).select(F.col("id").alias("n"), F.when(F.col("id") % 200 > 0, F.col("id") - 1).alias("p"))
    found = climbed(chain, node="n", parent="p", cut=cut)
    assert found.agg(F.sum("below")).first()[0] == 100 * 199 * 100
    assert written["crossings"] < 20 and written.get("rounds", 0) < 20
