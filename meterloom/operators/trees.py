"""Trees of any depth: within blocks of nodes in memory, between them by pointers that double their reach. A round
is two equality joins, and a chain of a million nodes takes twenty at most. No path and no set of a node's
descendants is ever held."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.operators.components import checkpointed

Cut = Callable[[DataFrame, str], DataFrame]


def climbed(tree: DataFrame, *, node: str, parent: str, keys: Sequence[str] = (), weight: Column | None = None, cut: Cut = checkpointed) -> DataFrame:
    """keys, node, root, depth, circle and below for each node of tree, which is told apart within keys.

    below is the sum of `weight` (1 by default; of a node's rows the largest) over all that lies below a node.
    A parent that is no node of the tree counts as none; of a node's several parents the least one counts.
    Parents that lead round in a circle have no root: a node of a circle has its least node as `circle`,
    is its own root at depth 0, and all of the circle with what hangs on it, itself included, lies
    below it. What hangs on a circle has the node that it hangs on as its root.

    Rows without parent can't share a node with null ids: null nodes are left out."""
    keys = list(keys)
    heavy = F.max(F.lit(1) if weight is None else weight).cast("bigint").alias("w")
    nodes = _nodes(tree, keys, node, parent, heavy)
    kind = nodes.schema["n"].dataType
    closed, left = solved(nodes, keys, cut)
    shown = [F.col("n").alias(node), "root", "depth"]
    below, none = F.col("s") - F.col("w"), F.lit(None).cast(kind).alias("circle")
    found = closed.select(*keys, *shown, none, below.alias("below"))
    if left is None:
        return found
    rings = left.where("ring IS NOT NULL")
    least = rings.groupBy(*keys, "ring").agg(F.min("n").alias("circle"))
    on = rings.join(least, [*keys, "ring"]).select(*keys, "n", F.lit(None).cast(kind).alias("p"), "w", "circle")
    hung, _ = solved(on.unionByName(left.where("ring IS NULL").select(*keys, "n", "p", "w", none)), keys, cut)
    whole = hung.where("circle IS NOT NULL").groupBy(*keys, "circle").agg(F.sum("s").alias("all"))
    around = hung.where("circle IS NOT NULL").join(whole, [*keys, "circle"]).select(*keys, *shown, "circle", F.col("all").alias("below"))
    return found.unionByName(hung.where("circle IS NULL").select(*keys, *shown, "circle", below.alias("below"))).unionByName(around)


def _nodes(tree: DataFrame, keys: list[str], node: str, parent: str, *more: Column) -> DataFrame:
    """keys, n, p and more, a row for each node. Nodes without all of their keys have no parent."""
    rows = tree.where(F.col(node).isNotNull()).groupBy(*keys, F.col(node).alias("n")).agg(F.min(parent).alias("p"), *more)
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    return rows.withColumn("p", F.when(whole, F.col("p").try_cast(rows.schema["n"].dataType)))


def solved(nodes: DataFrame, keys: list[str], cut: Cut) -> tuple[DataFrame, DataFrame | None]:
    """nodes (keys, n, p, w and more, a row each) that have a root, with root, depth and s, the sum of w over a node and
    all below it; and those that have none, if there are any, with `ring`, one name for each circle, on its nodes.

    Nodes lie in blocks by ranges of their ids, as many as an Arrow batch has. Within its block a node goes up to
    its top in memory; tops whose parent lies elsewhere, and those alone, go on by doubling joins. What comes from below
    a block is added where it comes in, and each block is summed up again. Ids without any order leave
    nearly all nodes to the joins, ids that follow their parents next to none."""
    own, above = F.xxhash64(*keys, "n"), F.xxhash64(*keys, "p")
    ranged = nodes.withColumns({"_own": own, "_above": above}).repartitionByRange(*keys, "n").sortWithinPartitions(*keys, "n")
    kind = nodes.schema["n"].dataType
    held = T.StructType([*nodes.schema.fields, *[T.StructField(c, T.LongType()) for c in ("block", "at", "up", "dist", "s")], T.StructField("top", kind)])
    placed = cut(ranged.mapInArrow(lambda batches: _placed(batches, keys), held), "blocks")
    ends = placed.where("up < 0 AND p IS NOT NULL").select(*keys, "n", "p", "s")
    met = placed.select(*keys, F.col("n").alias("p"), F.col("top").alias("u"), (F.col("dist") + 1).alias("length"))
    edges = cut(ends.join(met, [*keys, "p"]), "crossings")
    if edges.isEmpty():
        return placed.withColumnRenamed("top", "root").withColumnRenamed("dist", "depth").select(*nodes.columns, "root", "depth", "s"), None
    closed, left = _rounds(edges, keys, cut)
    none, no = F.lit(None).cast(kind), F.lit(None).cast("bigint")
    told = closed.select(*keys, "n", "root", "depth", no.alias("more"), none.alias("ring"), F.lit(False).alias("lost"), F.lit(0).alias("mark"))
    enter = closed.select(*keys, F.col("p").alias("n"), none.alias("root"), no.alias("depth"), F.col("s").alias("more"), none.alias("ring"), F.lit(False).alias("lost"), F.lit(0).alias("mark"))
    notes = told.unionByName(enter)
    if left is not None:
        rings = left.join(_rings(left, keys, cut), [*keys, "n"], "left")
        gone = lambda n, ring, lost, mark: rings.select(*keys, F.col(n).alias("n"), none.alias("root"), no.alias("depth"), no.alias("more"), ring.alias("ring"), F.lit(lost).alias("lost"), mark.alias("mark"))
        notes = notes.unionByName(gone("n", F.col("ring"), True, F.lit(0))).unionByName(gone("p", none, False, F.col("ring").isNotNull().cast("int")))
    notes = cut(notes.groupBy(*keys, "n").agg(F.max("root").alias("_root"), F.max("depth").alias("_depth"), F.sum("more").alias("_more"), F.max("ring").alias("_ring"), F.max("lost").alias("_lost"), F.max("mark").alias("_mark")), "notes")
    both = placed.drop("top", "dist", "s").join(notes, [*keys, "n"], "left").select(*nodes.columns, "block", "at", "up", "_root", "_depth", "_more", "_ring", "_lost", "_mark")
    full = T.StructType([*nodes.schema.fields, T.StructField("root", kind), T.StructField("depth", T.LongType()), T.StructField("s", T.LongType()), T.StructField("lost", T.BooleanType()), T.StructField("ring", kind)])
    names = nodes.columns
    filled = both.groupBy("block").applyInArrow(lambda block: _filled(block, names), full)
    if left is None:
        return filled.drop("lost", "ring"), None
    filled = cut(filled, "filled")
    return filled.where("NOT lost").drop("lost", "ring"), filled.where("lost").select(*names, "ring")


def _tops(up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last place that each place comes to, and how far it is, where no path is endless."""
    at = np.arange(len(up))
    top, dist = np.where(up < 0, at, up), (up >= 0).astype(np.int64)
    while True:
        further = top[top]
        if (further == top).all():
            return top, dist
        dist, top = dist + dist[top], further


def _opened(up: np.ndarray) -> np.ndarray:
    """up without the step of the first place of each circle."""
    at = np.arange(len(up))
    last = np.where(up < 0, at, up)
    least = at
    for _ in range(max(len(up), 1).bit_length()):
        least, last = np.minimum(least, least[last]), last[last]
    on = np.unique(last[up[last] >= 0])
    opened = up.copy()
    opened[on[least[on] == on]] = -1
    return opened


def _sums(up: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of weight over each place and all below it, where no path is endless."""
    total, above = weight.astype(np.int64), up
    while (going := above >= 0).any():
        more = np.zeros_like(total)
        np.add.at(more, above[going], total[going])
        total, above = total + more, np.where(going, above[above], -1)
    return total


def _placed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    for number, batch in enumerate(batches):
        if not batch.num_rows:
            continue
        n, p = batch.column("n"), batch.column("p")
        own, above = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_own", "_above"))
        order = np.argsort(own, kind="stable")
        found = order[np.minimum(np.searchsorted(own[order], above), len(own) - 1)]
        # A hash only tells where to look.
        same = pc.fill_null(pc.equal(n.take(pa.array(found)), p), False)
        for key in keys:
            column = batch.column(key)
            same = pc.and_(same, pc.fill_null(pc.equal(column.take(pa.array(found)), column), False))
        up = _opened(np.where(same.to_numpy(zero_copy_only=False), found, -1))
        top, dist = _tops(up)
        weight = batch.column("w").fill_null(0).to_numpy(zero_copy_only=False)
        kept = [name for name in batch.schema.names if name not in ("_own", "_above")]
        added = {"block": np.full(len(up), first + number), "at": np.arange(len(up)), "up": up, "dist": dist, "s": _sums(up, weight)}
        columns = [batch.column(c) for c in kept] + [pa.array(x, pa.int64()) for x in added.values()] + [n.take(pa.array(top))]
        yield pa.RecordBatch.from_arrays(columns, [*kept, *added, "top"])


def _filled(block: pa.Table, names: list[str]) -> pa.Table:
    block = block.sort_by("at")
    numbers = lambda c: block.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    up = numbers("up")
    top, dist = _tops(up)
    tops = pa.array(top)
    at_top = lambda c: block.column(c).take(tops)
    root = pc.coalesce(at_top("_root"), at_top("n"))
    depth = pa.array(dist + numbers("_depth")[top], pa.int64())
    lost = pc.fill_null(at_top("_lost"), False)
    on = pa.array(_sums(up, numbers("_mark")) > 0)
    ring = pc.if_else(pc.and_(lost, pa.chunked_array([on])), at_top("_ring"), pa.scalar(None, block.schema.field("_ring").type))
    return pa.table([*[block.column(c) for c in names], root, depth, pa.array(_sums(up, numbers("w") + numbers("_more")), pa.int64()), lost, ring], [*names, "root", "depth", "s", "lost", "ring"])


def _rounds(edges: DataFrame, keys: list[str], cut: Cut) -> tuple[DataFrame, DataFrame | None]:
    """edges (keys, n, p, u, length, s) of nodes that have a root, with root, depth and the whole s; and the edges of those
    that have none, if there are any. A node's way leads by p to u, `length` above; a u that has no edge is a root.

    In round k a node knows its ancestor 2^k edges above and the sum over what is less than 2^k below, so it adds the
    sums of those whose 2^k-th ancestor it is. Nodes that are still open after a round lie deeper than its
    reach, and above each deep one there is one of every depth: where a round closes none, no one is left that ever
    ends."""
    before = None
    inside = edges.select(*keys, F.col("n").alias("u"), F.lit(True).alias("_in"))
    known = F.col("_in").isNotNull()
    state = cut(edges.join(inside, [*keys, "u"], "left").select(*keys, "n", "p", F.when(known, F.col("u")).alias("up"), F.when(~known, F.col("u")).alias("root"), F.col("length").alias("depth"), "s"), "rounds")
    while True:
        going = state.where("up IS NOT NULL")
        now = going.count()
        if not now:
            return state.drop("up"), None
        if now == before:
            return state.where("up IS NULL").drop("up"), cut(edges.join(going.select(*keys, "n"), [*keys, "n"], "left_semi"), "endless")
        gained = going.groupBy(*keys, F.col("up").alias("n")).agg(F.sum("s").alias("more"))
        far = state.select(*keys, F.col("n").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"))
        jumped = going.drop("root").join(far, [*keys, "up"]).select(*keys, "n", "p", F.col("up2").alias("up"), F.col("root2").alias("root"), (F.col("depth") + F.col("depth2")).alias("depth"), "s")
        both = jumped.unionByName(state.where("up IS NULL")).join(gained, [*keys, "n"], "left")
        state = cut(both.withColumn("s", F.col("s") + F.coalesce("more", F.lit(0))).drop("more"), "rounds")
        before = now


def _rings(edges: DataFrame, keys: list[str], cut: Cut) -> DataFrame:
    """keys, n and ring, the least n of the circle, of the edges that lie on one, where no path ends.

    What isn't come to by 2^k steps goes, until as many are come to as there are: these lie on circles. Their
    least is known where it is the same 2^k further on for each, since such stretches cover the circle."""
    step = edges.select(*keys, "n", F.col("u").alias("up"))
    state, size = step, step.count()
    while (now := (image := cut(state.select(*keys, F.col("up").alias("n")).distinct(), "image")).count()) < size:
        own = cut(state.join(image, [*keys, "n"]), "circle")
        state, size = cut(own.join(own.select(*keys, F.col("n").alias("up"), F.col("up").alias("up2")), [*keys, "up"]).select(*keys, "n", F.col("up2").alias("up")), "circle"), now
    ring = cut(step.join(image, [*keys, "n"]).withColumn("ring", F.col("n")), "ring")
    while True:
        far = ring.select(*keys, F.col("n").alias("up"), F.col("up").alias("up2"), F.col("ring").alias("ring2"))
        both = ring.join(far, [*keys, "up"]).select(*keys, "n", F.col("up2").alias("up"), F.least("ring", "ring2").alias("ring"), (F.col("ring2") < F.col("ring")).alias("less"))
        ring = cut(both, "ring")
        if ring.where("less").isEmpty():
            return ring.select(*keys, "n", "ring")
        ring = ring.drop("less")


def with_below(tree: DataFrame, marked: Column, *, node: str, parent: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys and node of all nodes that have a marked one below them."""
    return climbed(tree, node=node, parent=parent, keys=keys, weight=marked.cast("int")).where("below > 0").select(*keys, node)


def nearest_above(tree: DataFrame, answer: Column, *, node: str, parent: str, keys: Sequence[str] = (), cut: Cut = checkpointed) -> DataFrame:
    """keys, node and answer, its own or that of the nearest node above that has one; null where none has. Of a node's
    rows the least parent and the least answer count, and a circle is gone round once.

    A node that has an answer asks no more, so it stands as a root, and each node's answer is that of its root."""
    keys = list(keys)
    nodes = _nodes(tree, keys, node, parent, F.min(answer).alias("answer"))
    held = nodes.withColumns({"p": F.when(F.col("answer").isNull(), F.col("p")), "w": F.lit(0).cast("bigint")})
    closed, left = solved(held, keys, cut)
    said = nodes.where("answer IS NOT NULL").select(*keys, F.col("n").alias("root"), F.col("answer").alias("above"))
    told = closed.where("answer IS NULL").join(said, [*keys, "root"], "left").select(*keys, F.col("n").alias(node), F.col("above").alias("answer"))
    found = told.unionByName(closed.where("answer IS NOT NULL").select(*keys, F.col("n").alias(node), "answer"))
    return found if left is None else found.unionByName(left.select(*keys, F.col("n").alias(node), "answer"))
