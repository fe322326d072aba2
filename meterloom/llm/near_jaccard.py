"""Near copies by the Jaccard similarity of their word shingles: SimHash fingerprints under Golay keys bring rows
together, MinHash bands what these leave apart, and whole shingle sets decide.

Fingerprints within 3 bits are linked as in simhash_dedup, and what is linked is a group of candidates. Few of
the pairs at 0.8 lie as near as that, so bands follow, which compare what is not one component by then.
Of two sets with similarity s a band of 5 minima agrees with probability s^5, so of 20 bands at least one
does for 99.96 % of pairs at 0.8 and more of those above; what a band brings together is counted exactly.
Each row of a band is first compared with the band's least row, its hub, whatever other bands they share:
copies of one text are one component after that. Where a band is not, the rows outside its largest component
are compared with all of it, so no pair of different components is left out. Hubs and bands with very many
rows are cut into blocks that are groups of their own, so no group grows with them. A group gives links
enough to connect what is similar in it, not all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.llm import simhash_dedup
from meterloom.llm.common import mapped, numbered, written
from meterloom.operators.components import components

BANDS, ROWS = 20, 5
#: Rows, and shingles of all rows, that a block of a band is to hold.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1_000_000


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """Hashes of the distinct runs of words, in order; a text with fewer words is one run."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    runs = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(run, seed) for run in runs], dtype=np.uint64))


class Bands:
    """Keys of shingle sets: one for each band of minima."""

    def __init__(self, seed: int = 42):
        rng = np.random.default_rng(seed)
        self._mixed = rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
        self._times = rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)

    def keys(self, hashes: np.ndarray) -> list[int]:
        if not len(hashes):
            return []
        least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
        for at in range(0, len(hashes), 256):
            part = (hashes[at : at + 256, None] ^ self._mixed) * self._times
            least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0))
        keys = [xxhash.xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(least.reshape(BANDS, ROWS))]
        return np.array(keys, dtype=np.uint64).astype(np.int64).tolist()


def connected(first: list[np.ndarray], second: list[np.ndarray] | None, least: float) -> list[tuple[int, int]]:
    """Places (i, j) of links that connect all pairs with similarity `least` or more: pairs of one of
    `first` and one of `second`, whose places come after, or pairs within `first` if that is None."""
    sets = [*first, *(second or [])]
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    held = np.zeros(codes.max() + 1, dtype=np.uint8)
    root, links = list(range(len(sets))), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in range(len(first)):
        after = i + 1 if second is None else len(first)
        if after >= len(sets):
            break
        own, start = codes[ends[i] - sizes[i] : ends[i]], ends[after - 1]
        held[own] = 1
        common = np.add.reduceat(held[codes[start:]], ends[after - 1 : -1] - start, dtype=np.int64)
        held[own] = 0
        for j in np.nonzero(common / (sizes[i] + sizes[after:] - common) >= least)[0] + after:
            a, b = top(i), top(int(j))
            if a != b:
                root[b] = a
                links.append((i, int(j)))
    return links


def fingerprint_groups(classes: DataFrame) -> DataFrame:
    """key and id of the rows of `classes` (id, size, fp) whose fingerprints others are linked to, with size. Rows
    without shingles are one class and have no group."""
    rows = classes.where("size > 0").select("id", "size", "fp")
    found = components(simhash_dedup.links(rows.select("fp").distinct()), written)
    keyed = rows.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select(F.coalesce("root", "fp").alias("key"), "id", "size")
    shared = keyed.groupBy("key").count().where("count > 1").select("key")
    return written(keyed.join(shared, "key"), "close")


def band_groups(classes: DataFrame) -> DataFrame:
    """key and id of the rows of `classes` (id, size, keys) that share a band, with size. Of bands that the
    same rows share one is kept: groups agree in size and in two sums of hashes, 128 bits in all."""
    keyed = written(classes.select("id", "size", F.explode("keys").alias("key")), "keys")
    of = lambda seed: F.xxhash64("id", F.lit(seed)).cast("decimal(38)")
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum(of(1)).alias("s"), F.sum(of(2)).alias("t")).where("n > 1")
    single = groups.groupBy("n", "s", "t").agg(F.min("key").alias("key")).select("key")
    return written(keyed.join(single, "key").select("key", "id", "size"), "members")


def compared(rows: DataFrame, sets: DataFrame, group: list[str], least: float) -> DataFrame:
    """Links (a, b) that connect, in each group of rows (id, asks and the columns `group`), those that ask
    with those that answer where the similarity of their sets is `least` or more."""

    def linked(part: pa.Table) -> pa.Table:
        sides: dict[bool, list] = {True: [], False: []}
        for at, asks, hashes in zip(part["id"].to_pylist(), part["asks"].to_pylist(), part["hashes"]):
            sides[asks].append((at, np.frombuffer(hashes.as_buffer(), dtype=np.uint64)))
        ids = [at for at, _ in [*sides[True], *sides[False]]]
        found = connected([x for _, x in sides[True]], [x for _, x in sides[False]], least) if sides[True] and sides[False] else []
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    return rows.select("id", "asks", *group).join(sets, "id").groupBy(*group).applyInArrow(linked, "a bigint, b bigint").where("a <> b")


def _blocks(n: str, total: str) -> Column:
    return F.ceil(F.greatest(F.col(n) / BLOCK_ROWS, F.col(total) / BLOCK_SHINGLES, F.lit(1))).cast("int")


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")


def _each(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def with_hubs(members: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Each row against the least of each group that it is in, in blocks of a hub's rows, but for pairs that `found`
    (node, root) holds together."""
    hubs = members.groupBy("key").agg(F.min("id").alias("hub"))
    pairs = members.join(hubs, "key").where("id <> hub").select("hub", "id", "size").distinct()
    if found is not None:
        one, other = found.select(F.col("node").alias("id"), F.col("root").alias("one")), found.select(F.col("node").alias("hub"), F.col("root").alias("other"))
        pairs = pairs.join(one, "id", "left").join(other, "hub", "left").where("one IS NULL OR other IS NULL OR one <> other").select("hub", "id", "size")
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("n"), F.sum("size").alias("total")).select("hub", _blocks("n", "total").alias("blocks"))
    answers = pairs.join(sizes, "hub").select("hub", _block("blocks").alias("block"), "id", F.lit(False).alias("asks"))
    asks = sizes.select("hub", _each("blocks").alias("block"), F.col("hub").alias("id"), F.lit(True).alias("asks"))
    return answers.unionByName(asks)


def with_others(members: DataFrame, found: DataFrame) -> DataFrame:
    """Of each group that `found` (node, root) does not hold together, the rows outside its largest
    component against all of it, in blocks of both. Pairs were compared with their hub already."""
    placed = members.join(found.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    largest = parts.groupBy("key").agg(
        F.max_by("root", F.struct("n", "root")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("n"), F.max_by("total", F.struct("n", "root")).alias("most_total"), F.sum("total").alias("total")
    )
    open_ = largest.where("n > most AND n > 2").select("key", "largest", _blocks("n", "total").alias("blocks"), (F.col("n") - F.col("most")).alias("k"), (F.col("total") - F.col("most_total")).alias("k_total"))
    open_ = open_.select("key", "largest", "blocks", _blocks("k", "k_total").alias("ask_blocks"))
    within = placed.join(open_, "key")
    answers = within.select("key", _block("blocks").alias("block"), _each("ask_blocks").alias("ask_block"), "id", F.lit(False).alias("asks"))
    asks = within.where("root <> largest").select("key", _each("blocks").alias("block"), _block("ask_blocks").alias("ask_block"), "id", F.lit(True).alias("asks"))
    return answers.unionByName(asks)


def linked(members: DataFrame, sets: DataFrame, least: float, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b), those of `known` included, that connect what is similar within the groups of members."""
    found = None if known is None else components(known, written)
    links = written(compared(with_hubs(members, found), sets, ["hub", "block"], least), "links")
    links = links if known is None else known.unionByName(links)
    more = written(compared(with_others(members, components(links, written)), sets, ["key", "block", "ask_block"], least), "links")
    return links.unionByName(more)


def keep_one(df: DataFrame, *, words: int = 5, least: float = 0.8, seed: int = 42) -> DataFrame:
    """One row of each component of df (doc_id, text and others), the first by doc_id (nulls last), with
    all its columns. Rows are linked where the Jaccard similarity of their shingles is at least `least`.
    Rows with the same shingles, and those without words, count as one while links are sought."""
    rows, row = numbered(df)

    def start() -> Callable:
        bands = Bands(seed)

        def signed(texts: list) -> tuple:
            sets = [shingles(text, words, seed) for text in texts]
            return [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], [len(x) for x in sets], [bands.keys(x) for x in sets], np.array([simhash_dedup.folded(x) for x in sets], dtype=np.uint64).astype(np.int64)

        return signed

    signed = mapped(rows, [row, "doc_id"], ["text"], start, "digest binary, size int, keys array<bigint>, fp bigint").withColumn("id", F.monotonically_increasing_id())
    signed = written(signed.withColumnRenamed(row, "row"), "signed")
    classes = signed.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    single = signed.select("id", "row", "digest", "size", "keys", "fp").join(classes.select("id"), "id")
    close, members = fingerprint_groups(single), band_groups(single)

    def hashed() -> Callable:
        return lambda texts: ([shingles(text, words, seed).tobytes() for text in texts],)

    asked = single.select("id", "row").join(members.select("id").union(close.select("id")).distinct(), "id").select("id", F.col("row").alias(row))
    sets = written(mapped(rows.join(asked, row), ["id"], ["text"], hashed, "hashes binary"), "sets")
    found = components(linked(members, sets, least, linked(close, sets, least)), written)
    named = classes.join(found.select(F.col("node").alias("id"), "root"), "id", "left").where("copies > 1 or root is not null")
    named = signed.select("row", "doc_id", "digest").join(named.select("digest", F.coalesce("root", "id").alias("root")), "digest")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first")
    kept = named.groupBy("root").agg(first).select("root", F.col("first.row").alias("kept_row"))
    rejected = named.join(kept, "root").where("row <> kept_row").select(F.col("row").alias(row))
    return rows.join(rejected, row, "left_anti").drop(row)
