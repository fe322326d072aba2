"""SimHash fingerprints of word shingles, linked by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments. Errors of 3 bits or fewer fall on them in one of
these ways: two segments are equal; one is equal and another differs in one bit; or each differs in one
bit. A segment that differs is a word of the Golay code, and the words one bit away from it decode to a
handful of codeword indices, among them the one that any such partner decodes to. So each fingerprint
answers with its own indices and asks with those around it, and the parity tells that one bit is off:

* two equal segments are a key as they are (42 bits or more);
* an equal segment, and the index and parity of another (34 bits or more);
* the indices and parities of two segments, and of the third the half that its one error has
  left alone (36 bits or more).

A pair within 3 bits meets under one of these at least, whatever its errors; a pair of strangers under
one of 2^34 or more, so questions, about a hundred a fingerprint, and not chance meetings make the cost.
What meets is verified.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations, permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm import golay
from meterloom.llm.common import mapped, numbered, written
from meterloom.operators.components import components

SEGMENTS = (22, 21, 21)
#: Bits of the lower half of the third segment.
HALF = 10


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Zero for a text without words; bits that are set in over half of the shingles' hashes."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    digest = xxhash.xxh64_intdigest
    return folded(np.array([digest(s, seed) for s in shingles], dtype="<u8"))


def folded(hashes: np.ndarray) -> int:
    """The fingerprint of shingles with these hashes, zero for none."""
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        set_bits += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, *, words: int = 3, seed: int = 42, also: Sequence[str] = ()) -> DataFrame:
    """doc_id, columns named in `also`, and fp (the fingerprint as a signed long) of each row of df (doc_id, text)."""

    def start() -> Callable:
        return lambda texts: (np.array([fingerprint(text, words, seed) for text in texts], dtype=np.uint64).astype(np.int64),)

    return mapped(df, ["doc_id", *also], ["text"], start, "fp bigint")


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of fingerprints: positions, keys, and whether each key asks."""
    fps, at = fps.astype(np.uint64), 0
    words, near, around, parity = [], [], [], []
    for bits in SEGMENTS:
        own = (fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)
        a, b = golay.indices(own, bits)
        words.append(own.astype(np.int64))
        near.append(a)
        around.append(b)
        parity.append(np.bitwise_count(own).astype(np.int64) & 1)
        at += bits
    places, found, asks = [], [], []

    def add(kind: int, i: np.ndarray, key: np.ndarray, ask: bool) -> None:
        places.append(i)
        found.append(kind << 44 | key)
        asks.append(np.full(len(i), ask))

    everyone = np.arange(len(fps))
    for kind, (x, y) in enumerate(combinations(range(3), 2)):
        both = words[x] | words[y] << 22
        add(kind, everyone, both, False)
        add(kind, everyone, both, True)
    for kind, (x, y) in enumerate(permutations(range(3), 2), 3):
        add(kind, everyone, words[x] | near[y] << 22 | parity[y] << 34, False)
        i, k = np.nonzero(around[y] >= 0)
        add(kind, i, words[x][i] | around[y][i, k] << 22 | (1 - parity[y][i]) << 34, True)
    for kind, half in ((9, words[2] & ((1 << HALF) - 1)), (10, words[2] >> HALF)):
        add(kind, everyone, near[0] | near[1] << 12 | parity[0] << 24 | parity[1] << 25 | half << 26, False)
        off = (1 - parity[0]) << 24 | (1 - parity[1]) << 25 | half << 26
        for j in range(SEGMENTS[1]):
            use = np.nonzero(around[1][:, j] >= 0)[0]
            i, k = np.nonzero(around[0][use] >= 0)
            add(kind, use[i], around[0][use[i], k] | around[1][use[i], j] << 12 | off[use[i]], True)
    return np.concatenate(places), np.concatenate(found), np.concatenate(asks)


def links(fps: DataFrame, *, bits: int = 3) -> DataFrame:
    """Pairs a < b of the distinct values of fps (fp) that differ in up to 3 bits."""
    if bits > 3:
        raise ValueError("keys find up to 3 bits")

    def start() -> Callable:
        def keyed(fps: list[int]) -> tuple:
            own = np.array(fps, dtype=np.int64)
            place, key, ask = keys(own)
            return key, own[place], ask

        return keyed

    keyed = mapped(fps, [], ["fp"], start, "key bigint, fp bigint, ask boolean", rows=4096)
    ask, answer = keyed.where("ask").select("key", F.col("fp").alias("a")), keyed.where("not ask").select("key", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return ask.join(answer, (ask["key"] == answer["key"]) & near).select("a", "b").distinct()


def near_duplicates(df: DataFrame, *, words: int = 3, seed: int = 42, bits: int = 3, tie: str | None = None) -> DataFrame:
    """doc_id, fingerprint and component_id for each row of df (doc_id, text).

    Documents are linked where fingerprints differ in `bits` bits or fewer; component_id is the
    smallest doc_id that links lead to, and null where no linked row has one. Rows with one fingerprint
    count as one while links are sought, so a text that very many rows share costs no more than
    another. Null and empty texts have fingerprint zero and are linked like any other. Repeated rows
    each give a row. With `tie`, a column that tells rows apart, the result holds it, too, and `kept`:
    true for one row of each component, the first by doc_id (nulls last) and then by `tie`."""
    own = [tie] if tie else []
    docs = written(fingerprints(df, words=words, seed=seed, also=own), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", *[F.col(c).alias("tie") for c in own])
    classes = written(docs.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    found = components(links(classes, bits=bits), written)
    joined = classes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    named = joined.select("fp", "root").join(least, "root").select("fp", "least")
    kept = [F.col("least.tie").eqNullSafe(F.col(c)).alias("kept") for c in own]
    return docs.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least.doc_id").alias("component_id"), *own, *kept)


def keep_one(df: DataFrame, *, least: float | None = None, words: int = 3, seed: int = 42, bits: int = 3) -> DataFrame:
    """One row of each component of df, the first by doc_id (nulls last), with all its columns.

    Rows are linked by their fingerprints or, with `least`, by a Jaccard similarity of their shingles
    from there on. Fingerprints then give the first candidates. At 0.8 they differ in ten bits or so, which
    no key of a few segments survives, so bands of minima stand beside them for the rest."""
    if least is not None:
        from meterloom.llm import near_jaccard  # it takes fingerprints and links from here

        return near_jaccard.keep_one(df, words=words, least=least, seed=seed)
    rows, row = numbered(df)
    kept = near_duplicates(rows, words=words, seed=seed, bits=bits, tie=row).where("kept").select(row)
    return rows.join(kept, row, "left_semi").drop(row)
