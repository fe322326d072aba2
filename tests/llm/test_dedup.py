"""Exact and near duplicates, and components, against plain versions of themselves."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest

from meterloom.llm import exact_dedup, golay, simhash_dedup
from meterloom.operators.components import components

random.seed(3)
BASE = " ".join(random.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(300))
TEXTS = [None, "", " ", "\t\n", "a  b", "a\x0bb", "a b", "a\xa0b", "A b", "x", "é é é", BASE, BASE.replace(" ", "\n"), BASE + " z", "q " * 30_000]
TEXTS += [" ".join(w if random.random() > 0.01 else "zeta" for w in BASE.split()) for _ in range(40)] + ["many copies"] * 300
ROWS = [(i * 7 % 1009, text, i) for i, text in enumerate(TEXTS)] + [(5000, "twin", 1), (5000, "twin", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, lane bigint")


def test_exact(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, text, _ in ROWS:
        groups.setdefault(norm(text), []).append(i)
    for lanes in (1, 256):
        found = exact_dedup.exact_duplicates(docs, lanes=lanes).collect()
        assert len(found) == len(ROWS) and sum(r.kept for r in found) == len(groups)
        expected = {i: (min(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
        assert all((r.keep_id, r.group_size, r.text_sha256) == expected[r.doc_id] for r in found)
    kept = exact_dedup.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(g) for g in groups.values())


def test_golay_is_perfect():
    assert len(set(golay.errors().tolist())) == 2048
    words = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    for flip in range(23):
        near, _ = golay.indices(words, 23)
        assert all(n in row for n, row in zip(near, golay.indices(words ^ (1 << flip), 23)[1]))


def test_keys_meet_for_every_small_difference():
    rng = np.random.default_rng(1)
    for bits in (0, 1, 2, 3):
        a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        b = a.copy()
        for i in range(len(b)):
            for bit in rng.choice(64, bits, replace=False):
                b[i] ^= np.uint64(1) << np.uint64(bit)
        ask, answer = [set() for _ in a], [set() for _ in a]
        for place, key, asks in zip(*simhash_dedup.keys(a)):
            if asks:
                ask[place].add(key)
        for place, key, asks in zip(*simhash_dedup.keys(b)):
            if not asks:
                answer[place].add(key)
        assert all(x & y for x, y in zip(ask, answer))


def test_near(docs):
    fps = [simhash_dedup.fingerprint(text) for _, text, _ in ROWS]
    parent = list(range(len(ROWS)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(ROWS)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3 and root(i) != root(j):
            parent[root(j)] = root(i)
    least = {}
    for i, row in enumerate(ROWS):
        least[root(i)] = min(row[0], least.get(root(i), row[0]))
    expected = sorted((row[0], f"{fps[i]:016x}", least[root(i)]) for i, row in enumerate(ROWS))
    assert sorted(map(tuple, simhash_dedup.near_duplicates(docs).collect())) == expected
    assert len({row[2] for row in expected}) < len(set(fps)) < len(ROWS)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(90)] + [(9, 9)]
    found = dict(map(tuple, components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()))
    label = {n: n for p in pairs for n in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert found == {n: r for n, r in label.items() if n in {x for p in pairs if p[0] != p[1] for x in p}}


def test_empty(docs):
    none = docs.where("false")
    assert exact_dedup.exact_duplicates(none).count() == simhash_dedup.near_duplicates(none).count() == 0
