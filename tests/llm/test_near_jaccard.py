"""Planted near copies through the near-duplicate stage, against the similarities of all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from meterloom.llm import exact_dedup, near_jaccard

WORDS = [f"w{i}" for i in range(5_000)]


def runs(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def kept(rows):
    """What stays by the similarities of all pairs."""
    sets, root = [runs(text) for _, text in rows], list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if root[i] != root[j] and similarity(sets[i], sets[j]) >= 0.8:
            root = [root[i] if r == root[j] else r for r in root]
    return sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root))


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = rng.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="module")
def planted():
    rng, rows = random.Random(4), []
    for n in range(150):
        words = [rng.choice(WORDS) for _ in range(400)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, edited(rng, words, rng.randrange(1, 14)))]
    return rows


def test_pairs_from_08_on_are_found_and_others_stay(spark, planted):
    similar = [similarity(runs(a), runs(b)) for (_, a), (_, b) in zip(planted[::2], planted[1::2])]
    assert sum(0.8 <= s < 0.95 for s in similar) > 80 and sum(s < 0.8 for s in similar) > 10
    docs = spark.createDataFrame(planted, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_filter(spark, docs, "").collect()) == kept(planted)


def test_documents_as_by_all_pairs(spark):
    docs = exact_dedup.keep_one(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = [(d.doc_id, d.text) for d in docs.collect()]
    found = corpus_pipeline.near_filter(spark, docs, "")
    assert found.columns == docs.columns and sorted(r.doc_id for r in found.collect()) == kept(rows) and len(kept(rows)) < len(rows)


def test_large_groups_are_cut_into_blocks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(near_jaccard, "BLOCK_ROWS", 8)
    rng = random.Random(6)
    words = [rng.choice(WORDS) for _ in range(120)]
    rows = [(i, edited(rng, words, rng.randrange(1, 5))) for i in range(150)] + [(900 + i, " ".join(words).upper()) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in near_jaccard.keep_one(docs).collect()) == kept(rows)


def test_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 14, 12)).astype(np.uint64) for _ in range(60)]
    exact = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8

    def groups(pairs):
        root = list(range(len(sets)))
        for i, j in pairs:
            root = [root[i] if r == root[j] else r for r in root]
        return [[root[i] == root[j] for j in range(len(sets))] for i in range(len(sets))]

    within = near_jaccard.connected(sets, None, 0.8)
    assert all(exact(i, j) for i, j in within) and groups(within) == groups((i, j) for i, j in combinations(range(60), 2) if exact(i, j))
    across = near_jaccard.connected(sets[:25], sets[25:], 0.8)
    assert all(exact(i, j) for i, j in across) and groups(across) == groups((i, j) for i in range(25) for j in range(25, 60) if exact(i, j))


def test_fingerprints_alone_give_candidates(spark, monkeypatch):
    """Without bands, what lies within 3 bits is still linked, and only where the sets are similar."""
    monkeypatch.setattr(near_jaccard.Bands, "keys", lambda self, hashes: [])
    rng = random.Random(8)
    words = [rng.choice(WORDS) for _ in range(3_000)]
    rows = [(i, edited(rng, words, 1)) for i in range(6)] + [(10, " ".join(rng.choice(WORDS) for _ in range(300))), (11, None), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in near_jaccard.keep_one(docs).collect()) == kept(rows) == [0, 10, 11]
