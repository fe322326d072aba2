"""The pipeline against plain versions of its stages, one after the other, on small documents."""

import re
from itertools import combinations

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from meterloom.llm import language_id, quality

SMALL = "/root/testdata/sf0.001"


def plain_quality(docs, labels):
    x = np.array([quality.statistics(d.text) for d in docs])
    place = {d.doc_id: i for i, d in enumerate(docs)}
    at = [place[i] for i, q in labels if i in place and q is not None]
    y = np.array([float(q) for i, q in labels if i in place and q is not None])
    rng, d = np.random.default_rng(5), x.shape[1]
    model = quality.Quality(x[at].mean(axis=0), np.maximum(x[at].std(axis=0), 1e-6), rng.normal(size=(d, 256)) / 4.0, rng.uniform(0, 2 * np.pi, 256), np.zeros(257), np.array([0.5]), np.array([1.0]))
    z = model.features(x[at])
    model.weights = np.linalg.solve(z.T @ z + 0.1 * np.eye(257), z.T @ y)
    raw = np.clip(model.raw(x[at]), 0, 1)
    bins = np.minimum(199, (raw * 200).astype(int))
    held = sorted(set(bins))
    model.at, model.calibrated = quality.isotonic(*(np.array([f(bins == b) for b in held]) for f in (lambda m: raw[m].mean(), lambda m: y[m].mean(), lambda m: m.sum())))
    return [d for d, s in zip(docs, model.scores(x)) if s >= 0.7]


def plain_exact(docs):
    first = {}
    for d in docs:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", d.text or "")
        if key not in first or d.doc_id < first[key].doc_id:
            first[key] = d
    return list(first.values())


def plain_near(docs):
    """By the similarities of all pairs: the stage's contract is 5 words and a Jaccard of 0.8."""
    words = [(d.text or "").encode().lower().split() for d in docs]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(docs)))
    for i, j in combinations(range(len(docs)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
    least = {}
    for d, r in zip(docs, root):
        if r not in least or d.doc_id < least[r].doc_id:
            least[r] = d
    return list(least.values())


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_stages_are_their_plain_versions(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = table.collect()
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality"](spark, table, SMALL)
    assert good.columns == table.columns
    docs = plain_quality(docs, labels)
    assert ids(good.collect()) == ids(docs) and len(docs) < table.count()

    known = stages["language"](spark, good, SMALL)
    model = language_id.fit(good)
    near = [(d, language_id.counts(d.text)) for d in docs]
    kept = []
    for d, found in near:
        if found is not None:
            cosines = model.weigh(found[None, :]) @ model.vectors.T
            if cosines.max() >= model.least[model.languages[cosines.argmax()]]:
                kept.append(d)
    assert known.columns == table.columns and ids(known.collect()) == ids(kept)

    exact = stages["exact"](spark, known, SMALL)
    docs = plain_exact(kept)
    assert exact.columns == table.columns and ids(exact.collect()) == ids(docs)

    single = stages["near"](spark, exact, SMALL)
    docs = plain_near(docs)
    assert single.columns == table.columns and ids(single.collect()) == ids(docs)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {d.doc_id: len(library.encode(d.text or "", add_special_tokens=False).ids) + 1 for d in docs}
    pieces = stages["pack"](spark, single, SMALL).collect()
    assert {p.doc_id: p.doc_tokens for p in pieces} == sizes and sum(p.length for p in pieces) == sum(sizes.values())
    assert sorted((r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, SMALL).where("start = 0").collect()) == sorted(sizes.items())


def test_odd_documents_pass_every_stage(spark):
    rows = [(None, None, None, None, None), (None, "text without id", "en", "web", 3), (1, "", "en", None, 0), (2, "same", "en", "web", 4), (2, "same", "en", "web", 4), (3, "word " * 30_000, "en", "web", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("_row", F.lit("clash")).withColumn("_language", F.lit("clash"))
    for part in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, part, SMALL)
            assert name == "pack" or found.columns == docs.columns
            assert found.count() <= 200
            if name in ("exact", "near"):
                assert found.where("text = 'same'").count() == part.where("text = 'same'").limit(1).count()
