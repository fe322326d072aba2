"""Nulls in any column, odd texts, repeated rows, extra columns with clashing names, empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from meterloom.llm import bpe_codec, exact_dedup, fill_in_middle, language_id, license_scan, line_dedup, packing, quality, simhash_dedup, source_divergence, token_counts, topk_search, toxicity

BYTE_BPE, WORD_BPE = (public_tokenizers.path(f"{name}.json") for name in ("byte_bpe_50k", "word_bpe_49k"))
BIG = 2**60 + 1
CLASH = "line pos h1 h2 times places key met last n form output h0 term block a b documents n_tokens n_bytes row seq head lane norm place fp part start ids queue base label score predicted words mean dir path grants keep_id _row _kept_id component_id vec_id v group".split()
TEXTS = [None, "", " ", "\n", "one", "x" * 200_000, "word " * 40_000, "Licensed under the Apache License, Version 2.0.", "12 34", "é漢字 ß", "tie text", "tie text"]
ROWS = [(i if i else None, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else "web", None) for i, t in enumerate(TEXTS)]
ROWS += [(None, "tie text", "de", "web", None), (None, None, None, None, None), (BIG, "big id", "de", "web", 6), (BIG, "big id", "de", "web", 6), (None, "only a null id", "de", "web", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("*", *[F.lit("clash").alias(name) for name in CLASH])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, None if i % 5 == 4 else i % 2, "clash") for i in range(1, 12)] + [(None, 1, ""), (3, 1, ""), (3, 0, "")], "doc_id bigint, label int, text string")


def own_and_grown(docs):
    return language_id.predict(docs, language_id.fit(docs))


OPERATORS = {
    "counts": lambda d, _: token_counts.count_tokens(d, BYTE_BPE),
    "exact": lambda d, _: exact_dedup.exact_duplicates(d),
    "toxicity": toxicity.classify,
    "licence": lambda d, _: license_scan.inherit(license_scan.scan(d.withColumn("path", F.concat_ws("/", "source", F.lit("a"), "doc_id")))),
    "near": lambda d, _: simhash_dedup.near_duplicates(d),
    "language": lambda d, _: own_and_grown(d),
    "codec": lambda d, _: bpe_codec.round_trip(d, BYTE_BPE),
    "quality": quality.classify,
    "lines": lambda d, _: line_dedup.drop_shared_lines(d),
    "middles": lambda d, _: fill_in_middle.fill_in_middle(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs, labels, name):
    found = OPERATORS[name](docs, labels).collect()
    ids = lambda rows: sorted((r[0] is not None, r[0] or 0) for r in rows)
    assert ids([(r.doc_id,) for r in found]) == ids(ROWS)
    assert OPERATORS[name](docs.where("false"), labels).count() == 0
    assert len(OPERATORS[name](docs, labels.where("false")).collect()) == len(ROWS)


def test_packing_takes_each_row(docs):
    found = packing.pack(docs, WORD_BPE).collect()
    assert sum(r.length for r in found) == sum(r.doc_tokens for r in found if r.start == 0)
    assert sum(r.start == 0 for r in found) == len(ROWS)


def test_dedup_keeps_one_of_each(docs):
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [exact for exact in ({(t or "").replace("\n", " ") if len(t or "") < 9 else t for _, t, *_ in ROWS})]
    assert kept.count() == len(texts)
    near = simhash_dedup.keep_one(kept)
    assert near.columns == docs.columns and near.where("text = 'only a null id'").count() == 1
    groups = simhash_dedup.near_duplicates(kept).select("component_id").distinct().count()
    assert near.count() >= groups and simhash_dedup.keep_one(docs.where("false")).count() == 0


def test_search_with_nulls(spark):
    df = spark.createDataFrame([(None, [1.0]), (100, [2.0]), (100, [2.0]), (BIG, None), (BIG, [0.5])], "vec_id bigint, embedding array<float>").withColumn("block", F.lit("x"))
    found = topk_search.top_k(df, df.where("vec_id % 100 = 0")).collect()
    assert {r.query_id for r in found} == {100} and all(r.score > 0 for r in found)


def test_audit_lists_each_group(docs):
    found = source_divergence.audit(docs, least_documents=1)
    groups = {(lang or "", source or "") for _, _, lang, source, _ in ROWS}
    several = {g for g in groups if sum(other[0] == g[0] for other in groups) > 1}
    assert {(r.lang, r.source) for r in found.collect()} == several and len(several) > 3
    assert source_divergence.audit(docs.where("false")).count() == 0
