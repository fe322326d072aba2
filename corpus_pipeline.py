"""From raw documents to packed sequences, a stage at a time.

Each stage reads what the one before it kept, as a table in the shared folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm import exact_dedup, language_id, packing, quality, simhash_dedup
from meterloom.llm.common import discard, held, table, unused, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 go; all labels of the corpus are learned from. Whole rows pass
    through the operator, so nothing is shuffled and null and repeated ids do no harm. Null and empty texts
    are scored like others; without labels of both kinds all documents score alike. No documents give none."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    model = quality.fit(quality.document_statistics(docs), labels)
    names = [unused(docs, name) for name in ("_score", "_predicted")]
    return quality.predict(docs, model, threshold=0.7, carry=docs.columns, names=names).where(F.col(names[1]) == 1).drop(*names)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are far from every language go, as do those without letters, null and empty texts among
    them. Whole rows pass through the operator, so nothing is shuffled; repeated rows are judged alike, and
    where no row has a language, those without letters alone go."""
    names = [unused(docs, name) for name in ("_language", "_cosine", "_rejected")]
    return language_id.predict(docs, language_id.fit(docs), carry=docs.columns, names=names).where(~F.col(names[2])).drop(*names)


def exact_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same normalised text the smallest doc_id stays, a null one only where all are null;
    null counts as empty, and of rows that repeat doc_id and text one stays. No documents give none."""
    return exact_dedup.keep_one(docs)


def near_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash fingerprints within 3 bits, met under Golay keys, give the first candidates, bands of minima what lies
    further apart. Of documents linked by a Jaccard similarity of at least 0.8 between their runs of 5 words the one
    with the smallest doc_id stays, a null one only where all are null, and of equal ids one row. Null and empty
    texts have no runs and count as copies of each other; a text of fewer words is one run. No documents
    give none."""
    return simhash_dedup.keep_one(docs, words=5, least=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens, in which sources keep their shares of all tokens window by window; a row for each
    piece of a document. A null text is empty and has the closing id alone, a null source is the empty one,
    repeated rows are each packed, and no documents give no pieces."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, end=1)


STAGES = [
    ("quality", quality_filter),
    ("language", language_filter),
    ("exact", exact_filter),
    ("near", near_filter),
    ("pack", pack),
]

#: The stages that learn and the tokeniser can't be put in SQL; tests hold each to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what all stages keep. Of each stage's tables its result alone outlives it, and that
    until the next stage has written its own."""
    docs, base = table(spark, sf_dir, "documents"), held()
    for name, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        end = held()
        docs = written(found, name)
        discard(spark, base, end)
    return STAGES[-1][1](spark, docs, sf_dir)
