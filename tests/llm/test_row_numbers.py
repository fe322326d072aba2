"""What a stage keeps does not change where files are split otherwise at its write than at its first scan."""

import pytest

import corpus_pipeline
from meterloom.llm import exact_dedup, near_jaccard, simhash_dedup

SMALL = "/root/testdata/sf0.001"
STAGES = {
    "quality": lambda spark, docs: corpus_pipeline.quality_filter(spark, docs, SMALL),
    "exact": lambda _, docs: exact_dedup.keep_one(docs),
    "near": lambda _, docs: near_jaccard.keep_one(docs),
    "fingerprints": lambda _, docs: simhash_dedup.keep_one(docs),
}


@pytest.mark.parametrize("name", STAGES)
def test_rows_stay_the_same_over_other_splits(spark, tmp_path, name):
    spark.read.parquet(f"{SMALL}/documents.parquet").repartition(8, "doc_id").write.parquet(str(tmp_path / "docs"))
    docs, found = spark.read.parquet(str(tmp_path / "docs")), []
    for later in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        stage = STAGES[name](spark, docs)
        spark.conf.set("spark.sql.files.maxPartitionBytes", later)
        found.append(sorted(r.doc_id for r in stage.collect()))
    for key in ("maxPartitionBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{key}")
    assert found[0] == found[1] and 0 < len(found[0]) < docs.count()
