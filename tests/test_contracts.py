"""Contracts that nest: their expressions grow with the contract, not with its depth times over."""

from pyspark.sql import functions as F

from meterloom.plans.contracts import Value, issues


def nested(depth):
    kind = Value("string")
    for _ in range(depth):
        kind = Value("object", {"a": kind}, ("a",))
    return kind


def test_a_field_is_taken_out_of_its_report_once(spark):
    rows = spark.createDataFrame([('{"a":{"a":{"a":7}}}',), ('{"a":{"a":{}}}',), ('{"a":5}',), ('{"a":{"a":{"a":"x"}}}',)], "body string").withColumn("v", F.try_parse_json("body"))
    found = rows.select(issues(nested(3), F.col("v"), F.lit("")).alias("i"))
    assert [[tuple(x) for x in r.i] for r in found.collect()] == [[("a.a.a", "not_string")], [("a.a.a", "missing")], [("a", "not_object")], []]
    uses = [str(issues(nested(d), F.col("v"), F.lit(""))).count("variant_get") for d in (2, 6)]
    assert uses[1] <= 4 * uses[0]
