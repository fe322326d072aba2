"""Which reader an allowance sample belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.plans.registry import query, table


def bind(samples: DataFrame, bindings: DataFrame, stamp: str) -> DataFrame:
    """samples with the binding that carries the same stamp, or the reason why none can be named."""
    counted = bindings.groupBy(stamp).agg(F.count("*").alias("n"), F.min("binding_id").alias("binding_id"), F.bool_and("enabled").alias("enabled"))
    reason = F.when(F.col(stamp).isNull(), "no_stamp").when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").when(~F.col("enabled"), "disabled")
    return samples.join(counted, stamp, "left").withColumn("reason", reason).withColumn("binding_id", F.when(F.col("reason").isNull(), F.col("binding_id"))).drop("n", "enabled")


@query("""WITH b AS (SELECT CAST(c_nationkey AS BIGINT) AS stamp, count(*) AS n, CAST(min(c_custkey) AS BIGINT) AS binding_id, bool_and(c_acctbal > 0) AS enabled FROM customer WHERE c_nationkey % 3 = 0 OR c_custkey % 20 = 1 GROUP BY 1),
    s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey % 30 END AS stamp FROM orders), j AS (SELECT s.*, CASE WHEN s.stamp IS NULL THEN 'no_stamp' WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' WHEN NOT enabled THEN 'disabled' END AS reason, binding_id FROM s LEFT JOIN b ON b.stamp = s.stamp)
    SELECT o_orderkey, stamp, reason, CASE WHEN reason IS NULL THEN binding_id END AS binding_id FROM j""")
def sample_bindings(spark, sf_dir):
    stamps = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey") % 30).alias("stamp"))
    bound = table(spark, sf_dir, "customer").where("c_nationkey % 3 = 0 OR c_custkey % 20 = 1").select(F.col("c_nationkey").cast("bigint").alias("stamp"), F.col("c_custkey").alias("binding_id"), (F.col("c_acctbal") > 0).alias("enabled"))
    return bind(stamps, bound, "stamp")
