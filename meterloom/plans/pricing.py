"""Prices by period and band, marginals, cohorts and scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.functions import numbers, periods
from meterloom.operators import aggregates
from meterloom.plans.registry import query, small_table, table

#: A catalogue of our own: product, from, until (open where null), price a unit, price beyond 40 units.
CATALOGUE = (
    ("A", "1995-01-01", "1997-06-01", 0.25, 0.20),
    ("A", "1997-06-01", None, 0.30, 0.21),
    ("N", "1996-01-01", None, 0.10, 0.10),
)
_ROWS = ", ".join(f"('{m}', DATE '{a}', {f"DATE '{b}'" if b else 'CAST(NULL AS DATE)'}, {x}, {y})" for m, a, b, x, y in CATALOGUE)
_PRICED = f"""WITH c(model, since, until, plain, band) AS (VALUES {_ROWS}),
    p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus, l_quantity, c.model, c.since, c.plain, c.band, x.known FROM lineitem
        LEFT JOIN (SELECT DISTINCT model AS known FROM c) AS x ON x.known = l_returnflag
        LEFT JOIN c ON c.model = l_returnflag AND CAST(l_shipdate AS DATE) >= since AND (until IS NULL OR CAST(l_shipdate AS DATE) < until)),
    r AS (SELECT *, CASE WHEN known IS NULL THEN 'unknown_model' WHEN model IS NULL THEN 'no_period' END AS reason,
        floor(l_quantity * CASE WHEN l_quantity > 40 THEN band ELSE plain END * 1e6 + 0.5) / 1e6 AS price FROM p)"""


def catalogue(spark: SparkSession) -> DataFrame:
    rows = small_table(spark, CATALOGUE, "model string, since string, until string, plain double, band double")
    return rows.select("model", F.col("since").cast("date").alias("since"), F.col("until").cast("date").alias("until"), "plain", "band")


def priced(rows: DataFrame, prices: DataFrame, *, model: str, date: str, units: str, band_from: float) -> DataFrame:
    """rows with price and reason: unknown_model or no_period where nothing applies.

    The catalogue is gathered to one row for each model first, so a row of the ledger never multiplies. A list
    that is kept by hand is small enough for Spark to send it to the tasks by itself."""
    listed = prices.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("since", "until", "plain", "band"))).alias("listed"))
    day = F.col(date).cast("date")
    fits = F.filter("listed", lambda p: (day >= p["since"]) & (p["until"].isNull() | (day < p["until"])))
    found = rows.join(listed, F.col(model) == F.col("model"), "left").withColumn("period", F.try_element_at(fits, F.lit(-1)))
    reason = F.when(F.col("model").isNull(), "unknown_model").when(F.col("period").isNull(), "no_period")
    rate = F.when(F.col(units) > band_from, F.col("period.band")).otherwise(F.col("period.plain"))
    return found.withColumn("reason", reason).withColumn("price", numbers.round6(F.col(units) * rate)).drop("listed", "period", "model")


def _lines(spark, sf_dir):
    return priced(table(spark, sf_dir, "lineitem"), catalogue(spark), model="l_returnflag", date="l_shipdate", units="l_quantity", band_from=40)


@query(_PRICED + " SELECT l_orderkey, l_linenumber, l_partkey, price, reason FROM r")
def price_rows(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "price", "reason")


@query(_PRICED + """ SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS INTEGER) AS level, count(*) AS calls,
        CAST(sum(CAST(price AS DECIMAL(18,6))) AS DOUBLE) AS price, count(*) FILTER (WHERE reason IS NOT NULL) AS unpriced
    FROM r GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())""")
def price_marginals(spark, sf_dir):
    """Lines are reduced to the finest groups first; those few rows alone are spread over the marginals."""
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    finest = _lines(spark, sf_dir).groupBy(a, b).agg(F.count("*").alias("calls"), F.sum(F.col("price").cast("decimal(18,6)")).alias("price"), F.count_if(F.col("reason").isNotNull()).alias("unpriced"))
    grouped = finest.groupingSets([[a, b], [a], [b], []], a, b)
    return grouped.agg(F.grouping_id().cast("int").alias("level"), F.sum("calls").alias("calls"), F.sum("price").cast("double").alias("price"), F.sum("unpriced").alias("unpriced"))


@query("""SELECT p_brand, p_type, count(*) AS parts, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(q) AS DOUBLE) AS quantity FROM
    (SELECT l_partkey, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY l_partkey) JOIN part ON p_partkey = l_partkey GROUP BY p_brand, p_type""")
def two_stage_agg(spark, sf_dir):
    by_part = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), aggregates.exact_sum("l_quantity", 2).alias("q"))
    return by_part.join(table(spark, sf_dir, "part"), "p_partkey").groupBy("p_brand", "p_type").agg(F.count("*").alias("parts"), F.sum("n").alias("lines"), aggregates.exact_sum("q", 2).alias("quantity"))


@query("""SELECT l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, count(DISTINCT l_suppkey) FILTER (WHERE l_tax > 0.04) AS taxed_suppliers,
        max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS largest_return FROM lineitem GROUP BY l_linestatus""")
def conditional_agg(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"),
        F.count_distinct(F.when(F.col("l_tax") > 0.04, F.col("l_suppkey"))).alias("taxed_suppliers"),
        F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("largest_return"),
    )
