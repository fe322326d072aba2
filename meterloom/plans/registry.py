"""The library's queries over the test tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        if function.__name__ in QUERIES:
            raise ValueError(f"two queries are named {function.__name__}")
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows that are kept by hand as a relation of known size, so Spark itself sees that they can be sent to the tasks; of
    createDataFrame() it takes the size to be without bound, and shuffles what they are joined with."""
    names = StructType.fromDDL(schema).fieldNames()
    listed = F.from_json(F.lit(json.dumps([dict(zip(names, row, strict=True)) for row in rows])), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(listed))
