"""Each registered query against its SQL in DuckDB: rows, names and types."""

import duckdb
import pytest

from meterloom import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df, sql = catalog.queries()[name](spark, SF_DIR), catalog.oracle_sql()[name]
    columns = sorted(df.columns)
    types = {row[0]: TYPES[row[1]] for row in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert types == dict(df.dtypes)
    order = lambda rows: sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert order(map(tuple, df.select(*columns).collect())) == order(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
