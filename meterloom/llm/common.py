"""What the operators share: reading the tables, tables written to the shared folder, text pieces."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "array<string>": pa.list_(pa.string()),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Named columns of a table: what else it holds can't clash with ours."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return found.select(*columns) if columns else found


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set one of our own serves a local session;
    on a cluster each executor would write to its own disk, so that is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="meterloom-"))
    return context.getCheckpointDir()


#: Paths of the tables that written() has made and discard() has not removed.
_HELD: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there, a lost
    executor costs nothing that was finished, and nothing is computed twice. The table goes by
    discard(), or when the driver ends, since what was made from it may be read until then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/meterloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _HELD:
        atexit.register(discard, spark)
    _HELD.append(path)
    return spark.read.schema(df.schema).parquet(path)


def held() -> int:
    """A mark for discard(): the tables that are written from now on come after it."""
    return len(_HELD)


def discard(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Removes the tables written between two marks: what was made from them has been written."""
    paths = _HELD[since:until]
    del _HELD[since:until]
    try:
        jvm = spark.sparkContext._jvm
        for path in paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # at the driver's end the session may have gone before us
        if until is not None:
            raise


def mapped(df: DataFrame, carry: Sequence[str], read: Sequence[str], start: Callable[[], Callable], schema: str, *, rows: int = 256) -> DataFrame:
    """The columns `carry` of df, which stay as they are, nulls and long numbers included, beside those
    of `schema`. start() is called once a task and gives a function from lists of the columns `read` to
    lists of the columns of `schema`, for a few rows at a time. Without `carry` it may give other rows.
    What crosses to Python at once is bounded by the session's rows and bytes for an Arrow batch."""
    names, own = list(dict.fromkeys([*carry, *read])), StructType.fromDDL(schema)
    types = [_ARROW[field.dataType.simpleString()] for field in own]
    places, labels = [names.index(name) for name in read], [*carry, *own.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = work(*(part.column(i).to_pylist() for i in places))
                arrays = [pa.array(values, type=kind) for values, kind in zip(found, types)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *arrays], names=labels)

    kept = df.select(*names)
    return kept.mapInArrow(run, StructType([*kept.schema.fields[: len(carry)], *own.fields]))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not hold."""
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a column that tells its rows apart, and that column's name.

    Rows read straight from Parquet files have their file and their place in it, which are the same
    however the files are split among however many cores, so nothing is copied; that no two rows share
    them is checked, since an explode or a join before would repeat them. Other frames are written with
    numbers of their own."""
    row = unused(df, "_row")
    if "_metadata" not in map(str.lower, df.columns):
        try:
            found = df.withColumn(row, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
            rows, places = found.agg(F.count("*"), F.count_distinct(row)).first()
            if rows == places:
                return found, row
        except AnalysisException:  # not read from Parquet files
            pass
    return written(df.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def crc32_of_id(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string"))


def spread(column: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the value alone."""
    column = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
