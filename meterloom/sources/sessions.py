"""Transcripts in JSON lines, as events of one model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.functions.text import value_hash

#: The basis of a session's tokens: input, cache reads and cache writes are counted apart.
SESSION_BASIS = "input_excludes_cache_read"

#: One row for each model or tool event, whatever it was read from. Hashes carry a label that says how much of
#: the value was hashed (full, redacted, truncated), tokens the basis they were counted on.
EVENT_COLUMNS = (
    ("run_id", "event_id", "kind", "name", "model", "status", "start_ms", "end_ms", "duration_ms", "seq", "parent_id", "tool_call_id", "error_type", "finish_reason")
    + ("token_basis", "tokens_in", "tokens_out", "tokens_total", "cache_read", "cache_write", "args_hash", "args_label", "result_hash", "result_label", "result_bytes", "scope", "tags", "included")
)

_USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>"
_PART = "struct<type:string,id:string,name:string,input:variant,tool_use_id:string,content:variant,is_error:boolean>"
SESSION_LINE = f"type string, uuid string, parentUuid string, sessionId string, timestamp string, isSidechain boolean, agentId string, message struct<id:string,role:string,model:string,content:string,stop_reason:string,usage:{_USAGE}>"

def lines(spark: SparkSession, paths: str | list[str], markers: tuple[str, ...] = ()) -> DataFrame:
    """value, file and pos of each line; with markers only lines that contain one are kept, before any JSON is
    parsed. pos orders the lines of a file however it is split: first where a line's split begins in it, then
    the line's place among those that its task reads. The numbers themselves say nothing across files."""
    block, place = F.col("_metadata.file_block_start"), F.monotonically_increasing_id() % (1 << 33)
    read = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), (block * (1 << 20) + place).alias("pos"))
    if not markers:
        return read
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(F.col("value"), F.lit(marker))
    return read.where(found)


def parsed(read: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, problems): lines that hold an object of the schema, and those that don't, with a reason."""
    both = read.withColumn("j", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("j").isNull() | F.col("j._bad").isNotNull()
    return both.where(~bad).drop("value"), both.where(bad).select("file", "pos", F.lit("not_json").alias("problem"))


#: How a call ended, the weakest word first: a failure that was seen once is not undone by another result.
OUTCOMES = ("unknown", "ok", "cancelled", "denied", "blocked", "error")


def worst(status: Column) -> Column:
    """Of several outcomes of one call the one that dominates."""
    rank = F.array_position(F.array(*map(F.lit, OUTCOMES)), status)
    return F.max_by(status, F.when(status.isNotNull(), rank))


def session_events(rows: DataFrame) -> DataFrame:
    """Events of session transcripts (the rows of parsed() by SESSION_LINE).

    An answer's lines share a message id, and the last of them holds its usage. Side chains with an agent id
    are runs of their own. A tool call is put together from its request and its result; a result without a
    request, or the reverse, still gives a row."""
    run = F.when(F.col("j.isSidechain") & F.col("j.agentId").isNotNull(), F.concat_ws("/", "j.sessionId", "j.agentId")).otherwise(F.col("j.sessionId"))
    base = rows.select(run.alias("run_id"), "pos", "j.*").withColumn("ms", F.unix_millis(F.try_to_timestamp("timestamp")))
    said = base.where("type = 'assistant' AND message.id IS NOT NULL")
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    calls = said.groupBy("run_id", F.col("message.id").alias("event_id")).agg(
        F.lit("model").alias("kind"),
        newest("message.model").alias("model"),
        F.min("ms").alias("start_ms"),
        F.max("ms").alias("end_ms"),
        F.min("pos").alias("seq"),
        newest("message.usage.input_tokens").alias("tokens_in"),
        newest("message.usage.output_tokens").alias("tokens_out"),
        newest("message.usage.cache_read_input_tokens").alias("cache_read"),
        newest("message.usage.cache_creation_input_tokens").alias("cache_write"),
        F.max(F.when(F.col("message.usage").isNotNull(), SESSION_BASIS)).alias("token_basis"),
    )
    parts = base.select("run_id", "pos", "ms", F.explode(F.from_json("message.content", f"array<{_PART}>")).alias("p"))
    use, result = F.col("p.type") == "tool_use", F.col("p.type") == "tool_result"
    shown = F.coalesce(F.try_variant_get("p.content", "$", "string"), F.to_json("p.content"))
    first = lambda which, value: F.min(F.when(which, value))
    tools = (
        parts.where(use | result)
        .groupBy("run_id", F.coalesce("p.id", "p.tool_use_id").alias("event_id"))
        .agg(
            F.lit("tool").alias("kind"),
            first(use, F.col("p.name")).alias("name"),
            first(use, F.col("ms")).alias("start_ms"),
            first(result, F.col("ms")).alias("end_ms"),
            F.min("pos").alias("seq"),
            worst(F.when(result, F.when(F.coalesce("p.is_error", F.lit(False)), "error").otherwise("ok"))).alias("status"),
            first(use, value_hash(F.col("p.input"))).alias("args_hash"),
            first(result, value_hash(F.col("p.content"))).alias("result_hash"),
            first(result, F.octet_length(shown).cast("bigint")).alias("result_bytes"),
        )
        .withColumn("tool_call_id", F.col("event_id"))
    )
    return shaped(calls.unionByName(tools, allowMissingColumns=True))


def shaped(df: DataFrame) -> DataFrame:
    """df with all EVENT_COLUMNS; what it doesn't hold is null, but for the label of a hash (full), the scope
    ({}) and lists (empty)."""
    numbers = {"start_ms", "end_ms", "duration_ms", "seq", "tokens_in", "tokens_out", "tokens_total", "cache_read", "cache_write", "result_bytes"}
    held = lambda name, kind: (F.col(name) if name in df.columns else F.lit(None)).cast(kind)
    chosen: list[Column] = []
    for name in EVENT_COLUMNS:
        if name in ("tags", "included"):
            column = F.coalesce(held(name, "array<string>"), F.array().cast("array<string>"))
        elif name.endswith("_label"):
            column = F.when(held(name.replace("_label", "_hash"), "string").isNotNull(), F.coalesce(held(name, "string"), F.lit("full")))
        elif name == "scope":
            column = F.coalesce(held(name, "string"), F.lit("{}"))
        else:
            column = held(name, "bigint" if name in numbers else "string")
        chosen.append(column.alias(name))
    return df.select(*chosen)
