"""Exported spans as events: whole documents or a line for each envelope, current and older names, whatever is nested in
attributes. What can't be read is a problem with its place, and the rest is read all the same."""

from __future__ import annotations

import json
import re
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType, StructType

from meterloom.functions.text import value_hash
from meterloom.operators.components import checkpointed
from meterloom.operators.trees import climbed, nearest_above
from meterloom.sources import sessions
from meterloom.sources.sessions import shaped

#: Attributes that fill a field, the first that is there and of its type; operations by name.
STRINGS = {
    "model": ("gen_ai.response.model", "gen_ai.request.model"),
    "operation": ("gen_ai.operation.name",),
    "conversation": ("gen_ai.conversation.id",),
    "finish_reason": ("gen_ai.response.finish_reasons", "gen_ai.response.finish_reason"),
    "tool_call_id": ("gen_ai.tool.call.id",),
    "tool_name": ("gen_ai.tool.name",),
    "error_type": ("error.type",),
}
COUNTS = {
    "tokens_in": ("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens"),
    "tokens_out": ("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens"),
    "tokens_total": ("gen_ai.usage.total_tokens",),
    "cache_read": ("gen_ai.usage.cache_read.input_tokens", "gen_ai.usage.cache_read_input_tokens"),
    "cache_write": ("gen_ai.usage.cache_creation.input_tokens", "gen_ai.usage.cache_creation_input_tokens"),
}
ARGUMENTS, RESULT, RESULT_EVENT = "gen_ai.tool.call.arguments", "gen_ai.tool.call.result", "gen_ai.tool.message"
MODEL_OPERATIONS, TOOL_OPERATIONS = ("chat", "text_completion", "generate_content", "embeddings"), ("execute_tool", "tool")
_ERRORS, _FINE = ("2", "STATUS_CODE_ERROR", "ERROR"), ("1", "STATUS_CODE_OK", "OK")
_HELD = StructType().add("held", MapType(StringType(), StringType())).add("faults", IntegerType())
_INT = r"^[+-]?[0-9]{1,19}$"


def _items(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _fields(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _text(v: Column, path: str) -> Column:
    """A non-empty string at a path."""
    own = F.try_variant_get(v, path, "variant")
    return F.nullif(F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get(v, path, "string")), F.lit(""))


def _scalar(value: Column) -> Column:
    """The JSON of a value that is no list; null for any other and for what can't be read."""
    own = lambda name: F.try_variant_get(value, f"$.{name}", "variant")
    kind = lambda name: F.schema_of_variant(own(name))
    whole = F.try_variant_get(value, "$.intValue", "string")
    number = F.try_variant_get(value, "$.doubleValue", "double")
    return (
        F.when(own("stringValue").isNotNull(), F.when(kind("stringValue") == "STRING", F.to_json(own("stringValue"))))
        .when(own("intValue").isNotNull(), F.when((kind("intValue") != "BOOLEAN") & whole.rlike(_INT), F.regexp_replace(whole, r"^\+", "")))
        .when(own("doubleValue").isNotNull(), F.when(kind("doubleValue") != "BOOLEAN", number.cast("string")))
        .when(own("boolValue").isNotNull(), F.when(kind("boolValue") == "BOOLEAN", F.to_json(own("boolValue"))))
        .when(own("bytesValue").isNotNull(), F.when(kind("bytesValue") == "STRING", F.to_json(own("bytesValue"))))
    )


def _decoded(value):
    """A value of any nesting as plain JSON; ValueError for what has no meaning."""
    if not isinstance(value, dict):
        raise ValueError("no object")
    for name, kind in (("stringValue", str), ("boolValue", bool), ("bytesValue", str)):
        if name in value and not (name == "bytesValue" and value.keys() & {"intValue", "doubleValue", "arrayValue", "kvlistValue"}) and not (name == "boolValue" and value.keys() & {"intValue", "doubleValue"}):
            if not isinstance(value[name], kind):
                raise ValueError(name)
            return value[name]
    if "intValue" in value:
        if isinstance(value["intValue"], (bool, float)) or not re.match(_INT, str(value["intValue"])):
            raise ValueError("intValue")
        return int(value["intValue"])
    if "doubleValue" in value:
        if isinstance(value["doubleValue"], bool):
            raise ValueError("doubleValue")
        return float(value["doubleValue"])
    if "arrayValue" in value:
        return [_decoded(x) for x in (value["arrayValue"] or {}).get("values") or []]
    if "kvlistValue" in value:
        found: dict = {}
        for entry in (value["kvlistValue"] or {}).get("values") or []:
            found.setdefault(entry["key"], _decoded(entry.get("value")))
        return found
    raise ValueError("no value")


def _nested(listed: str) -> dict:
    held, faults = {}, 0
    for entry in json.loads(listed):
        try:
            if not isinstance(entry["key"], str):
                raise ValueError("key")
            value = _decoded(entry.get("value"))
        except (ValueError, TypeError, KeyError, AttributeError):
            faults += 1
            continue
        held.setdefault(entry["key"], json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
    return {"held": held, "faults": faults}


@F.pandas_udf(_HELD)
def _nested_attributes(listed: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_nested(x) if isinstance(x, str) else {"held": None, "faults": None} for x in listed], columns=["held", "faults"])


def attributes(listed: Column) -> Column:
    """held, JSON by name of an array of attributes, and faults, how many can't be read; of a name that stands twice the
    first. Plain values are read by expressions, spans with lists in a value by a function over whole batches."""
    text = F.to_json(listed)
    nested = F.contains(text, F.lit('"arrayValue"')) | F.contains(text, F.lit('"kvlistValue"'))
    read = F.transform(listed, lambda a: F.struct(_text(a, "$.key").alias("key"), _scalar(F.try_variant_get(a, "$.value", "variant")).alias("value")))
    good = F.filter(read, lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    names = F.array_distinct(F.transform(good, lambda e: e["key"]))
    first = F.map_from_arrays(names, F.transform(names, lambda k: F.get(F.filter(good, lambda e: e["key"] == k), 0)["value"]))
    plain = F.struct(first.alias("held"), (F.size(read) - F.size(good)).alias("faults")).cast(_HELD)
    none = F.struct(F.create_map().cast("map<string,string>").alias("held"), F.lit(0).alias("faults")).cast(_HELD)
    return F.when(nested, _nested_attributes(F.when(nested, text))).when(listed.isNotNull(), plain).otherwise(none)


def _problem(rows: DataFrame, pointer: Column, problem: str | Column) -> DataFrame:
    return rows.select("file", "pos", pointer.alias("pointer"), (F.lit(problem) if isinstance(problem, str) else problem).alias("problem"))


def spans(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, problems) of documents (file, pos, value: an envelope each). A span has its place as a pointer, its
    resource's attributes and its own."""
    v = F.try_parse_json("value")
    whole = documents.select("file", "pos", v.alias("v"))
    told = whole.withColumn("fault", F.when(F.col("v").isNull(), "not_json").when(_fields(F.col("v")).isNull(), "not_an_object").when(F.try_variant_get("v", "$.resourceSpans", "variant").isNull(), "no_resource_spans").when(_items(F.col("v"), "$.resourceSpans").isNull(), "not_an_array"))
    problems = _problem(told.where("fault IS NOT NULL"), F.lit(""), F.col("fault"))
    resources = told.where("fault IS NULL").select("file", "pos", F.posexplode(_items(F.col("v"), "$.resourceSpans")).alias("i", "r"))
    older = ~F.coalesce(F.map_contains_key(_fields(F.col("r")), F.lit("scopeSpans")), F.lit(False))
    name = F.when(older, "instrumentationLibrarySpans").otherwise("scopeSpans")
    at = F.concat(F.lit("/resourceSpans/"), F.col("i").cast("string"))
    listed = F.when(older, _items(F.col("r"), "$.instrumentationLibrarySpans")).otherwise(_items(F.col("r"), "$.scopeSpans"))
    resources = resources.select("file", "pos", "r", at.alias("at"), name.alias("name"), listed.alias("scopes"))
    problems = problems.unionByName(_problem(resources.where(_fields(F.col("r")).isNull()), F.col("at"), "not_an_object"))
    problems = problems.unionByName(_problem(resources.where(_fields(F.col("r")).isNotNull() & F.col("scopes").isNull()), F.concat("at", F.lit("/"), "name"), "not_an_array"))
    scopes = resources.select("file", "pos", _items(F.col("r"), "$.resource.attributes").alias("resource"), F.concat("at", F.lit("/"), "name").alias("at"), F.posexplode("scopes").alias("j", "s"))
    scopes = scopes.select("file", "pos", "resource", F.concat("at", F.lit("/"), F.col("j").cast("string")).alias("at"), "s", _items(F.col("s"), "$.spans").alias("spans"))
    problems = problems.unionByName(_problem(scopes.where("spans IS NULL"), F.col("at"), "no_spans"))
    each = scopes.select("file", "pos", "resource", "at", F.posexplode("spans").alias("k", "span"))
    each = each.select("file", "pos", "resource", F.concat("at", F.lit("/spans/"), F.col("k").cast("string")).alias("pointer"), "span", _text(F.col("span"), "$.traceId").alias("trace"), _text(F.col("span"), "$.spanId").alias("id"))
    lacking = F.when(_fields(F.col("span")).isNull(), "not_an_object").when(F.col("trace").isNull(), "no_trace_id").when(F.col("id").isNull(), "no_span_id")
    marked = each.withColumn("fault", lacking)
    problems = problems.unionByName(_problem(marked.where("fault IS NOT NULL"), F.col("pointer"), F.col("fault")))
    return marked.where("fault IS NULL").drop("fault"), problems


def _string(held: str, name: str) -> Column:
    """An attribute that is a string, or a list of strings joined by commas."""
    value = F.try_element_at(held, F.lit(name))
    parsed = F.try_parse_json(value)
    words = F.try_variant_get(parsed, "$", "array<string>")
    return F.when(F.startswith(value, F.lit('"')), F.try_variant_get(parsed, "$", "string")).when(F.startswith(value, F.lit("[")) & ~value.rlike(r'^\[(?:[^"\]]|.*,[^"])'), F.array_join(words, ","))


def span_events(documents: DataFrame, *, run_attribute: str | None = None, token_basis: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, problems) of documents (file, pos, value).

    A span is a tool call by its attributes or operation, a model call if it names a model's work and no model call
    lies below it, and an aggregate if one does, or if two lie below a span of neither kind. Its run is what
    run_attribute says, on the span or its resource, or its conversation, or that of the nearest span above with
    one, or the only one that its trace has, or the trace. token_basis says what the exporter's tokens count."""
    read, problems = spans(documents)
    own = attributes(_items(F.col("span"), "$.attributes"))
    read = read.withColumns({"own": own, "outer": attributes(F.col("resource"))})
    problems = problems.unionByName(_problem(read.where("own.faults > 0 OR outer.faults > 0"), F.col("pointer"), "attributes"))
    first = lambda names, one: F.coalesce(*[one(n) for n in names])
    whole = lambda n: F.when(F.try_element_at("own.held", F.lit(n)).rlike(_INT), F.try_element_at("own.held", F.lit(n)).try_cast("bigint"))
    told = {c: first(names, lambda n: _string("own.held", n)) for c, names in STRINGS.items()} | {c: first(names, whole) for c, names in COUNTS.items()}
    read = read.withColumns(told).withColumn("parent", _text(F.col("span"), "$.parentSpanId"))
    named = F.nullif(F.coalesce(_string("own.held", run_attribute), _string("outer.held", run_attribute)), F.lit("")) if run_attribute else F.lit(None).cast("string")
    read = read.withColumn("own_run", F.coalesce(named, F.nullif("conversation", F.lit(""))))
    tool = F.coalesce(F.col("operation").isin(*TOOL_OPERATIONS), F.lit(False)) | F.exists(F.map_keys("own.held"), lambda k: F.startswith(k, F.lit("gen_ai.tool.")))
    signal = F.coalesce("model", "finish_reason", *[F.col(c).cast("string") for c in COUNTS]).isNotNull()
    model = ~tool & (F.coalesce(F.col("operation").isin(*MODEL_OPERATIONS), F.lit(False)) | signal)
    # Written once: the trees, the runs and the events below all read it, and none parses the envelopes again.
    read = checkpointed(read.withColumns({"tool": tool, "model_span": model}).drop("outer"), "spans")
    tree = read.select("trace", "id", "parent", "model_span", "own_run")
    # A model span is a call where none lies below it, and calls below are counted by these.
    below = climbed(tree, node="id", parent="parent", keys=["trace"], weight=F.col("model_span").cast("int")).select("trace", "id", F.col("below").alias("models_below"))
    leaves = tree.join(below, ["trace", "id"])
    calls = climbed(leaves, node="id", parent="parent", keys=["trace"], weight=(F.col("model_span") & (F.col("models_below") == 0)).cast("int")).select("trace", "id", F.col("below").alias("calls_below"))
    inherited = nearest_above(tree, F.col("own_run"), node="id", parent="parent", keys=["trace"]).withColumnRenamed("answer", "above_run")
    alone = tree.where("own_run IS NOT NULL").groupBy("trace").agg(F.count_distinct("own_run").alias("runs"), F.min("own_run").alias("only_run"))
    read = read.join(calls, ["trace", "id"]).join(inherited, ["trace", "id"]).join(alone, "trace", "left")
    kind = F.when(F.col("tool"), "tool").when(F.col("model_span"), F.when(F.col("calls_below") == 0, "model").otherwise("aggregate")).when(F.col("calls_below") >= 2, "aggregate").otherwise("other")
    content = lambda name: F.try_element_at("own.held", F.lit(name))
    messages = F.filter(_items(F.col("span"), "$.events"), lambda e: F.try_variant_get(e, "$.name", "string") == RESULT_EVENT)
    said = lambda name: F.get(F.transform(F.filter(F.flatten(F.transform(messages, lambda e: F.coalesce(_items(e, "$.attributes"), F.array().cast("array<variant>")))), lambda a: F.try_variant_get(a, "$.key", "string") == name), lambda a: _scalar(F.try_variant_get(a, "$.value", "variant"))), 0)
    result = F.coalesce(content(RESULT), said(RESULT), said("content"))

    def opened(text: Column) -> Column:
        """Content as a value; a string that spells an object or a list is that."""
        value = F.try_parse_json(text)
        spelled = F.when(F.startswith(text, F.lit('"')), F.trim(F.try_variant_get(value, "$", "string")))
        return F.coalesce(F.when(spelled.rlike(r"^[\[{]"), F.try_parse_json(spelled)), value)

    bytes_of = F.when(F.startswith("_result", F.lit('"')), F.octet_length(F.try_variant_get(F.try_parse_json("_result"), "$", "string"))).otherwise(F.octet_length(F.to_json(F.try_parse_json("_result"))))
    code = F.coalesce(F.try_variant_get("span", "$.status.code", "string"), F.lit("0"))
    nanos = lambda name: F.when(F.try_variant_get("span", f"$.{name}", "string").rlike(_INT), F.try_variant_get("span", f"$.{name}", "string").try_cast("bigint"))
    # In whole numbers: nanoseconds of today are more than a double can tell apart.
    ms = lambda name: F.call_function("div", nanos(name) - F.pmod(nanos(name), F.lit(1_000_000)), F.lit(1_000_000))
    read = read.withColumns({"kind": kind, "_result": result, "start_ms": ms("startTimeUnixNano"), "end_ms": ms("endTimeUnixNano")})
    has_result = F.when(F.col("kind") == "tool", F.col("_result").isNotNull()).when(F.col("kind").isin("model", "aggregate"), F.coalesce("finish_reason", F.col("tokens_out").cast("string")).isNotNull()).otherwise(False)
    used = F.coalesce("tokens_in", "tokens_out").isNotNull() & F.col("kind").isin("model", "aggregate")
    events = read.select(
        F.coalesce("above_run", F.when(F.col("runs") == 1, F.col("only_run")), "trace").alias("run_id"),
        F.col("id").alias("event_id"),
        "kind",
        F.coalesce(F.when(F.col("kind") == "tool", F.col("tool_name")), _text(F.col("span"), "$.name")).alias("name"),
        "model",
        F.when(code.isin(*_ERRORS), "error").when(code.isin(*_FINE) | has_result, "ok").otherwise("unknown").alias("status"),
        "start_ms",
        "end_ms",
        (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        F.col("parent").alias("parent_id"),
        "tool_call_id",
        "error_type",
        "finish_reason",
        F.when(used, F.lit(token_basis)).alias("token_basis"),
        *COUNTS,
        value_hash(opened(content(ARGUMENTS))).alias("args_hash"),
        value_hash(opened(F.col("_result"))).alias("result_hash"),
        bytes_of.cast("bigint").alias("result_bytes"),
        F.to_json(F.struct(F.struct(F.col("trace").alias("trace_id"), F.col("operation").alias("operation_name")).alias("otlp"))).alias("scope"),
    )
    return shaped(events), problems


def files(spark: SparkSession, paths: str | list[str], *, lines: bool) -> DataFrame:
    """file, pos and value of files: a document each, or a line each with its place; blank lines are left out."""
    if lines:
        return sessions.lines(spark, paths).where(F.trim("value") != "")
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("bigint").alias("pos"), F.regexp_replace("value", "^﻿", "").alias("value"))
