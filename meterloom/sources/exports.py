"""Exports of other tools as events, and pages of provider accounts as usage and cost rows.

All take rows of JSON text, so what they read may be files, a stream or a column. Text that is no JSON of
the expected shape gives a problem row, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.functions.numbers import tolerant_int
from meterloom.functions.text import value_hash
from meterloom.operators.components import checkpointed
from meterloom.operators.trees import with_below
from meterloom.sources.sessions import EVENT_COLUMNS, shaped

#: Fixed values of the observation export: types, and names under which it tells tools and cached tokens.
GENERATIONS, TOOLS = ("GENERATION", "EMBEDDING"), ("TOOL",)
SPANS = ("SPAN", "AGENT", "CHAIN", "RETRIEVER", "EVALUATOR", "GUARDRAIL")
TOOL_KEYS = ("tool", "tool_name", "toolName", "tool_call_id", "toolCallId", "tool_use_id", "toolUseId")
CALL_ID_KEYS = ("tool_call_id", "toolCallId", "tool_use_id", "toolUseId")
CACHE_READ = ("input_cached_tokens", "cache_read_input_tokens", "input_cache_read", "cached_tokens")
CACHE_WRITE = ("cache_creation_input_tokens", "input_cache_creation", "input_cache_write")
LEGACY = ("promptTokens", "completionTokens", "totalTokens")
BASIS = "input_excludes_cache_read"


def _get(source: str | Column, path: str) -> Column:
    return F.get_json_object(F.col(source) if isinstance(source, str) else source, f"$.{path}")


def _fields(source: str | Column, names: Sequence[str]) -> Column:
    """The texts of some fields of a JSON object as a struct, read in one pass where a path for each would read the
    whole text again; a field with a dot lies in an object within, one that ends in [] is a list of texts."""
    inner: dict[str, list[str]] = {}
    for name in names:
        head, _, rest = name.partition(".")
        inner.setdefault(head, []).extend([rest] if rest else [])
    kinds = [f"`{head}` struct<{', '.join(f'`{r}`: string' for r in rest)}>" if rest else f"`{head[:-2]}` array<string>" if head.endswith("[]") else f"`{head}` string" for head, rest in inner.items()]
    return F.from_json(source, ", ".join(kinds))


def _each(rows: DataFrame, listed: Column, name: str) -> DataFrame:
    """rows with `name`, a row for each element of a list, nulls included. Spark evaluates a filter, and the one that it
    adds to a plain explode, below the projections, where each field would be parsed out of its text again."""
    return rows.select("*", F.posexplode_outer(listed).alias("_at", name)).where("_at IS NOT NULL").drop("_at")


def _kept(rows: DataFrame, good: Column) -> DataFrame:
    """Rows for which a condition holds, evaluated once, as in _each."""
    held = rows.select(F.when(good, F.array(F.struct(*rows.columns))).alias("_held"))
    return _each(held, F.col("_held"), "_row").select("_row.*")


def _whole(text: str) -> Column:
    """A whole number out of its text, 5.0 included."""
    return F.coalesce(F.col(text).try_cast("bigint"), F.regexp_extract(text, r"^(-?\d+)\.0+$", 1).try_cast("bigint"))


def text_parts(rows: DataFrame, value: str = "value") -> DataFrame:
    """rows with one JSON object each in `value`: an array, a page {data: [...]} or an object taken apart."""
    whole = F.trim(F.col(value))
    listed = F.when(F.startswith(whole, F.lit("[")), whole).otherwise(_get(whole, "data"))
    parts = F.coalesce(F.from_json(listed, "array<variant>"), F.when(F.startswith(whole, F.lit("{")) & listed.isNull(), F.array(F.try_parse_json(whole))))
    others = [c for c in rows.columns if c != value]
    return rows.select(*others, F.posexplode_outer(parts).alias("part", "v")).withColumn(value, F.to_json("v")).drop("v")


def csv_parts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The rows of CSV files as JSON objects in `value`; dotted column names are objects, cells that hold JSON
    are taken as such, empty ones are left out."""
    read = spark.read.csv(paths, header=True, multiLine=True, escape='"')
    heads: dict[str, list[str]] = {}
    for c in read.columns:
        heads.setdefault(c.partition(".")[0], []).append(c)
    entries = []
    for head, columns in heads.items():
        if columns == [head]:
            json = F.when(F.col(f"`{head}`").rlike(r"^\s*[\[{]"), F.col(f"`{head}`")).otherwise(F.regexp_replace(F.to_json(F.array(F.col(f"`{head}`"))), r"^\[|\]$", ""))
            entries.append(F.when(F.col(f"`{head}`").isNotNull(), F.concat(F.lit(f'"{head}":'), json)))
        else:
            parts = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f'"{c.partition(".")[2]}":'), F.regexp_replace(F.to_json(F.array(F.col(f"`{c}`"))), r"^\[|\]$", ""))) for c in columns]
            entries.append(F.concat(F.lit(f'"{head}":{{'), F.concat_ws(",", *parts), F.lit("}")))
    return read.select(F.concat(F.lit("{"), F.concat_ws(",", *entries), F.lit("}")).alias("value"))


#: Where usage() looks: details and the older shape, each read as a struct of texts.
DETAILS, OLDER = ("input", "output", "total", *CACHE_READ, *CACHE_WRITE), ("unit", "input", "output", "total")


def usage(told: str, details: str, older: str) -> dict[str, Column]:
    """Tokens of an observation, their basis and the shape they were told in, out of columns with its texts (`told`:
    usageDetails, usage and LEGACY), with DETAILS and with OLDER.

    Details name disjoint parts, so input is without cached tokens; two names for one part leave it
    unknown. The older shape has counts without a basis, and none where its unit is not tokens."""
    of = lambda source, k: tolerant_int(F.col(f"{source}.{k}"))
    has_details = F.col(f"{told}.usageDetails").isNotNull()
    unit = F.upper(F.col(f"{older}.unit"))
    has_older = F.coalesce(*[F.col(f"{told}.{k}") for k in LEGACY], F.col(f"{told}.usage")).isNotNull()
    tokens = unit.isNull() | (unit == "TOKENS")
    pick = lambda key, old: F.when(has_details, of(details, key)).when(has_older & tokens, F.coalesce(of(told, old), of(older, key)))

    def single(keys: Sequence[str]) -> Column:
        held = F.array_compact(F.array(*[of(details, k) for k in keys]))
        return F.when(has_details & (F.size(held) == 1), F.try_element_at(held, F.lit(1)))

    counted = F.coalesce(*[of(details, k) for k in DETAILS]).isNotNull()
    return {
        "tokens_in": pick("input", "promptTokens"),
        "tokens_out": pick("output", "completionTokens"),
        "tokens_total": pick("total", "totalTokens"),
        "cache_read": single(CACHE_READ),
        "cache_write": single(CACHE_WRITE),
        "token_basis": F.when(has_details & counted, BASIS),
        "usage_shape": F.when(has_details, "v2").when(has_older, "legacy").otherwise("absent"),
    }


def _hash(value: str, path: str) -> Column:
    """Of a field's value; a text that has the field's name nowhere, plain or escaped, is not parsed for it."""
    named = F.contains(F.col(value), F.lit(f'"{path}"')) | F.contains(F.col(value), F.lit("\\u"))
    parsed = F.when(named, F.try_parse_json(value))
    return value_hash(F.try_variant_get(parsed, f"$.{path}", "variant"))


def _millis(text: str) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def observations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, problems) of observation rows, a JSON object in `value` each (text_parts). A row without id or
    trace is a problem. A span with a tool's metadata is a tool call, one that has a generation below it an
    aggregate, however far above."""
    names = ["id", "traceId", "parentObservationId", "type", "level", "name", "model", "startTime", "endTime", "inputTruncated", "outputTruncated", "metadata", "usageDetails", "usage", "output", *LEGACY]
    read = rows.select("value", _fields("value", names).alias("o"))
    bad = read.where("o.id IS NULL OR o.traceId IS NULL").select("value", F.lit("no_id_or_trace").alias("problem"))
    read = _kept(read, F.col("o.id").isNotNull() & F.col("o.traceId").isNotNull()).withColumns({"m": _fields("o.metadata", ["type", "kind", *TOOL_KEYS]), "details": _fields("o.usageDetails", DETAILS), "older": _fields("o.usage", OLDER)})
    word = F.lower(F.coalesce("m.type", "m.kind"))
    is_tool = F.coalesce(*[f"m.{k}" for k in TOOL_KEYS]).isNotNull() | F.coalesce(word == "tool", F.lit(False))
    upper = F.upper(F.coalesce("o.type", F.lit("")))
    first = F.when(upper.isin(*GENERATIONS), "model").when(upper.isin(*TOOLS) | (upper.isin(*SPANS) & is_tool), "tool").otherwise("other")
    cut = lambda name: F.lower(F.coalesce(f"o.{name}", F.lit(""))).isin("true", "1", "yes")
    label = lambda name: F.when(cut(name), "truncated").otherwise("full")
    level = F.col("o.level")
    # What is read of a row is told once, for the tree and for the events; the texts stay behind.
    good = checkpointed(
        read.select(
            F.col("o.traceId").alias("trace"),
            "o.id",
            F.col("o.parentObservationId").alias("parent"),
            upper.alias("type"),
            first.alias("kind"),
            "o.level",
            "o.name",
            "o.model",
            F.when(level.isNull(), "unknown").when(F.upper(level) == "ERROR", "error").otherwise("ok").alias("status"),
            _millis("o.startTime").alias("start_ms"),
            _millis("o.endTime").alias("end_ms"),
            F.when(first == "tool", F.coalesce(*[f"m.{k}" for k in CALL_ID_KEYS])).alias("tool_call_id"),
            *[c.alias(name) for name, c in usage("o", "details", "older").items()],
            _hash("value", "input").alias("args_hash"),
            label("inputTruncated").alias("args_label"),
            _hash("value", "output").alias("result_hash"),
            label("outputTruncated").alias("result_label"),
            F.octet_length("o.output").cast("bigint").alias("result_bytes"),
        ),
        "observations",
    )
    above_model = ancestors(good.where("kind = 'model'").select("trace", "parent"), good.select("trace", "id", "parent"))
    wraps = good.join(above_model.withColumn("_wraps", F.lit(True)), ["trace", "id"], "left")
    kind = F.when((F.col("kind") == "other") & F.col("type").isin(*SPANS) & F.col("_wraps"), "aggregate").otherwise(F.col("kind"))
    scope = F.to_json(F.struct(F.struct("type", "level").alias("observation")))
    same = ("name", "model", "status", "start_ms", "end_ms")
    rest = [c for c in good.columns if c not in ("trace", "id", "parent", "type", "kind", "level", *same)]
    events = wraps.select(F.col("trace").alias("run_id"), F.col("id").alias("event_id"), kind.alias("kind"), *same, F.col("parent").alias("parent_id"), *rest, scope.alias("scope"))
    return shaped(events), bad


def ancestors(starts: DataFrame, tree: DataFrame) -> DataFrame:
    """trace and id of all rows of tree (trace, id, parent) above `starts` (trace, parent), each once and however far."""
    met = starts.where("parent IS NOT NULL").select("trace", F.col("parent").alias("id")).distinct().withColumn("_met", F.lit(True))
    marked = tree.where("id IS NOT NULL").join(met, ["trace", "id"], "left").withColumn("_met", F.coalesce("_met", F.lit(False)))
    above = with_below(marked, F.col("_met"), node="id", parent="parent", keys=["trace"])
    return above.unionByName(marked.where("_met").select("trace", "id")).distinct()


#: Fields of a record of a bundle, with the types that they must have.
RECORD = {
    **dict.fromkeys(("id", "kind", "status", "parent_id", "name", "model", "provider", "adapter", "token_basis", "error_type", "error_code", "finish_reason", "tool_call_id", "native_tool_call_id"), "string"),
    **dict.fromkeys(("seq", "start_ms", "end_ms", "duration_ms", "tokens_in", "tokens_out", "tokens_total", "cache_read_tokens", "cache_write_tokens", "result_bytes", "preview_bytes"), "count"),
    **dict.fromkeys(("args_fingerprint", "result_fingerprint"), "fingerprint"),
    "scope": "object",
    "included_result_ids": "array",
    "raw": "any",
}
BUNDLE_KINDS = {"model_call": "model", "tool_call": "tool", "aggregate": "aggregate", "approval": "approval", "other": "other"}


def bundles(documents: DataFrame, versions: Sequence[str] = ("1",)) -> tuple[DataFrame, DataFrame]:
    """(events, problems) of record bundles, one JSON document in `value` with its `file`.

    A document without version, run or records is a problem as a whole. A record with an unknown field, a field
    of another type, or without id, kind and status is left out, and its place in the document told."""
    v = F.col("value")
    listed = F.from_json(_get(v, "records"), "array<variant>")
    whole = documents.select("file", "value", _get(v, "run_id").alias("run"), _get(v, "schema_version").alias("version"), listed.alias("records"))
    fault = F.when(F.try_parse_json(v).isNull(), "not_json").when(F.col("run").isNull(), "no_run_id").when(~F.coalesce(F.col("version").isin(*versions), F.lit(False)), "unknown_version").when(F.col("records").isNull(), "no_records")
    marked = whole.withColumn("problem", fault)
    refused = marked.where("problem IS NOT NULL").select("file", F.lit("").alias("pointer"), "problem")
    r = marked.where("problem IS NULL").select("file", "run", F.posexplode("records").alias("at", "rec")).withColumn("r", F.to_json("rec"))
    kinds = F.from_json("r", "map<string,variant>")
    name_of = F.schema_of_variant
    typed = []
    for name, kind in RECORD.items():
        own = F.try_element_at("fields", F.lit(name))
        shape = name_of(own)
        good = {"string": shape == "STRING", "count": shape.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "fingerprint": F.startswith(shape, F.lit("OBJECT")), "object": F.startswith(shape, F.lit("OBJECT")), "array": F.startswith(shape, F.lit("ARRAY")), "any": F.lit(True)}[kind]
        typed.append(F.when(F.map_contains_key("fields", F.lit(name)) & ~F.coalesce(good, F.lit(False)), F.lit(f"type:{name}")))
    r = r.withColumn("fields", kinds)
    unknown = F.array_sort(F.array_except(F.map_keys("fields"), F.array(*map(F.lit, RECORD))))
    lacking = [F.when(_get("r", k).isNull(), F.lit(f"missing:{k}")) for k in ("id", "kind", "status")]
    bad_kind = F.when(~F.coalesce(_get("r", "kind").isin(*BUNDLE_KINDS), F.lit(False)), "kind")
    labels = [F.when(_get("r", f"{k}_fingerprint").isNotNull() & ~F.coalesce(_get("r", f"{k}_fingerprint.representation").isin("full", "redacted", "truncated") & _get("r", f"{k}_fingerprint.hash").rlike("^[0-9a-f]+$"), F.lit(False)), f"fingerprint:{k}") for k in ("args", "result")]
    r = r.withColumn("problem", F.coalesce(F.when(F.col("fields").isNull(), "not_an_object"), F.when(F.size(unknown) > 0, F.concat(F.lit("unknown:"), F.element_at(unknown, 1))), *lacking, *typed, bad_kind, *labels))
    dropped = r.where("problem IS NOT NULL").select("file", F.concat(F.lit("/records/"), F.col("at").cast("string")).alias("pointer"), "problem")
    n = lambda k: _get("r", k).try_cast("bigint")
    kept = r.where("problem IS NULL")
    kind = F.coalesce(*[F.when(_get("r", "kind") == k, F.lit(v)) for k, v in BUNDLE_KINDS.items()])
    scope = F.col("fields")["scope"]
    events = kept.select(
        F.col("run").alias("run_id"),
        _get("r", "id").alias("event_id"),
        kind.alias("kind"),
        *[_get("r", k).alias(k) for k in ("name", "model", "status", "parent_id", "tool_call_id", "error_type", "finish_reason", "token_basis")],
        *[n(k).alias(k) for k in ("seq", "start_ms", "end_ms", "duration_ms", "tokens_in", "tokens_out", "tokens_total", "result_bytes")],
        n("cache_read_tokens").alias("cache_read"),
        n("cache_write_tokens").alias("cache_write"),
        *[_get("r", f"{k}_fingerprint.{f}").alias(f"{k}_{g}") for k in ("args", "result") for f, g in (("hash", "hash"), ("representation", "label"))],
        F.to_json(scope).alias("scope"),
        F.from_json(_get("r", "included_result_ids"), "array<string>").alias("included"),
    )
    return shaped(events), refused.unionByName(dropped)


def as_bundle(events: DataFrame, version: str = "1") -> DataFrame:
    """run_id and value: a bundle document for each run, which bundles() reads as the same events."""
    kind = F.element_at(F.create_map(*[F.lit(x) for k, v in BUNDLE_KINDS.items() for x in (v, k)]), F.col("kind"))
    plain = ["name", "model", "status", "parent_id", "tool_call_id", "error_type", "finish_reason", "token_basis", "seq", "start_ms", "end_ms", "duration_ms", "tokens_in", "tokens_out", "tokens_total", "result_bytes"]
    prints = [F.when(F.col(f"{k}_hash").isNotNull(), F.struct(F.col(f"{k}_hash").alias("hash"), F.col(f"{k}_label").alias("representation"))).alias(f"{k}_fingerprint") for k in ("args", "result")]
    record = F.struct(F.col("event_id").alias("id"), kind.alias("kind"), *plain, F.col("cache_read").alias("cache_read_tokens"), F.col("cache_write").alias("cache_write_tokens"), *prints, F.try_parse_json("scope").alias("scope"), F.col("included").alias("included_result_ids"))
    listed = F.array_sort(F.collect_list(F.struct("event_id", record.alias("r"))), lambda a, b: F.when(a["event_id"] < b["event_id"], -1).when(a["event_id"] > b["event_id"], 1).otherwise(0))
    by_run = events.select(*EVENT_COLUMNS).groupBy("run_id").agg(F.transform(listed, lambda x: x["r"]).alias("records"))
    return by_run.select("run_id", F.to_json(F.struct(F.lit(version).alias("schema_version"), "run_id", "records")).alias("value"))


def sniffed(head: Column, suffix: Column) -> Column:
    """The format of a file by its beginning: spans (a document, or a line for each), observations, a
    bundle, or a session; null where none fits. What a first line shows decides between the first two."""
    start, first = F.ltrim(head), F.substring_index(F.ltrim(head), "\n", 1)
    spans = F.contains(start, F.lit('"resourceSpans"')) & F.startswith(start, F.lit("{"))
    more = F.length(F.trim(F.substring(start, F.length(first) + 1, F.length(start)))) > 0
    whole_line = F.try_parse_json(first).isNotNull()
    csv_names = F.transform(F.split(first, ","), lambda c: F.substring_index(F.regexp_replace(F.trim(c), '"', ""), ".", 1))
    observed = F.when(suffix == "csv", F.size(F.array_intersect(csv_names, F.array(*map(F.lit, ("id", "traceId", "type"))))) == 3).otherwise(
        start.rlike(r"^[\[{]") & F.contains(start, F.lit('"traceId"')) & F.contains(start, F.lit('"startTime"')) & ~F.contains(start, F.lit('"spanId"')) & ~F.contains(start, F.lit('"resourceSpans"'))
    )
    bundle = F.startswith(start, F.lit("{")) & F.contains(start, F.lit('"schema_version"')) & F.contains(start, F.lit('"run_id"')) & F.contains(start, F.lit('"records"'))
    session = (suffix == "jsonl") & _get(first, "type").isNotNull() & F.coalesce(_get(first, "sessionId"), _get(first, "uuid")).isNotNull()
    return F.when(spans & ~(whole_line & more), "otlp-json").when(spans & whole_line, "otlp-jsonl").when(observed, "observations").when(bundle, "record-bundle").when(session, "session")


#: Counts of a result of a usage report.
USAGE_COUNTS = {
    "openai": ("num_model_requests", "input_tokens", "input_cached_tokens", "output_tokens"),
    "anthropic": ("request_count", "requests", "uncached_input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens"),
}


def usage_page(pages: DataFrame, provider: str) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of pages of an account's usage report (JSON in `value`): a row for each result of each
    bucket, with exclusive token classes, null where the page tells none."""
    told = pages.select(_fields("value", ["data[]"]).alias("p")).select("p.data")
    faults = told.where("data IS NULL").select(F.lit("no_data").alias("problem"))
    one = _each(told, F.col("data"), "b").select(_fields("b", ["starting_at", "start_time", "ending_at", "end_time", "results[]"]).alias("b"))
    if provider == "openai":
        start, end = (F.timestamp_seconds(F.col(f"b.{c}").try_cast("bigint")) for c in ("start_time", "end_time"))
    else:
        start, end = (F.try_to_timestamp(F.coalesce(f"b.{a}", f"b.{b}")) for a, b in (("starting_at", "start_time"), ("ending_at", "end_time")))
    end = F.coalesce(end, start + F.expr("INTERVAL 1 HOUR"))
    one = one.select(start.cast("timestamp_ntz").alias("bucket_start"), end.cast("timestamp_ntz").alias("bucket_end"), "b.results")
    broken = F.col("bucket_start").isNull() | F.col("results").isNull()
    faults = faults.unionByName(one.where(broken).select(F.lit("bad_bucket").alias("problem")))
    counts = USAGE_COUNTS[provider]
    within = ["ephemeral_5m_input_tokens", "ephemeral_1h_input_tokens"]
    names = ["model", "service_tier", "project_id", "workspace_id", *counts, *[f"cache_creation.{c}" for c in within]]
    r = _each(one, F.when(~broken, F.col("results")), "r").select("bucket_start", "bucket_end", _fields("r", names).alias("r"))
    whole = {c: _whole(f"r.{c}") for c in counts} | {c: _whole(f"r.cache_creation.{c}") for c in within}
    r = r.select("bucket_start", "bucket_end", "r.model", "r.service_tier", "r.project_id", "r.workspace_id", *[c.alias(k) for k, c in whole.items()])
    n = lambda k: F.when(F.col(k) >= 0, F.col(k))
    if provider == "openai":
        told, cached = n("input_tokens"), n("input_cached_tokens")
        classes = {"requests": n("num_model_requests"), "input_fresh": F.when(told.isNotNull(), F.greatest(told - F.coalesce(cached, F.lit(0)), F.lit(0))), "input_cached": cached, "input_cache_write": F.lit(None).cast("bigint"), "output": n("output_tokens")}
        scope = F.col("project_id")
    else:
        five, hour = (n(c) for c in within)
        written = F.when(five.isNotNull() | hour.isNotNull(), F.coalesce(five, F.lit(0)) + F.coalesce(hour, F.lit(0))).otherwise(n("cache_creation_input_tokens"))
        classes = {"requests": F.coalesce(n("request_count"), n("requests")), "input_fresh": n("uncached_input_tokens"), "input_cached": n("cache_read_input_tokens"), "input_cache_write": written, "output": n("output_tokens")}
        scope = F.col("workspace_id")
    return r.select("bucket_start", "bucket_end", "model", scope.alias("scope"), "service_tier", *[c.alias(k) for k, c in classes.items()]), faults


def cost_page(pages: DataFrame, provider: str) -> DataFrame:
    """Charges of pages of an account's cost report, in dollars; amounts in other currencies are left out.
    One provider tells cents, as text or number, the other dollars."""
    one = pages.select(_fields("value", ["data[]"]).alias("p")).transform(_each, F.col("p.data"), "b").select(_fields("b", ["starting_at", "start_time", "ending_at", "end_time", "results[]"]).alias("b"))
    at = lambda *names: F.coalesce(*[F.coalesce(F.timestamp_seconds(F.col(f"b.{c}").try_cast("bigint")), F.try_to_timestamp(f"b.{c}")) for c in names])
    start = at("starting_at", "start_time")
    told = one.select(start.alias("start"), at("ending_at", "end_time").alias("end"), "b.results")
    told = _each(told, F.when(F.col("start").isNotNull(), F.col("results")), "r")
    spans = told.select(F.col("start").cast("timestamp_ntz").alias("started"), F.coalesce("end", F.col("start") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("ended"), "r")
    rows = spans.withColumn("r", _fields("r", ["amount", "line_item", "description", "sku", "model"])).select("started", "ended", "r.*")
    rows = rows.withColumn("within", _fields(F.when(F.startswith("amount", F.lit("{")), F.col("amount")), ["value", "currency"]))
    amount = F.coalesce("within.value", F.when(~F.startswith("amount", F.lit("{")), F.col("amount"))).try_cast("decimal(24,8)")
    dollars = amount if provider == "openai" else amount / 100
    good = F.coalesce(F.lower("within.currency"), F.lit("usd")) == "usd"
    sku = F.coalesce("line_item", "description", "sku", F.lit("unknown"))
    return _kept(rows.select("started", "ended", sku.alias("sku"), "model", F.when(good & amount.isNotNull(), dollars).cast("decimal(18,6)").alias("usd"), (good & amount.isNotNull()).alias("good")), F.col("good")).drop("good")


def event_page(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of pages of single usage events: tokens exclusive of cached ones where input holds them,
    and what was charged, in dollars."""
    told = pages.select(_fields("value", ["usageEventsDisplay", "usageEvents"]).alias("p"))
    counts = ("inputTokens", "input_tokens", "cacheReadTokens", "cache_read_tokens", "cacheWriteTokens", "cache_write_tokens", "outputTokens", "output_tokens")
    fields = ["timestamp", "createdAt", "id", "usageEventId", "model", "chargedCents", "charged_cents", *counts, *[f"{own}.{c}" for own in ("tokenUsage", "token_usage") for c in counts]]
    one = _each(told, F.from_json(F.coalesce("p.usageEventsDisplay", "p.usageEvents"), "array<string>"), "e").select(_fields("e", fields).alias("e"))
    n = lambda *paths: F.coalesce(*[_whole(f"e.{p}") for p in paths])
    names = lambda a, b: n(f"tokenUsage.{a}", f"tokenUsage.{b}", f"token_usage.{a}", f"token_usage.{b}", a, b)
    cents = F.coalesce("e.chargedCents", "e.charged_cents").try_cast("decimal(24,8)")
    stamp = F.coalesce("e.timestamp", "e.createdAt")
    started = F.coalesce(F.timestamp_millis(stamp.try_cast("bigint")), F.try_to_timestamp(stamp)).cast("timestamp_ntz")
    id_ = F.coalesce("e.id", "e.usageEventId", F.concat_ws(":", stamp, F.coalesce("e.model", F.lit("unknown"))))
    one = one.select(started.alias("started"), id_.alias("event_id"), "e.model", cents.alias("cents"), names("inputTokens", "input_tokens").alias("told"), names("cacheReadTokens", "cache_read_tokens").alias("cached"), names("cacheWriteTokens", "cache_write_tokens").alias("written"), names("outputTokens", "output_tokens").alias("output"))
    told, cached, cents = F.col("told"), F.col("cached"), F.col("cents")
    rows = one.select(
        "started",
        "event_id",
        "model",
        F.when(told.isNull() | cached.isNull() | (cached > told), told).otherwise(told - cached).alias("input_fresh"),
        cached.alias("input_cached"),
        F.col("written").alias("input_cache_write"),
        "output",
        F.when(cents > 0, cents / 100).cast("decimal(18,6)").alias("usd"),
        cents.isNotNull().alias("_cents"),
    )
    parts = ("input_fresh", "input_cached", "input_cache_write", "output")
    empty = F.coalesce(*parts).isNull() & ~F.col("_cents")
    total = F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(c, F.lit(0)) for c in parts), F.lit(0)))
    bad = empty | F.col("started").isNull()
    return _kept(rows, ~bad).withColumn("total", total).drop("_cents"), rows.where(bad).select("event_id", F.lit("no_usage_or_time").alias("problem"))


def embedded_windows(lines: DataFrame) -> DataFrame:
    """Allowance readings within token_count records (JSON in `value`): the first and second window, if they can be
    true, the newest of each window and hour."""
    v = F.col("value")
    base = "payload.rate_limits"
    observed = F.try_to_timestamp(_get(v, "timestamp"))
    one = lambda key: F.struct(
        _get(v, f"{base}.{key}.used_percent").try_cast("double").alias("used"),
        _get(v, f"{base}.{key}.resets_at").try_cast("double").alias("reset"),
        _get(v, f"{base}.{key}.window_minutes").try_cast("bigint").alias("minutes"),
    )
    rows = lines.where(F.contains(v, F.lit("rate_limits"))).select(observed.alias("observed_at"), F.coalesce(_get(v, f"{base}.limit_id"), F.lit("codex")).alias("limit"), F.coalesce(_get(v, f"{base}.limit_name"), F.lit("Codex")).alias("name"), F.explode(F.array(one("primary"), one("secondary"))).alias("w"))
    rows = rows.select("observed_at", "limit", "name", "w.*").where((F.col("used").between(0, 100)) & (F.col("minutes") > 0) & (F.col("reset") > F.unix_micros("observed_at") / 1e6))
    label = F.concat("name", F.when(F.col("minutes") == 10_080, F.lit(" · weekly")).otherwise(F.concat(F.lit(" · "), F.floor(F.col("minutes") / 60).cast("string"), F.lit("h"))))
    key = F.concat_ws(":", "limit", F.col("minutes").cast("string"))
    told = rows.select(key.alias("window_key"), label.alias("label"), F.date_trunc("hour", "observed_at").alias("hour"), "observed_at", "used", F.timestamp_seconds("reset").alias("resets_at"), F.col("minutes").alias("window_minutes"))
    newest = told.groupBy("window_key", "hour").agg(F.max_by(F.struct("label", "observed_at", "used", "resets_at", "window_minutes"), F.struct("observed_at", "used")).alias("n"))
    return newest.select("window_key", "n.label", F.col("n.observed_at").cast("timestamp_ntz").alias("observed_at"), "n.used", F.col("n.resets_at").cast("timestamp_ntz").alias("resets_at"), "n.window_minutes")
