"""Reports held against contracts that are data: a schema becomes one expression, which lists what is wrong and where."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.plans.evidence import issue_histogram
from meterloom.plans.registry import query, table

_ISSUE = "array<struct<path:string,message:string>>"
#: Names by which Spark tells the kinds of JSON values.
_KINDS = {"string": ("STRING",), "boolean": ("BOOLEAN",), "number": ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE")}


@dataclass(frozen=True)
class Value:
    """What a place may hold. kind: string, number, boolean, object, array, map (any names, each an `item`), or any. A
    string may have a pattern, allowed values and a greatest length; a number a value; an object fields, of which
    `required` have to be there; one that is `strict` has no others."""

    kind: str = "any"
    fields: Mapping[str, "Value"] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    strict: bool = False
    item: "Value | None" = None
    allowed: tuple[str, ...] = ()
    pattern: str = ""
    longest: int = 0
    equals: int | None = None


def _entries(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _is(kind: str, v: Column) -> Column:
    if kind in ("object", "map", "array"):  # a level is taken apart; the schema of a variant would read all levels
        return (_items(v) if kind == "array" else _entries(v)).isNotNull()
    told = F.schema_of_variant(v)
    fits = told.isin(*_KINDS[kind])
    return fits | F.startswith(told, F.lit("DECIMAL")) if kind == "number" else fits


def issues(schema: Value, v: Column, path: Column) -> Column:
    """The issues of a variant, an array of (path, message): fields by name, places of arrays in brackets. Nothing below
    a value of the wrong kind is looked at."""
    none = F.array().cast(_ISSUE)
    one = lambda wrong, message, where=path: F.when(wrong, F.array(F.struct(where.alias("path"), F.lit(message).alias("message")))).otherwise(none)
    if schema.kind == "any":
        return none
    text = F.try_variant_get(v, "$", "string")
    found = []
    if schema.allowed:
        found.append(one(~text.isin(*schema.allowed), "not_allowed"))
    if schema.pattern:
        found.append(one(~text.rlike(schema.pattern), "pattern"))
    if schema.longest:
        found.append(one(F.length(text) > schema.longest, "too_long"))
    if schema.equals is not None:
        found.append(one(~F.try_variant_get(v, "$", "double").eqNullSafe(F.lit(float(schema.equals))), "not_equal"))
    under = lambda name: F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f".{name}")))
    for name, inner in schema.fields.items():
        lacks = one(F.lit(True), "missing", under(name)) if name in schema.required else none
        # Bound to a name: as an expression a field would be taken out of its whole report wherever it is looked at.
        looked = lambda own, inner=inner, name=name, lacks=lacks: F.when(own.isNull(), lacks).otherwise(issues(inner, own, under(name)))
        found.append(F.get(F.transform(F.array(F.try_variant_get(v, f"$.{name}", "variant")), lambda own: looked(own)), F.lit(0)))
    if schema.strict:
        others = F.array_sort(F.array_except(F.map_keys(_entries(v)), F.array(*map(F.lit, schema.fields))))
        found.append(F.transform(others, lambda k: F.struct(path.alias("path"), F.concat(F.lit("unknown:"), k).alias("message"))))
    if schema.kind == "map" and schema.item:
        entries = F.map_entries(_entries(v))
        found.append(F.flatten(F.transform(entries, lambda e: issues(schema.item, e["value"], F.when(path == "", e["key"]).otherwise(F.concat(path, F.lit("."), e["key"]))))))
    if schema.kind == "array" and schema.item:
        found.append(F.flatten(F.transform(_items(v), lambda x, i: issues(schema.item, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
    inside = F.concat(*found) if found else none
    return F.when(_is(schema.kind, v), inside).otherwise(one(F.lit(True), f"not_{schema.kind}"))


_TEXT, _NUMBER, _TITLE = Value("string"), Value("number"), Value("string", pattern=r"(?s).")
_ITEM = Value("object", {"title": _TITLE, "priority": Value("string", allowed=("urgent", "today", "soon", "later")), "kind": Value("string", allowed=("reply", "deadline", "followup", "information")), "when": _TEXT, "project": _TEXT}, ("title",))
_DOMAIN = Value("object", {"items": Value("array", item=_ITEM), "empty_note": _TEXT})
_DAY = Value("object", {"date": _TITLE, "today": Value("boolean"), "shared_hours": _NUMBER, "entries": Value("array", item=Value("object", {"title": _TEXT, "dim": Value("boolean")}))}, ("date",))
_TASKS = Value("object", {"notice": _TEXT, "markdown": _TEXT, "sections": Value("map", item=_DOMAIN), "week": Value("object", {"days": Value("array", item=_DAY), "note": _TEXT}), "coverage": Value("array", item=Value("object", {"source": _TITLE, "status": _TEXT}, ("source",)))})
_MARKDOWN = Value("object", {"markdown": Value("string", pattern=r"\S"), "source": _TEXT}, ("markdown",))
_KEY = Value("string", pattern=r"(?s).", longest=200)
#: What every report is, and what each kind carries.
ENVELOPE = {
    "schema_version": Value("number", equals=1),
    "period_key": Value("string", pattern=r"^\d{4}-\d{2}(?:-\d{2})?$"),
    "subject_key": _KEY,
    "idempotency_key": _KEY,
    "title": Value("string", pattern=r"\S", longest=200),
    "produced_at": Value("string", pattern=r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)$"),
    "status": Value("string", allowed=("complete", "partial", "failed")),
    "coverage": Value("map"),
    "payload": Value("map"),
    "html": Value("string", longest=3_500_000),
}
_REQUIRED = tuple(name for name in ENVELOPE if name not in ("coverage", "html"))


def report(payload: Value, **extra: Value) -> Value:
    return Value("object", {**ENVELOPE, "payload": payload, **extra}, (*_REQUIRED, *(["html"] if "html" in extra else [])), strict=True)


CONTRACTS = {
    "tasks": report(_TASKS),
    "standup": report(_MARKDOWN),
    "readings": report(_MARKDOWN),
    "audit": report(Value("object", {"markdown": _TEXT}), html=Value("string", pattern=r"(?s).", longest=3_500_000), coverage=Value("object", {"presentation": _TEXT})),
}
MOST_ISSUES = 20


def checked(reports: DataFrame, now: Column, contracts: Mapping[str, Value] = CONTRACTS) -> DataFrame:
    """reports (kind, body: JSON text) with valid and issues, the first MOST_ISSUES: of the fields that all contracts
    share, of each one's own, and what a schema can't say: a date of no calendar, a report from the future.
    A kind without a contract is not known, a body that is no JSON has no place that could be named."""
    reports = reports.withColumn("_v", F.try_parse_json("body"))
    v, schemas = F.col("_v"), list(contracts.values())
    alike = {name: value for name, value in schemas[0].fields.items() if all(name in c.fields and c.fields[name] == value and (name in c.required) == (name in schemas[0].required) for c in schemas)}
    # What all share is one expression, not one for each contract.
    shared = issues(Value("object", alike, tuple(n for n in schemas[0].required if n in alike)), v, F.lit(""))
    own = F.array().cast(_ISSUE)
    for kind, schema in contracts.items():
        rest = Value("object", {n: c for n, c in schema.fields.items() if n not in alike}, tuple(n for n in schema.required if n not in alike))
        found = issues(rest, v, F.lit(""))
        if schema.strict:
            others = F.array_sort(F.array_except(F.map_keys(_entries(v)), F.array(*map(F.lit, schema.fields))))
            found = F.concat(found, F.transform(others, lambda k: F.struct(F.lit("").alias("path"), F.concat(F.lit("unknown:"), k).alias("message"))))
        own = F.when((F.col("kind") == kind) & _is("object", v), found).otherwise(own)
    listed = F.concat(shared, own)
    one = lambda wrong, path, message: F.when(F.coalesce(wrong, F.lit(False)), F.array(F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))).otherwise(F.array().cast(_ISSUE))
    at = F.try_to_timestamp(F.get_json_object("body", "$.produced_at"))
    day = F.get_json_object("body", "$.period_key")
    date = F.try_to_timestamp(F.when(F.length(day) == 7, F.concat(day, F.lit("-01"))).otherwise(day), F.lit("yyyy-MM-dd"))
    more = F.concat(listed, one(at > now + F.expr("INTERVAL 5 MINUTES"), "produced_at", "from_the_future"), one(day.rlike(ENVELOPE["period_key"].pattern) & date.isNull(), "period_key", "no_date"))
    found = F.when(~F.col("kind").isin(*contracts) | F.col("kind").isNull(), one(F.lit(True), "", "unknown_kind")).when(v.isNull(), one(F.lit(True), "", "not_json")).otherwise(more)
    return reports.withColumn("issues", F.slice(found, 1, MOST_ISSUES)).withColumn("valid", F.size("issues") == 0).drop("_v")


def _reports(spark, sf_dir) -> DataFrame:
    """A report for each order; what is wrong with it follows from its key."""
    key = F.col("o_orderkey")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    item = F.concat(F.lit('{"title":'), F.when(key % 5 == 0, "7").otherwise('"t"'), F.lit(',"priority":'), F.when(key % 3 == 0, '"never"').otherwise('"soon"'), F.lit("}"))
    day = F.concat(F.lit('{"date":"d","today":'), F.when(key % 7 == 0, '"yes"').otherwise("true"), F.lit("}"))
    tasks = F.concat(F.lit('{"sections":{"work":{"items":[{"title":"a"},'), item, F.lit(']},"home":{"items":'), F.when(key % 11 == 0, "{}").otherwise("[]"), F.lit('}},"week":{"days":['), day, F.lit(",{}]}}"))
    payload = F.when(key % 2 == 0, tasks).otherwise(F.when(key % 13 == 0, '{"markdown":"  "}').when(key % 17 == 0, "{}").otherwise('{"markdown":"m"}'))
    period = F.when(key % 19 == 0, "2024-02-31").when(key % 23 == 0, "2024").otherwise("2024-02")
    body = F.concat(
        F.lit('{"schema_version":'), F.when(key % 29 == 0, "2").otherwise("1"), F.lit(',"period_key":'), text(period), F.lit(',"subject_key":"s","idempotency_key":'), text(key.cast("string")),
        F.when(key % 31 == 0, "").otherwise(',"title":"T"'), F.lit(',"produced_at":'), F.when(key % 37 == 0, '"2999-01-01T00:00:00Z"').otherwise('"2024-02-01T09:00:00-05:00"'), F.lit(',"status":"complete"'), F.when(key % 41 == 0, ',"extra":1').otherwise(""), F.lit(',"payload":'), payload, F.when(key % 43 == 0, "").otherwise("}"),
    )
    return table(spark, sf_dir, "orders").select(key, F.when(key % 47 == 0, "other").when(key % 2 == 0, "tasks").otherwise("standup").alias("kind"), body.alias("body"))


_RULES_SQL = (
    ("", "unknown_kind", "k % 47 = 0"),
    ("", "not_json", "k % 47 > 0 AND k % 43 = 0"),
    ("schema_version", "not_equal", "fine AND k % 29 = 0"),
    ("period_key", "pattern", "fine AND k % 19 > 0 AND k % 23 = 0"),
    ("period_key", "no_date", "fine AND k % 19 = 0"),
    ("title", "missing", "fine AND k % 31 = 0"),
    ("produced_at", "from_the_future", "fine AND k % 37 = 0"),
    ("", "unknown:extra", "fine AND k % 41 = 0"),
    ("payload.sections.work.items[1].title", "not_string", "fine AND k % 2 = 0 AND k % 5 = 0"),
    ("payload.sections.work.items[1].priority", "not_allowed", "fine AND k % 2 = 0 AND k % 3 = 0"),
    ("payload.sections.home.items", "not_array", "fine AND k % 2 = 0 AND k % 11 = 0"),
    ("payload.week.days[0].today", "not_boolean", "fine AND k % 2 = 0 AND k % 7 = 0"),
    ("payload.week.days[1].date", "missing", "fine AND k % 2 = 0"),
    ("payload.markdown", "pattern", "fine AND k % 2 = 1 AND k % 13 = 0"),
    ("payload.markdown", "missing", "fine AND k % 2 = 1 AND k % 13 > 0 AND k % 17 = 0"),
)
_ISSUES_SQL = "o AS (SELECT o_orderkey AS k, o_orderkey % 47 > 0 AND o_orderkey % 43 > 0 AS fine, CASE WHEN o_orderkey % 47 = 0 THEN 'other' WHEN o_orderkey % 2 = 0 THEN 'tasks' ELSE 'standup' END AS kind FROM orders), i AS (" + " UNION ALL ".join(f"SELECT k, kind, '{path}' AS path, '{message}' AS message FROM o WHERE {holds}" for path, message, holds in _RULES_SQL) + ")"


def _issues(spark, sf_dir) -> DataFrame:
    found = checked(_reports(spark, sf_dir), F.lit("2024-03-01").cast("timestamp"))
    # A plain inline would bring a filter that looks at every report once more.
    return found.select("o_orderkey", "kind", F.inline_outer("issues")).where("message IS NOT NULL")


@query(f"WITH {_ISSUES_SQL} SELECT k AS o_orderkey, kind, path, message FROM i")
def report_issues(spark, sf_dir):
    """Every issue of every order's report."""
    return _issues(spark, sf_dir)


@query(f"""WITH {_ISSUES_SQL}, c AS (SELECT kind, CASE WHEN path = '' THEN '(body)' ELSE regexp_replace(path, '\\[\\d+\\]', '[]', 'g') END AS path, message, count(DISTINCT k) AS revisions FROM i GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY revisions DESC, path, message) AS INTEGER) AS place FROM c QUALIFY place <= 5""")
def report_issue_histogram(spark, sf_dir):
    return issue_histogram(_issues(spark, sf_dir), ["kind"], "o_orderkey", "path", "message")
