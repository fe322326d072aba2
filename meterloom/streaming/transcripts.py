"""Usage out of transcripts whose lines tell cumulative counters, in one go or as the lines arrive.

A line means what it does by what stood before it in its file: the session, the model of the turn, whether the
file's own work has begun (a copy starts with the history of another), and the counters told last. transcript_usage()
carries these by windows over a whole file; arriving_usage() keeps them as state for each file across
micro-batches, and gives the same rows wherever batches cut the file. Files of a stream have to arrive
in order, as files that only grow do."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from meterloom.functions.numbers import non_negative
from meterloom.functions.periods import uuid7_seconds

#: Counters of a usage object. What is billed apart is fresh, cached, written and output.
COUNTERS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "total_tokens")
LEAD_SECONDS, AHEAD_SECONDS, MODEL_CHARS = 5, 300, 100
_USAGE = "file string, pos bigint, session string, model string, at double, fresh bigint, cached bigint, written bigint, output bigint"
_STATE = "session string, created double, model string, started boolean, told string, " + ", ".join(f"{c} bigint" for c in COUNTERS)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _seconds(text: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(text)) / 1e6


def marks(lines: DataFrame) -> DataFrame:
    """What lines (file, pos, value) tell: kind (meta, turn, started, count), and the columns that each kind has.
    Other lines, and such as are no JSON, are left out."""
    get = lambda path: F.get_json_object("value", f"$.{path}")
    event = get("payload.type")
    kind = F.when(get("type") == "session_meta", "meta").when(get("type") == "turn_context", "turn").when(get("type") == "event_msg", F.when(event == "task_started", "started").when(event == "token_count", "count"))
    told, last = get("payload.info.total_token_usage"), get("payload.info.last_token_usage")
    counter = lambda held, c: non_negative(F.get_json_object(held, f"$.{c}").try_cast("double"))
    known = F.when(F.coalesce(F.size(F.json_object_keys(told)), F.lit(0)) > 0, F.to_json(F.try_parse_json(told)))
    return lines.select("file", "pos", "value", kind.alias("kind")).where("kind IS NOT NULL").select(
        "file",
        "pos",
        "kind",
        F.when(F.col("kind") == "meta", get("payload.id")).alias("session_id"),
        F.when(F.col("kind") == "meta", _seconds(get("payload.timestamp"))).alias("session_at"),
        F.when(F.col("kind") == "turn", F.substring(get("payload.model"), 1, MODEL_CHARS)).alias("model"),
        _seconds(get("timestamp")).alias("at"),
        F.when(F.col("kind") == "started", F.coalesce(uuid7_seconds(get("payload.turn_id")), _seconds(get("timestamp")), F.lit(0.0))).alias("begun"),
        F.when(F.col("kind") == "count", known).alias("told"),
        *[counter(told, c).alias(c) for c in COUNTERS],
        F.json_object_keys(last).isNotNull().alias("has_last"),
        *[counter(last, c).alias(f"last_{c}") for c in COUNTERS],
    )


def _billed(used: list[Column]) -> list[Column]:
    whole, cached, written, output = used[:4]
    return [F.greatest(whole - cached - written, F.lit(0)).alias("fresh"), cached.alias("cached"), written.alias("written"), output.alias("output")]


def transcript_usage(lines: DataFrame, *, since: float = 0.0, now: float = float("inf")) -> DataFrame:
    """file, pos, session, model, at and billed tokens of each count that adds something, of whole files."""
    order = Window.partitionBy("file").orderBy("pos")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda c, w: F.last(c, ignorenulls=True).over(w)
    rows = marks(lines).withColumn("session", F.coalesce(carried("session_id", upto), "file"))
    created = F.when(F.col("kind") == "meta", F.coalesce(uuid7_seconds("session"), "session_at", F.lit(0.0)))
    rows = rows.withColumn("created", created).withColumns({"created": F.coalesce(carried("created", upto), F.lit(0.0)), "model": F.coalesce(carried("model", upto), F.lit("unknown"))})
    rows = rows.withColumn("started", F.coalesce(F.bool_or(F.col("begun") >= F.col("created") - LEAD_SECONDS).over(upto), F.lit(False)))
    rows = rows.withColumn("was", carried(F.when(F.col("told").isNotNull(), F.struct("told", *COUNTERS)), before))
    rows = rows.where((F.col("kind") == "count") & F.col("started") & F.col("has_last") & F.col("at").between(since, now + AHEAD_SECONDS))
    rows = rows.where(~F.coalesce(F.col("told") == F.col("was.told"), F.lit(False)))
    grown = [F.col(c) - F.col(f"was.{c}") for c in COUNTERS]
    rises = F.col("told").isNotNull() & F.col("was").isNotNull() & (F.least(*grown) >= 0)
    used = [F.when(rises, g).otherwise(F.col(f"last_{c}")) for g, c in zip(grown, COUNTERS)]
    found = rows.select("file", "pos", "session", "model", "at", *_billed(used))
    return found.where("fresh + cached + written + output > 0")


class _Carried(StatefulProcessor):
    def __init__(self, since: float, now: float):
        # Workers have no session, which reads these out of their text.
        self.since, self.now = since, now
        self.held, self.names = StructType.fromDDL(_STATE), StructType.fromDDL(_USAGE).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("carried", self.held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (file,) = key
        held = self.state.get() if self.state.exists() else (file, 0.0, "unknown", False, None, *[0] * len(COUNTERS))
        session, created, model, started, told, *counters = held
        found = []
        for row in pd.concat(list(rows)).astype(object).sort_values("pos").itertuples(index=False):
            has = lambda x: x is not None and x == x
            if row.kind == "meta":
                session = row.session_id if has(row.session_id) else session
                made = _uuid7(session)
                created = made if made is not None else row.session_at if has(row.session_at) else 0.0
            elif row.kind == "turn":
                model = row.model if has(row.model) else model
            elif row.kind == "started":
                started = started or row.begun >= created - LEAD_SECONDS
            else:
                was, before = told, counters
                now_at = [int(getattr(row, c)) for c in COUNTERS]
                if has(row.told):
                    told, counters = row.told, now_at
                if not started or not row.has_last or not has(row.at) or not self.since <= row.at <= self.now + AHEAD_SECONDS:
                    continue
                used = [int(getattr(row, f"last_{c}")) for c in COUNTERS]
                if has(row.told) and was is not None:
                    if row.told == was:
                        continue
                    grown = [a - b for a, b in zip(now_at, before)]
                    used = grown if min(grown) >= 0 else used
                billed = [max(used[0] - used[1] - used[2], 0), *used[1:4]]
                if sum(billed):
                    found.append((file, int(row.pos), session, model, float(row.at), *billed))
        self.state.update((session, float(created), model, bool(started), told, *counters))
        if found:
            yield pd.DataFrame(found, columns=self.names)

    def close(self) -> None:
        pass


def _uuid7(text: str) -> float | None:
    digits = text.replace("-", "")[:12]
    try:
        return int(digits, 16) / 1000 if text[14:15] == "7" and len(digits) == 12 else None
    except ValueError:
        return None


def arriving_usage(lines: DataFrame, *, since: float = 0.0, now: float = float("inf")) -> DataFrame:
    """transcript_usage() of a stream of lines (file, pos, value). The session needs STATE_STORE as
    spark.sql.streaming.stateStore.providerClass. A task holds one file's new lines at a time."""
    return marks(lines).groupBy("file").transformWithStateInPandas(_Carried(since, now), StructType.fromDDL(_USAGE), "Append", "None")
