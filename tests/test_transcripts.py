"""Counters of growing files: a stream cut anywhere, the windows over whole files, and a walk line by line."""

import json
import random
import uuid

import pytest

from meterloom.streaming import ingest, transcripts

MADE = 1_704_067_200


def v7(seconds):
    return str(uuid.UUID(int=(int(seconds * 1000) << 80) | (7 << 76) | (2 << 62) | 5))


def iso(seconds):
    import datetime

    return datetime.datetime.fromtimestamp(seconds, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def line(kind, at, **payload):
    return json.dumps({"type": kind, "timestamp": iso(at) if at is not None else None, "payload": payload})


def count(at, total, last=None):
    names = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "total_tokens")
    held = {"last_token_usage": dict(zip(names, last or (5, 1, 1, 2, 7)))} | ({"total_token_usage": dict(zip(names, total))} if total else {})
    return line("event_msg", at, type="token_count", info=held)


def random_file(rng):
    lines, at, total = [], MADE, [0] * 5
    for _ in range(rng.randrange(5, 40)):
        at += rng.random() * 20
        kind = rng.choice(["meta", "turn", "started", "count", "count", "count", "count", "noise"])
        if kind == "meta":
            lines.append(line("session_meta", at, id=rng.choice([v7(at), "plain", None]), timestamp=iso(at)))
        elif kind == "turn":
            lines.append(line("turn_context", at, model=rng.choice(["m1", "m2" * 80, None])))
        elif kind == "started":
            lines.append(line("event_msg", at, type="task_started", turn_id=rng.choice([v7(at - rng.choice([0, 60])), None])))
        elif kind == "count":
            total = [t + rng.choice([0, 0, rng.randrange(30)]) for t in total] if rng.random() < 0.9 else [t // 2 for t in total]
            lines.append(count(at if rng.random() < 0.95 else None, rng.choice([total, total, total, None]), [rng.randrange(9) for _ in range(5)]))
        else:
            lines.append(rng.choice(["not json", "{}", line("event_msg", at, type="other")]))
    return lines


def walked(name, lines):
    """What the lines of one file say, read one after the other."""
    session, created, model, own, before, found = name, 0, "unknown", False, None, []
    parse = lambda x: __import__("datetime").datetime.fromisoformat(x).timestamp() if x else None
    made = lambda x: int(x.replace("-", "")[:12], 16) / 1000 if x and x[14:15] == "7" else None
    for pos, raw in enumerate(lines):
        try:
            data = json.loads(raw)
        except ValueError:
            continue
        payload, at = data.get("payload") or {}, parse(data.get("timestamp"))
        if data.get("type") == "session_meta":
            session = payload["id"] or session
            created = made(session) or parse(payload["timestamp"]) or 0
        elif data.get("type") == "turn_context":
            model = (payload["model"] or model)[:100]
        elif payload.get("type") == "task_started":
            own = own or (made(payload["turn_id"]) or at or 0) >= created - 5
        elif payload.get("type") == "token_count":
            info = payload["info"]
            told, was = info.get("total_token_usage"), before
            before = told or before
            if at is None or not own or (told and told == was):
                continue
            used = info["last_token_usage"]
            if told and was:
                grown = {k: told[k] - was[k] for k in told}
                used = grown if min(grown.values()) >= 0 else used
            cached, written = used["cached_input_tokens"], used["cache_write_input_tokens"]
            row = (max(0, used["input_tokens"] - cached - written), cached, written, used["output_tokens"])
            if sum(row):
                found.append((name, pos, session, model, round(at, 3), *row))
    return found


def shown(rows):
    return sorted((r.file, r.pos, r.session, r.model, round(r.at, 3), r.fresh, r.cached, r.written, r.output) for r in rows)


@pytest.fixture
def states(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, transcripts.STATE_STORE)
    yield
    spark.conf.set(name, was)


def test_streams_windows_and_a_walk_agree(spark, tmp_path, states):
    rng = random.Random(4)
    files = {f"f{i}": random_file(rng) for i in range(30)}
    files["empty"] = []
    rows = [(name, pos, value) for name, lines in files.items() for pos, value in enumerate(lines)]
    expected = sorted(x for name, lines in files.items() for x in walked(name, lines))
    schema = "file string, pos bigint, value string"
    assert shown(transcripts.transcript_usage(spark.createDataFrame(rows, schema)).collect()) == expected and len(expected) > 100
    at = {name: 0 for name in files}
    for step in range(4):  # each file grows by a few lines, so batches cut it anywhere
        part = []
        for name, lines in files.items():
            end = len(lines) if step == 3 else min(len(lines), at[name] + rng.randrange(15))
            part += [(name, pos, lines[pos]) for pos in range(at[name], end)]
            at[name] = end
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = transcripts.arriving_usage(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        ingest.start(stream, lambda df, i: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/check").awaitTermination()
    assert shown(spark.read.parquet(f"{tmp_path}/out").collect()) == expected


def test_limits_of_time(spark):
    lines = [line("event_msg", MADE, type="task_started"), *[count(MADE + i * 100, None) for i in range(10)]]
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, pos bigint, value string")
    found = transcripts.transcript_usage(rows, since=MADE + 150.0, now=MADE + 200.0).collect()
    assert [r.pos for r in found] == [3, 4, 5, 6] and {(r.fresh, r.cached, r.written, r.output) for r in found} == {(3, 1, 1, 2)}
    assert transcripts.transcript_usage(rows.where("false")).count() == 0
