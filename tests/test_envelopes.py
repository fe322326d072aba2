"""Mixed batches into several tables: cut off anywhere and tried again, in any order, with records that wait."""

import json
import random

import pytest
from pyspark.sql import functions as F

from meterloom.streaming import envelopes, ingest
from meterloom.streaming.envelopes import Route

REQUEST = Route("request", "id string, rev string, tokens bigint, seen timestamp", ["id"], ["rev"], ["id", "rev"], "seen")
LABEL = Route("label", "request_id string, name string, seen timestamp", ["request_id"], ["name"], ["request_id"], "seen", names="request", needs=["request_id"])
ROUTES = [LABEL, REQUEST]
SEEN = "2024-01-01T00:00:00Z"


def request(i, rev="1", install="a", **more):
    return (install, "request", json.dumps({"id": f"r{i}", "rev": rev, "tokens": i, "seen": SEEN} | more))


def label(i, name="x", install="b"):
    return (install, "label", json.dumps({"request_id": f"r{i}", "name": name, "seen": SEEN}))


RECORDS = [request(1), request(1), request(1, "2", "c"), label(1), label(2), label(2, "y"), label(2), request(2), label(99), request(3, seen="2999-01-01T00:00:00Z"), request(4, id=None), ("a", "request", "{oops"), ("a", "other", "{}"), (None, None, None)]
NAMES = "install_id string, record_type string, payload string"


def tables(spark, base):
    shown = lambda df, *columns: sorted(map(str, df.select(*columns).collect()))
    return [
        shown(envelopes.visible(spark, base, REQUEST), "install_id", "id", "rev", "tokens"),
        shown(envelopes.visible(spark, base, LABEL), "install_id", "request_id", "name"),
        shown(envelopes.waiting(spark, base, LABEL), "install_id", "request_id", "name"),
    ]


def totals(spark, base):
    kinds = ("received", "accepted", "duplicate", "refused", "deferred", "released")
    return {(r.install_id, r.record_type): tuple(r[k] for k in kinds) for r in envelopes.receipts(spark, base).groupBy("install_id", "record_type").agg(*[F.sum(k).alias(k) for k in kinds]).collect()}


def test_a_batch_that_is_cut_off_anywhere_and_tried_again(spark, tmp_path):
    rows = spark.createDataFrame(RECORDS, NAMES)
    whole = f"{tmp_path}/whole"
    envelopes.ingester(whole, ROUTES, parts=2)(rows, 0)
    expected = tables(spark, whole), totals(spark, whole)
    assert expected[0] == [
        ["Row(install_id='a', id='r1', rev='1', tokens=1)", "Row(install_id='a', id='r2', rev='1', tokens=2)", "Row(install_id='c', id='r1', rev='2', tokens=1)"],
        ["Row(install_id='b', request_id='r1', name='x')", "Row(install_id='b', request_id='r2', name='x')", "Row(install_id='b', request_id='r2', name='y')"],
        ["Row(install_id='b', request_id='r99', name='x')"],
    ]
    assert expected[1] == {("a", "request"): (6, 2, 1, 3, 0, 0), ("c", "request"): (1, 1, 0, 0, 0, 0), ("b", "label"): (5, 3, 1, 0, 1, 0), ("a", "other"): (1, 0, 0, 1, 0, 0), (None, ""): (1, 0, 0, 1, 0, 0)}

    for step in ("tables/request", "tables/label", "receipts"):
        base, calls = f"{tmp_path}/{step.replace('/', '-')}", []

        def stop(name, step=step, calls=calls):
            calls.append(name)
            if name == step and calls.count(name) == 1:
                raise RuntimeError("cut off")

        ingest_batch = envelopes.ingester(base, ROUTES, parts=2, stop_after=stop)
        with pytest.raises(RuntimeError):
            ingest_batch(rows, 0)
        assert tables(spark, base) == [[], [], []] and totals(spark, base) == {}
        for _ in range(2):  # and again after its commit
            ingest_batch(rows, 0)
        assert (tables(spark, base), totals(spark, base)) == expected


def test_order_and_cuts_into_batches_do_not_matter(spark, tmp_path):
    rng, found = random.Random(7), []
    for turn in range(2):
        rows, base = RECORDS[:], f"{tmp_path}/{turn}"
        rng.shuffle(rows)
        step = envelopes.ingester(base, ROUTES, parts=2)
        for i, at in enumerate(range(0, len(rows), 5)):
            step(spark.createDataFrame(rows[at : at + 5], NAMES), i)
        found.append(tables(spark, base))
        told = totals(spark, base)
        assert all(r[0] == sum(r[1:5]) for r in told.values())
        assert sum(r[1] + r[5] for r in told.values()) == len(found[-1][0]) + len(found[-1][1])
    assert found[0] == found[1] and len(found[0][2]) == 1


def test_a_stream_of_envelopes(spark, tmp_path):
    for i in range(0, len(RECORDS), 3):
        spark.createDataFrame(RECORDS[i : i + 3], NAMES).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(NAMES).option("maxFilesPerTrigger", 3).json(f"{tmp_path}/in")
    for _ in range(2):
        ingest.start(stream, envelopes.ingester(f"{tmp_path}/out", ROUTES, parts=2), f"{tmp_path}/check").awaitTermination()
    assert [len(x) for x in tables(spark, f"{tmp_path}/out")] == [3, 3, 1]


def test_winners_read_the_folders_of_touched_keys(spark, tmp_path):
    rows = spark.range(200).selectExpr("concat('k', id % 50) AS key", "concat('h', id) AS hash", "id AS calls", "timestamp '2024-01-01' AS observed_at")
    ingest.appender(f"{tmp_path}/l", f"{tmp_path}/bad", revision=["key", "hash"], keys=["key"], required=["key"], time="observed_at", parts=16)(rows, 0)
    touched = spark.createDataFrame([("k3",), (None,)], "key string")
    found = ingest.winners(spark, f"{tmp_path}/l", ["key"], ["calls"], touched, parts=16)
    assert [(r.key, r.calls) for r in found.collect()] == [("k3", 153)]
    assert len({f.split("/part-")[0] for f in spark.read.parquet(f"{tmp_path}/l").where(F.col("key") == "k3").select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}) == 1
    assert "PartitionFilters: [_part" in found._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        ingest.appender("x", "y", revision=["a"], keys=["b"], required=[], time="t")
