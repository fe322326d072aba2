"""Feedback on changes, by rows whose answer is known."""

import pytest

from meterloom.plans import reviews

REVIEW = "change long, id long, login string, kind string, association string, state string, body string, submitted long, viewer string"
INLINE = "change long, id long, login string, kind string, association string, reply_to long, review long, created long, body string"
TALK = "change long, id long, login string, kind string, association string, created long, body string"


@pytest.fixture
def given(spark):
    said = [
        (1, 10, "ann", "User", "MEMBER", "CHANGES_REQUESTED", "fix <b>this</b>", 50, "Me"),
        (1, 11, "me", "User", "MEMBER", "COMMENTED", "done", 60, "ME"),
        (1, 12, "bob", "User", "MEMBER", "COMMENTED", "not sent", None, None),
        (None, 13, "ann", "User", "MEMBER", "CHANGES_REQUESTED", "no change", 50, "ann"),
    ]
    inline = [
        (1, 100, "ann", "User", "OWNER", None, 10, 40, "comes with its review"),
        (1, 101, "me", "User", "NONE", 100, None, 49, "answered before"),
        (1, 110, "ann", "User", "OWNER", None, 99, 40, "answered since"),
        (1, 111, "ME", "User", "NONE", 110, None, 41, "an answer"),
        (1, 112, "lint[bot]", "Bot", "NONE", None, 12, 40, "a bot's first"),
        (1, 113, "lint[bot]", "Bot", "NONE", 112, None, 41, "a bot's second"),
        (2, 120, "me", "User", "OWNER", None, None, 40, "no viewer is known"),
        (None, 130, "ann", "User", "OWNER", None, 13, 40, "no change, so no viewer"),
        (1, 140, "ann", "User", "OWNER", None, 10, None, "at no known time, as in SQL"),
        (1, None, "bob", "User", "OWNER", None, None, 40, "without a thread"),
        (1, None, "me", "User", "OWNER", None, None, 45, "without a thread"),
    ]
    talk = [(1, 200, "bob", "User", "MEMBER", 70, "a word"), (1, 201, "me", "User", "MEMBER", 71, "own"), (1, 202, "guest", "User", "NONE", 72, "not a member")]
    return spark.createDataFrame(said, REVIEW), spark.createDataFrame(inline, INLINE), spark.createDataFrame(talk, TALK)


def test_what_may_be_answered(given):
    got = reviews.feedback(*given, ["change"], "viewer")
    assert got.columns == ["change", "source", "id", "login", "arrived", "excerpt"]
    assert {(r.change, r.source, r.id, r.arrived) for r in got.collect()} == {
        (1, "review", 10, 50),
        (None, "review", 13, 50),
        (1, "inline", 100, 50),
        (1, "inline", 112, 40),
        (2, "inline", 120, 40),
        (None, "inline", 130, 40),
        (1, "inline", 140, None),
        (1, "inline", None, 40),
        (1, "conversation", 200, 70),
    }
    assert got.where("id = 10").first().excerpt == "fix this"


def test_reviews_that_stand_twice(given):
    """An inline comment meets each of them, as it does in SQL."""
    said, inline, talk = given
    got = reviews.feedback(said.unionByName(said.where("id = 10").selectExpr("* EXCEPT (submitted)", "30L AS submitted")), inline, talk, ["change"], "viewer")
    assert sorted(r.arrived for r in got.where("id = 100").collect()) == [50]
    assert sorted(r.arrived for r in got.where("id = 10").collect()) == [30, 50]
    got = reviews.feedback(said.unionByName(said), inline, talk, ["change"], "viewer")
    assert [r.arrived for r in got.where("id = 100").collect()] == [50, 50]


def test_rows_are_dealt_once(given, spark):
    """By their change: each join of inline comments sent them again."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reviews.feedback(*given, ["change"], "viewer")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plan.count("Exchange hashpartitioning(") == 1
