"""What queries send between tasks, by their plans."""

import pytest

from meterloom import catalog

SF_DIR = "/root/testdata/sf0.001"


def planned(spark, name):
    return catalog.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ("request_groups", "usage_prices", "price_series"))
def test_requests_are_dealt_before_they_have_all_columns(spark, name):
    """By a hash, in their own few columns; what sends whole group keys takes four times as much."""
    sent = [line for line in planned(spark, name).splitlines() if "Exchange hashpartitioning(" in line]
    assert any("hashpartitioning(dealt" in line for line in sent)
    assert not any("agent_identity_basis" in line for line in sent)


@pytest.mark.parametrize("name", ("agent_groups", "project_rows", "request_periods"))
def test_requests_are_grouped_once(spark, name):
    """By what the rows have, without a finer grouping below."""
    assert not any("agent_identity_basis" in line or "cache_write_ttl" in line for line in planned(spark, name).splitlines() if "Exchange hashpartitioning(" in line)


def test_lines_are_not_sent_to_their_prices(spark):
    """A model with a third of all lines was read by one task."""
    plan = planned(spark, "price_rows")
    assert "BroadcastHashJoin" in plan and "hashpartitioning(l_returnflag" not in plan


def test_envelopes_are_taken_apart_once(spark):
    """Trees, runs and events of spans read what was written, none the table again."""
    assert "events.parquet" not in planned(spark, "span_trees")


def test_settings_are_dealt_to_all_tasks(spark):
    """A table of one row group was taken apart by one task."""
    assert "RoundRobinPartitioning" in planned(spark, "settings_leaves")
