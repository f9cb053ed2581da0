"""Every registered query against its SQL, with default and with very narrow segments."""

from __future__ import annotations

import pytest

from tests.conftest import SMALL
from tests.oracle import connect, difference
from tickframe.plans import ORACLES, QUERIES

# Queries whose operators cut sessions into segments.
SEGMENTED = ("run_summary", "live_state", "phase_attribution", "dimension_changes", "death_edges",
             "equipment_changes", "boss_health_changes", "yaw_deltas_session", "yaw_unwrap",
             "hotbar_slots", "inventory_repair", "chunk_buckets", "action_hold", "action_lock_step",
             "camera_yaw", "camera_pitch", "ledger_gaps", "stream_summary")


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SMALL), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", SEGMENTED)
def test_matches_sql_over_many_segments(spark, duck, narrow_segments, name):
    assert difference(QUERIES[name](spark, SMALL), duck, ORACLES[name]) is None
