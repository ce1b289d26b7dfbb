"""Spark against SQL at the smallest scale, one representative per family (tools/check.py runs all)."""
import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ("daily_rollup_spread", "rotation_rollup", "feature_series", "panel_store", "incremental_extract", "roster_v1", "roster_v2",
         "block_events", "pressure_events", "persistent_deaths", "calendar_retreat", "observability_did", "mann_kendall", "pettitt",
         "wasserstein", "caliper_match", "ccf_masked", "circular_shift_null", "decoy_bridge", "ip_bridge", "pair_event_study",
         "content_digest", "stream_daily_rollup", "stream_spike_alerts")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    status, info = compare(spark, con, name, SF)
    assert status == "OK", info


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 170
