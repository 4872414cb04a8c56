"""A sample of the registered queries against DuckDB; tools/check.py runs all of them."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry
from barlab.catalog import load

SF = "/root/testdata/sf0.001"
SAMPLE = ["bars_hourly", "sma", "macd", "market_structure", "order_blocks", "supertrend", "trend_filter", "higher_timeframe_features", "temporal_split_results", "barrier_outcomes", "risk_audit",
          "trade_summary", "trade_drawdown", "overfit_report", "monte_carlo_bootstrap", "top_strategies", "robust_scaling", "event_cards", "insert_if_new", "feed_items", "nearest_vectors", "fitted_history"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")


def test_registry_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 180
    assert all(q.covers for q in load().values())


def test_entry(spark):
    assert {"symbol", "signals", "wins"} <= set(entry.entry(spark).columns)


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    from check import compare, duck

    assert compare(spark, duck(SF), load()[name], SF).startswith("ok")
