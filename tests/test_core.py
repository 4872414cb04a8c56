from datetime import datetime, timedelta
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barlab.core.blocks import KEY, index_bars, index_rows, running
from barlab.core.carry import carry_scan
from barlab.core.steps import with_indicators
from barlab.operators import carried, features as ft, indicators as ind, structure
from helpers import bars, close_to, ema, frame, series

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_index_is_gapless_and_ordered(spark):
    rows = [(s, "H1", datetime(2024, 1, 1) + timedelta(hours=h)) for s in "AB" for h in (0, 1, 5, 900, 5000, 9000)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp")
    out = frame(index_bars(df, 3600, block_rows=4), "symbol", "ts")
    assert list(out["bar_idx"]) == [0, 1, 2, 3, 4, 5] * 2
    assert set(out["n_bars"]) == {6}


@SLOW
@given(seed=st.integers(0, 1000), block=st.sampled_from([3, 7, 64]))
def test_running_matches_pandas(spark, seed, block):
    pdf = pd.DataFrame(series(40, seed), columns=["symbol", "timeframe", "ts", "open", "high", "low", "close", "v", "bar_idx", "n"])
    pdf["x"] = pdf["close"].where(pdf["v"] % 3 != 0)
    df = spark.createDataFrame(pdf[["symbol", "bar_idx", "close", "x"]]).withColumn("x", F.nanvl("x", F.lit(None))).withColumn("b", F.floor(F.col("bar_idx") / block))
    out = frame(running(df, ["symbol"], "b", ["bar_idx"], {"s": ("sum", F.col("close")), "m": ("max", F.col("close")), "l": ("last", F.col("x"))}))
    close_to(out["s"], list(pdf["close"].cumsum()))
    close_to(out["m"], list(pdf["close"].cummax()))
    close_to(out["l"], [None if v != v else v for v in pdf["x"].ffill()])
    before = frame(running(df, ["symbol"], "b", ["bar_idx"], {"l": ("last", F.col("x"))}, inclusive=False))
    close_to(before["l"], [None if v != v else v for v in pdf["x"].ffill().shift(1)])


@pytest.mark.parametrize("block", [50])
def test_results_do_not_depend_on_block_size(spark, block):
    data = bars(spark, series(700, 3), series(300, 4, "B"))
    steps = [ind.sma(20), ind.hma(16), ind.ema(9), ind.ema(200), ind.tema(5), ind.macd(), ind.rsi(), ind.adx(), ind.stoch_rsi(), ind.ichimoku(), ind.obv_trend(),
             structure.order_blocks(), structure.volume_profile(), ft.market_state(), ft.divergences()]
    cols = [c for s in steps for c in s.outputs if c != "market_state"]
    want = frame(with_indicators(data, *steps, block_rows=100_000))
    got = frame(with_indicators(data, *steps, block_rows=block))
    assert list(got["market_state"]) == list(want["market_state"])
    for c in cols:
        w = [None if v != v else v for v in want[c].astype(float)]
        close_to(got[c].astype(float), w, 1e-8)


def test_linear_recurrences_match_loops(spark):
    rows = series(400, 5)
    closes = [r[6] for r in rows]
    out = frame(with_indicators(bars(spark, rows), ind.ema(3), ind.ema(50), ind.atr(14), ind.dema(10), block_rows=64))
    close_to(out["ema_3"], ema(closes, 3))
    close_to(out["ema_50"], ema(closes, 50))
    tr = [rows[0][4] - rows[0][5]] + [max(b[4] - b[5], abs(b[4] - a[6]), abs(b[5] - a[6])) for a, b in zip(rows, rows[1:])]
    close_to(out["atr_14"], ema(tr, 14, gain=1 / 14))
    first = ema(closes, 10)
    second = ema([0.0 if v is None else v for v in first], 10)
    close_to(out["dema_10"], [None if a is None else 2 * a - b for a, b in zip(first, second)])


def test_short_and_flat_series(spark):
    flat = [("F", "H1", datetime(2024, 1, 1) + timedelta(hours=i), 5.0, 5.0, 5.0, 5.0, 1, i, 40) for i in range(40)]
    out = frame(with_indicators(bars(spark, series(1, 1, "One"), series(10, 1, "Ten"), flat), ind.sma(20), ind.ema(20), ind.rsi(), ind.stochastic(), ind.williams_r(), ind.cci(), ind.dema(8), ind.adx()))
    by = {k: g.reset_index(drop=True) for k, g in out.groupby("symbol")}
    assert by["One"][["sma_20", "ema_20", "rsi_14", "adx"]].isna().all().all()
    assert by["Ten"]["sma_20"].isna().all() and by["Ten"]["dema_8"].notna().sum() == 3  # too short for a second pass: plain EMA
    f = by["F"]
    assert f["rsi_14"].dropna().eq(50).all() and f["stoch_k"].dropna().eq(50).all() and f["williams_r"].dropna().eq(-50).all() and f["cci"].dropna().eq(0).all()


@pytest.mark.parametrize("block", [37])
def test_carried_lines_do_not_depend_on_blocks(spark, block):
    data = bars(spark, series(300, 6), series(150, 7, "B"))
    for fn, cols in ((carried.supertrend, ["supertrend", "supertrend_dir"]), (carried.parabolic_sar, ["sar", "sar_dir"])):
        want, got = frame(fn(data)), frame(fn(data, block_rows=block))
        for c in cols:
            assert list(want[c].fillna(-1)) == list(got[c].fillna(-1))


def test_carry_scan_that_never_forgets(spark):
    """A running total depends on every earlier row: rounds continue until the last block is right."""
    df = spark.createDataFrame([("A", i // 5, i, float(i)) for i in range(23)], "k string, b bigint, i bigint, x double")

    def step(pdf, state):
        total = state[0] + pdf["x"].cumsum()
        return pdf[["k", "i"]].assign(t=total), [float(total.iloc[-1])]

    out = frame(carry_scan(df, ["k"], "b", ["i"], step, [0.0], "k string, i bigint, t double"), "i")
    assert list(out["t"]) == [sum(range(i + 1)) for i in range(23)]


def test_signal_spacing(spark):
    idx = [1, 2, 3, 7, 8, 12, 13, 14, 30]
    df = spark.createDataFrame([("s", "A", "M1", i, 1) for i in idx], "strategy_id string, symbol string, timeframe string, bar_idx bigint, signal int")
    kept = frame(carried.space_signals(df, ["strategy_id", *KEY], 5, block_rows=4), "bar_idx")
    assert list(kept["bar_idx"]) == [1, 7, 12, 30]


def test_index_rows_without_key(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "x bigint")
    out = frame(index_rows(df, [], F.floor(F.col("x") / 9), ["x"], "pos", "n"), "x")
    assert list(out["pos"]) == list(range(50)) and set(out["n"]) == {50}


def test_carry_scan_runs_blocks_of_a_machine_that_never_forgets_few_times(spark):
    import pandas as pd

    from barlab.core.carry import carry_scan

    runs = spark.sparkContext.accumulator(0)
    rows = [("a", i // 4, i, float(i % 7 - 2)) for i in range(80)] + [("b", i // 4, i, 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "k string, block int, i int, x double")

    def step(pdf, state):
        runs.add(1)
        total, out = state[0], []
        for x in pdf["x"]:
            total = total * 1.01 + x  # every block's end depends on all that came before
            out.append(total)
        return pd.DataFrame({"k": pdf["k"], "i": pdf["i"], "total": out}), [total]

    got = {(r.k, r.i): r.total for r in carry_scan(df, ["k"], "block", ["i"], step, [5.0], "k string, i int, total double").collect()}
    for key in "ab":
        total = 5.0
        for k, _, i, x in rows:
            if k == key:
                total = total * 1.01 + x
                assert got[k, i] == total
    assert runs.value <= 6 * 23
