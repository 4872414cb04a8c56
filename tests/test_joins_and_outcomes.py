from datetime import datetime, timedelta
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.operators import asof, backtest as bt, gates, outcomes, touch
from barlab.operators.votes import Strategy, vote_signals
from barlab.plans import search
from helpers import bars, frame, series


def test_asof_join_matches_merge_asof(spark):
    rnd = random.Random(2)
    t0 = datetime(2024, 1, 1)
    left = pd.DataFrame([(s, t0 + timedelta(minutes=rnd.randint(0, 3000)), n) for n in range(80) for s in "AB"], columns=["symbol", "ts", "n"])
    right = pd.DataFrame([(s, t0 + timedelta(minutes=m), float(m)) for s in "A" for m in sorted(rnd.sample(range(3000), 40))], columns=["symbol", "ts", "v"])
    got = asof.asof_join(spark.createDataFrame(left), [(spark.createDataFrame(right), ["v"])], ["symbol"], 3600).toPandas().sort_values(["symbol", "ts", "n"])
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="symbol").sort_values(["symbol", "ts", "n"])
    assert list(got["v"].fillna(-1)) == list(want["v"].fillna(-1))


@pytest.mark.parametrize("horizon", [None, 7, 40])
def test_first_touch_matches_scan(spark, monkeypatch, horizon):
    monkeypatch.setattr(touch, "CHUNK", 4)  # several pyramid levels on a short series
    rows = series(150, 8)
    data = bars(spark, rows)
    entries = data.select("symbol", "timeframe", "bar_idx", (F.col("close") + 4).alias("up"), (F.col("close") - 3).alias("down"))
    got = frame(touch.first_touch(entries, data, "up", "down", horizon))
    for i, r in got.iterrows():
        last = len(rows) if horizon is None else min(len(rows), i + 1 + horizon)
        hit = next((k for k in range(i + 1, last) if rows[k][4] >= r["up"] or rows[k][5] <= r["down"]), None)
        assert (None if pd.isna(r["hit_idx"]) else int(r["hit_idx"])) == hit
        if hit is not None:
            assert r["hit_upper"] == (rows[hit][4] >= r["up"]) and r["hit_lower"] == (rows[hit][5] <= r["down"])


def test_stop_wins_inside_one_bar(spark):
    rows = [("A", "H1", datetime(2024, 1, 1), 10.0, 10.0, 10.0, 10.0, 1, 0, 2), ("A", "H1", datetime(2024, 1, 1, 1), 10.0, 15.0, 5.0, 10.0, 1, 1, 2)]
    data = bars(spark, rows)
    for side in ("BUY", "SELL"):
        e = data.filter("bar_idx = 0").withColumn("direction", F.lit(side))
        assert outcomes.barrier_outcome(e, data, F.lit(2.0), F.lit(2.0)).first()["outcome"] == "LOSS"


def test_excursions_over_long_trades(spark):
    rows = series(900, 9)
    data = bars(spark, rows)
    t = data.filter("bar_idx in (3, 250, 255, 600)").withColumns({"direction": F.lit("BUY"), "exit_idx": F.col("bar_idx") + F.when(F.col("bar_idx") == 3, 800).otherwise(20)})
    for r in outcomes.excursions(t, data).collect():
        span = rows[r["bar_idx"] + 1: r["exit_idx"] + 1]
        assert r["max_high"] == max(x[4] for x in span) and r["min_low"] == min(x[5] for x in span)


@pytest.mark.parametrize("keep", [True, False])
def test_daily_lock_matches_loop(spark, keep):
    rnd = random.Random(4)
    rows = [("A", "H1", datetime(2024, 1, 1) + timedelta(hours=i), rnd.random() < 0.2) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp, loss boolean")
    got = frame(gates.daily_lock(df, F.col("loss"), keep), "ts")["ts"]
    want, locked = [], None
    for _, _, ts, loss in rows:
        if locked == ts.date():
            continue
        if loss:
            locked = ts.date()
            if not keep:
                continue
        want.append(ts)
    assert list(got) == want


def _loop_backtest(rows, signals, sl, tp, risk, info, lo, hi):
    """The position machine bar by bar."""
    cap, pos, ep, lot, out = 10000.0, 0, 0.0, 0.0, []
    unit = info.pip / info.tick_size * info.tick_value
    size = lambda: round(max(info.lot_min, round(cap * risk / 100 / (sl * unit) / info.lot_step) * info.lot_step), 2)
    for i in range(lo + 1, hi):
        high, low, close, sig = rows[i][4], rows[i][5], rows[i][6], signals.get(i, 0)
        if pos:
            stop = low <= ep - sl * info.pip if pos == 1 else high >= ep + sl * info.pip
            goal = high >= ep + tp * info.pip if pos == 1 else low <= ep - tp * info.pip
            if stop or goal:
                pips = -sl if stop else tp
                cap += pips * unit * lot
                out.append((i, float(pips)))
                pos = 0
        if pos == 0 and sig:
            lot, ep, pos = size(), close + (info.spread_price if sig == 1 else 0), sig
        elif pos and sig == -pos:
            pips = ((close - ep) if pos == 1 else (ep - close - info.spread_price)) / info.pip
            cap += pips * unit * lot
            out.append((i, pips))
            lot, ep, pos = size(), close + (info.spread_price if sig == 1 else 0), sig
    if pos:
        pips = ((rows[hi - 1][6] - ep) if pos == 1 else (ep - rows[hi - 1][6] - info.spread_price)) / info.pip
        cap += pips * unit * lot
        out.append((hi - 1, pips))
    return cap, out


def test_positions_match_bar_loop(spark, monkeypatch):
    monkeypatch.setattr(bt, "BLOCK", 50)  # several blocks, so that state is carried
    rows, rnd = series(420, 10), random.Random(11)
    info = bt.SymbolInfo(pip=0.1, spread_price=0.05, tick_value=1.0, tick_size=0.1)
    signals = {i: rnd.choice((1, -1)) for i in range(100, 420) if rnd.random() < 0.15}
    data = bars(spark, rows)
    sig = spark.createDataFrame([("s", "A", "H1", i, v) for i, v in signals.items()], "strategy_id string, symbol string, timeframe string, bar_idx bigint, signal int")
    risk = spark.createDataFrame([("s", 25, 40, 2.0)], "strategy_id string, stop_loss int, take_profit int, risk_per_trade double")
    trades = bt.trade_list(sig, data, risk, info)
    got = {k: g.sort_values("bar_idx") for k, g in trades.toPandas().groupby("segment")}
    cut = max(200, min(int(420 * 0.7), 420 - 100))
    for seg, lo, hi in (("full", 0, 420), ("train", 0, cut), ("test", cut, 420)):
        cap, want = _loop_backtest(rows, signals, 25, 40, 2.0, info, lo, hi)
        g = got[seg]
        assert [(int(a), round(b, 6)) for a, b in zip(g["exit_idx"], g["pips"])] == [(a, round(b, 6)) for a, b in want]
        assert abs(g["capital"].iloc[-1] - cap) < 1e-6


def test_short_series_are_not_backtested(spark):
    assert bt.segments(bars(spark, series(150, 1))).count() == 0


def test_votes_share_requests_and_wait_for_warmup(spark):
    data = bars(spark, series(300, 12))
    p = lambda **k: tuple(sorted(k.items()))
    plan = [Strategy("a", "H1", "x", "", (("RSI", p(period=14, overbought=60, oversold=40)), ("EMA", p(period=150)))), Strategy("b", "H1", "x", "", (("RSI", p(period=14, overbought=90, oversold=10)),)),
            Strategy("c", "H1", "x", "", (("PARABOLIC_SAR", p(af_start=0.02)), ("ICT_STRUCTURE", p(lookback=5)), ("FVG", ())))]
    out = frame(vote_signals(data, plan, "H1"), "strategy_id", "bar_idx")
    first = out.groupby("strategy_id")["bar_idx"].min()
    assert first["a"] >= 150 and first["c"] >= 100
    assert set(out["signal"]) <= {1, -1}


def test_exhaustive_ranks_children_with_parents(spark):
    """The evaluator is pluggable: score by stop distance."""
    plan = search.planned(["H1"], variants=1, limit=6)

    def score(strategies):
        return spark.createDataFrame([(s.id, "A", "H1", 50, float(s.stop_loss)) for s in strategies], "strategy_id string, symbol string, timeframe string, trades int, score double")

    out = search.exhaustive(score, plan, keep=4, mutations=3).toPandas()
    assert list(out["rank"]) == [1, 2, 3, 4] and list(out["score"]) == sorted(out["score"], reverse=True)
    assert out["score"].iloc[0] >= max(s.stop_loss for s in plan)
    history = search.generational(score, plan[:4], generations=3).toPandas()
    assert history["strategy_id"].is_unique and history["generation"].max() == 2
    best = search.optimise_candidates(score, plan[:3], steps=3).toPandas()
    assert set(best["candidate"]) <= {s.id for s in plan[:3]} and (best["score"] > 15).all()
