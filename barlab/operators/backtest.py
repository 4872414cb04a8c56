"""One-position backtest of signal lists.

Every signal is a candidate entry whose exit (stop, target or next opposite signal) is found in parallel. Which
candidates are really taken depends only on when the previous trade ended, so the sequential part runs over the
sparse candidates, and the compounding lot size over the taken trades.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.core.blocks import IDX, KEY, running
from barlab.core.carry import carry_scan
from barlab.functions.scoring import strategy_score
from barlab.operators.performance import max_drawdown, summarise
from barlab.operators.touch import first_touch
from barlab.session import cut

STARTING_CAPITAL = 10_000.0
BLOCK = 4096


@dataclass(frozen=True)
class SymbolInfo:
    """Trading conditions; the same for all symbols of a run."""

    pip: float = 0.0001
    spread_price: float = 0.0
    tick_value: float = 1.0
    tick_size: float = 0.00001
    lot_min: float = 0.01
    lot_step: float = 0.01


def segments(bars: DataFrame, share: float = 0.7, least: int = 200, tail: int = 100) -> DataFrame:
    """full, train and test bar ranges [lo, hi) per series; series shorter than ``least`` drop out."""
    sizes = bars.groupBy(*KEY).agg(F.max("n_bars").alias("n")).filter(F.col("n") >= least)
    cut = F.greatest(F.lit(least), F.least(F.floor(F.col("n") * share), F.col("n") - tail))
    part = lambda name, lo, hi: F.struct(F.lit(name).alias("segment"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))
    return (sizes.withColumn("_cut", F.least(cut, F.col("n")))
            .withColumn("s", F.explode(F.array(part("full", F.lit(0), F.col("n")), part("train", F.lit(0), F.col("_cut")), part("test", F.col("_cut"), F.col("n")))))
            .select(*KEY, "s.*").filter("hi > lo"))


def candidates(signals: DataFrame, bars: DataFrame, risk: DataFrame, info: SymbolInfo) -> DataFrame:
    """Signals with entry price and exit. ``risk`` holds strategy_id, stop_loss, take_profit (pips), risk_per_trade."""
    c = signals.join(bars.select(*KEY, IDX, "close"), [*KEY, IDX]).join(risk, "strategy_id")
    long_ = F.col("signal") == 1
    c = c.withColumn("entry", F.when(long_, F.col("close") + info.spread_price).otherwise(F.col("close")))
    sl, tp = F.col("stop_loss") * info.pip, F.col("take_profit") * info.pip
    c = c.withColumns({"_up": F.col("entry") + F.when(long_, tp).otherwise(sl), "_dn": F.col("entry") - F.when(long_, sl).otherwise(tp)})
    c = first_touch(c, bars, "_up", "_dn")
    stopped = F.when(long_, F.col("hit_lower")).otherwise(F.col("hit_upper"))
    c = c.withColumns({"touch_idx": F.col("hit_idx"), "stopped": stopped, "_neg": -F.col(IDX), "_nb": F.floor(-F.col(IDX) / BLOCK)})
    c = running(c, ["strategy_id", *KEY], "_nb", ["_neg"], {"_next_buy": ("last", F.when(long_, F.col(IDX))), "_next_sell": ("last", F.when(~long_, F.col(IDX)))}, inclusive=False)
    return c.withColumn("reverse_idx", F.when(long_, F.col("_next_sell")).otherwise(F.col("_next_buy"))).drop(
        "_up", "_dn", "hit_idx", "hit_upper", "hit_lower", "_neg", "_nb", "_next_buy", "_next_sell")


def run_positions(cands: DataFrame, bars: DataFrame, parts: DataFrame, info: SymbolInfo) -> DataFrame:
    """Taken trades per (strategy, series, segment): one position at a time, stop before target before reversal,
    open positions closed on the segment's last bar."""
    c = cands.join(parts, KEY).filter((F.col(IDX) > F.col("lo")) & (F.col(IDX) < F.col("hi")))
    touch = F.when(F.col("touch_idx") < F.col("hi"), F.col("touch_idx"))
    turn = F.when(F.col("reverse_idx") < F.col("hi"), F.col("reverse_idx"))
    by_touch = touch.isNotNull() & (turn.isNull() | (touch <= turn))
    c = c.withColumns({"exit_idx": F.coalesce(F.when(by_touch, touch).otherwise(turn), F.col("hi") - 1),
                       "reason": F.when(by_touch, F.when(F.col("stopped"), "stop").otherwise("target")).when(turn.isNotNull(), "reverse").otherwise("end"),
                       "_cb": F.floor(F.col(IDX) / BLOCK)})
    key = ["strategy_id", *KEY, "segment"]
    slim = c.select(*key, "_cb", IDX, "exit_idx", "reason")

    def take(pdf: pd.DataFrame, state: list[float]):
        free, keep = state[0], []
        for i, out, reason in zip(pdf[IDX], pdf["exit_idx"], pdf["reason"]):
            ok = i >= free
            keep.append(ok)
            if ok:
                free = float("inf") if reason == "end" else float(out)
        return pdf[keep][[*key, IDX]], [free]

    taken = carry_scan(slim, key, "_cb", [IDX], take, [-1.0], "strategy_id string, symbol string, timeframe string, segment string, bar_idx bigint")
    t = c.drop("_cb").join(taken, [*key, IDX])
    exits = bars.select(*KEY, F.col(IDX).alias("exit_idx"), F.col("close").alias("_xc"))
    t = t.join(exits, [*KEY, "exit_idx"])
    at_close = F.when(F.col("signal") == 1, F.col("_xc") - F.col("entry")).otherwise(F.col("entry") - F.col("_xc") - info.spread_price) / info.pip
    pips = F.when(F.col("reason") == "stop", -F.col("stop_loss").cast("double")).when(F.col("reason") == "target", F.col("take_profit").cast("double")).otherwise(at_close)
    return t.select(*key, IDX, "exit_idx", "signal", "reason", "stop_loss", "risk_per_trade", "entry", pips.alias("pips"))


def size_positions(trades: DataFrame, info: SymbolInfo, capital: float = STARTING_CAPITAL, block_rows: int = BLOCK) -> DataFrame:
    """Lot size from the capital before each trade, profit in money, and capital after it."""
    key = ["strategy_id", *KEY, "segment"]
    per_pip = info.pip / info.tick_size * info.tick_value

    def settle(pdf: pd.DataFrame, state: list[float]):
        cap, lots, money, after = state[0], [], [], []
        for sl, risk, pips in zip(pdf["stop_loss"], pdf["risk_per_trade"], pdf["pips"]):
            stop_value = sl * per_pip
            lot = info.lot_min if stop_value <= 0 else round(max(info.lot_min, round(cap * risk / 100.0 / stop_value / info.lot_step) * info.lot_step), 2)
            gain = pips * per_pip * lot
            cap += gain
            lots.append(lot), money.append(round(gain, 2)), after.append(cap)
        return pdf.drop(columns=["_start", "_cb"]).assign(lot=lots, pnl=money, capital=after), [cap]

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in trades.schema) + ", lot double, pnl double, capital double"
    return carry_scan(trades.withColumn("_cb", F.floor(F.col(IDX) / block_rows)), key, "_cb", [IDX], settle, [capital], ddl)


def summaries(settled: DataFrame, capital: float = STARTING_CAPITAL) -> DataFrame:
    """Result columns per strategy, series and segment."""
    key = ["strategy_id", *KEY, "segment"]
    base = summarise(settled, key).withColumnRenamed("profit", "profit_money")
    pips = settled.groupBy(*key).agg(F.sum(F.bround("pips", 1)).alias("profit"), F.max_by("capital", IDX).alias("ending_capital"))
    falls = max_drawdown(settled, key, F.floor(F.col(IDX) / BLOCK), [IDX], "pnl", capital).select(*key, F.col("max_drawdown").alias("drawdown"))
    df = base.join(pips, key).join(falls, key)
    return df.withColumns({"starting_capital": F.lit(capital), "drawdown_pct": F.bround(F.col("drawdown") / capital * 100, 2), "winrate": F.bround("winrate", 4),
                           "profit_factor": F.bround("profit_factor", 2), "sharpe": F.bround("sharpe", 4)})


def train_test(results: DataFrame) -> DataFrame:
    """Full-period results with degradation and consistency from the train and test segments, and the score."""
    key = ["strategy_id", *KEY]
    pick = lambda seg, c: F.coalesce(F.max(F.when(F.col("segment") == seg, F.col(c))), F.lit(0.0))
    wide = results.groupBy(*key).agg(*[pick(s, c).alias(f"{s}_{c}") for s in ("train", "test") for c in ("profit_money", "winrate")])
    tp, ep, tw, ew = (F.col(c) for c in ("train_profit_money", "test_profit_money", "train_winrate", "test_winrate"))
    wide = wide.withColumns({
        "degradation": F.bround(F.when((tp > 0) & (ep > 0), ep / tp).when(tp > 0, 0.0).otherwise(1.0), 4),
        "consistency": F.bround(F.when(tw > 0, F.least(F.lit(1.0), ew / tw)).when(ew == 0, 1.0).otherwise(0.0), 4)})
    df = results.filter("segment = 'full'").drop("segment").join(wide, key)
    names = ("trades", "profit", "winrate", "drawdown", "drawdown_pct", "sharpe", "profit_factor", "starting_capital", "ending_capital", "avg_win", "avg_loss", "degradation", "consistency")
    return df.withColumn("score", strategy_score({n: F.col(n) for n in names}))


def trade_list(signals: DataFrame, bars: DataFrame, risk: DataFrame, info: SymbolInfo, capital: float = STARTING_CAPITAL) -> DataFrame:
    """Signals to settled trades. Signals, candidates and trades are sparse, and each is read several times, so
    the lineage is cut after each of them."""
    cands = cut(candidates(cut(signals), bars, risk, info))
    return cut(size_positions(cut(run_positions(cands, bars, segments(bars), info)), info, capital))


def backtest(signals: DataFrame, bars: DataFrame, risk: DataFrame, info: SymbolInfo, capital: float = STARTING_CAPITAL) -> DataFrame:
    """Signals to scored results per strategy and series."""
    return train_test(summaries(trade_list(signals, bars, risk, info, capital), capital))
