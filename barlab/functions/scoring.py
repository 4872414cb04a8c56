"""Strategy scores, robustness and advice as column expressions over result columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _least(x, y) -> Column:
    return F.least(x if isinstance(x, Column) else F.lit(float(x)), y if isinstance(y, Column) else F.lit(float(y)))


def _most(x, y) -> Column:
    return F.greatest(x if isinstance(x, Column) else F.lit(float(x)), y if isinstance(y, Column) else F.lit(float(y)))


def strategy_score(c: dict[str, Column]) -> Column:
    """Score 0..100 from a result row.

    ``c`` maps trades, profit, winrate, drawdown, drawdown_pct, sharpe, profit_factor, starting_capital,
    ending_capital, avg_win, avg_loss, degradation, consistency to columns. degradation is NULL when there was no
    train/test split; the pay-off ratio counts instead.
    """
    gain_pct = (c["ending_capital"] - c["starting_capital"]) / c["starting_capital"] * 100
    by_money = F.when(gain_pct > 0, _least(30, gain_pct * 0.6)).otherwise(_most(-10, gain_pct * 0.3))
    by_pips = F.when(c["profit"] > 0, _least(30, c["profit"] / 35)).otherwise(_most(-10, c["profit"] / 50))
    has_money = (c["starting_capital"] > 0) & (c["ending_capital"] > 0)
    earned = F.when(has_money, by_money).otherwise(by_pips)
    hits = _least(20, c["winrate"] * 25)
    pf = c["profit_factor"]
    factor = F.when(pf > 1, _least(15, (pf - 1) * 15)).when(pf > 0, _most(-5, (pf - 1) * 10)).otherwise(-5.0)
    sharpe = F.when(c["sharpe"] > 0, _least(15, c["sharpe"] * 5)).otherwise(_most(-5, c["sharpe"] * 3))
    fall = F.when(c["drawdown_pct"] > 0, _least(15, c["drawdown_pct"] * 0.5)).when(c["drawdown"] > 0, _least(15, c["drawdown"] / 35)).otherwise(0.0)
    n = c["trades"]
    count = F.when(n >= 100, 10.0).when(n >= 50, 7.0).when(n >= 20, 5.0).when(n >= 10, 3.0).when(n >= 5, 1.0).otherwise(-5.0)
    deg = c["degradation"]
    steady = F.when((deg >= 0.7) & (c["consistency"] >= 0.7), 10.0).when(deg >= 0.4, 5.0).when(deg > 0, 0.0).otherwise(-5.0)
    payoff = F.abs(c["avg_win"]) / F.nullif(F.abs(c["avg_loss"]), F.lit(0.0))
    ratio = F.when(payoff >= 2, 10.0).when(payoff >= 1.5, 7.0).when(payoff >= 1, 4.0).otherwise(0.0)
    total = earned + hits + factor + sharpe - fall + count + F.when(deg.isNotNull(), steady).otherwise(ratio)
    return F.when(n > 0, F.bround(_most(0, _least(100, total)), 1)).otherwise(0.0)


def robustness(train: Column, test: Column, oos: Column) -> tuple[Column, Column, Column]:
    """(penalty, robustness, adjusted score). Our own definition: a drop from train to test is penalised, the
    out-of-sample score stands in for the test score when present."""
    penalty = _most(0, train - test) / _most(train, 1)
    held = F.coalesce(oos, test)
    rob = (0.3 * train + 0.4 * test + 0.3 * held) * (1 - 0.5 * penalty)
    return penalty, rob, _least(rob, (test + held) / 2) * (1 - penalty)


def evaluation_verdict(score: Column) -> tuple[Column, Column]:
    pick = lambda a, b, c, d: F.when(score >= 60, a).when(score >= 40, b).when(score >= 20, c).otherwise(d)
    return pick("excellent", "acceptable", "mediocre", "poor"), pick("deploy", "continue_optimization", "major_revision", "abandon")


#: Advice codes in the order they are given.
ADVICE = ("low_winrate", "high_drawdown", "few_trades", "losing_profit_factor", "low_sharpe", "overfitting", "mild_degradation")


def advice(winrate: Column, drawdown: Column, trades: Column, profit_factor: Column, sharpe: Column, degradation: Column) -> Column:
    tests = (winrate < 0.4, drawdown > 500, trades < 30, profit_factor < 1, sharpe < 0.5, degradation < 0.4, (degradation >= 0.4) & (degradation < 0.7))
    return F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in zip(tests, ADVICE)]))
