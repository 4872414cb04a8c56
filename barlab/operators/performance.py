"""Trade statistics: summary, profit factor, Sharpe ratio and drawdown."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profit_factor(pnl: str = "pnl") -> Column:
    won = F.sum(F.when(F.col(pnl) > 0, F.col(pnl)).otherwise(0.0))
    lost = F.abs(F.sum(F.when(F.col(pnl) <= 0, F.col(pnl)).otherwise(0.0)))
    return F.least(F.lit(99.0), F.when(lost > 0, won / lost).when(won > 0, 99.0).otherwise(0.0))


def sharpe_ratio(pnl: str = "pnl") -> Column:
    sd = F.stddev_pop(pnl)
    return F.when((F.count(pnl) > 1) & (sd > 1e-12), F.avg(pnl) / sd * math.sqrt(252)).otherwise(0.0)


def summarise(trades: DataFrame, key: list[str], pnl: str = "pnl") -> DataFrame:
    """Counts, profit, win rate, averages, extremes, profit factor and Sharpe ratio per key."""
    win, loss = F.when(F.col(pnl) > 0, F.col(pnl)), F.when(F.col(pnl) <= 0, F.col(pnl))
    return trades.groupBy(*key).agg(
        F.count(F.lit(1)).alias("trades"), F.count(win).alias("wins"), F.count(loss).alias("losses"), F.sum(pnl).alias("profit"),
        (F.count(win) / F.count(F.lit(1))).alias("winrate"), F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"), F.max(pnl).alias("best_trade"), F.min(pnl).alias("worst_trade"),
        profit_factor(pnl).alias("profit_factor"), sharpe_ratio(pnl).alias("sharpe"))


def max_drawdown(trades: DataFrame, key: list[str], block: Column, order: list[str], pnl: str = "pnl", start: float = 0.0) -> DataFrame:
    """Largest fall of the running P&L from its peak (the peak starts at ``start``), and the final equity.

    ``block`` must be monotone in ``order``. A block is reduced to its total, extremes and inner drawdown; blocks
    are then chained on one row each, so neither a hot key nor a long history meets a single task.
    """
    local = Window.partitionBy(*key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = trades.select(*key, block.alias("_b"), *[c for c in order if c not in key], F.col(pnl).alias("_p"))
    df = df.withColumn("_eq", F.sum("_p").over(local)).withColumn("_pk", F.max("_eq").over(local))
    per_block = df.groupBy(*key, "_b").agg(F.sum("_p").alias("_sum"), F.max("_eq").alias("_max"), F.min("_eq").alias("_min"), F.max(F.col("_pk") - F.col("_eq")).alias("_dd"))
    return chain_blocks(per_block, key, "_b", "_sum", "_max", "_min", "_dd", start)


def chain_blocks(per_block: DataFrame, key: list[str], block: str, total: str, high: str, low: str, fall: str, start: float = 0.0) -> DataFrame:
    """Largest fall and final value of equity curves of which each block is known by its sum, extremes and inner fall."""
    before = Window.partitionBy(*key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    chained = per_block.withColumn("_carry", start + F.coalesce(F.sum(total).over(before), F.lit(0.0)))
    chained = chained.withColumn("_top", F.greatest(F.lit(start), F.coalesce(F.max(F.col("_carry") + F.col(high)).over(before), F.lit(start))))
    deepest = F.greatest(F.col(fall), F.col("_top") - (F.col("_carry") + F.col(low)), F.lit(0.0))
    return chained.groupBy(*key).agg(F.max(deepest).alias("max_drawdown"), (start + F.sum(total)).alias("final_equity"))
