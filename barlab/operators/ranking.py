"""Ordering helpers: evenly spaced history points, compaction, chronological order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history_points(history: DataFrame, points: int = 6, pos: str = "pos", total: str = "n") -> DataFrame:
    """At most ``points`` evenly spaced rows including both ends, from row positions 0..n-1."""
    step = (F.col(total) - 1) / (points - 1)
    inner = [F.floor(F.lit(k) * step) for k in range(points - 1)]
    wanted = F.array(*inner, F.col(total) - 1)
    return history.filter((F.col(total) <= points) | F.array_contains(wanted, F.col(pos)))


def newest(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def compact(df: DataFrame, slot: Column, order: Sequence, trigger: int = 5000, target: int = 3000) -> DataFrame:
    """When there are more than ``trigger`` rows keep the newest ``target``. ``slot`` bounds the rows ranked together."""
    from barlab.core.blocks import index_rows

    ranked = index_rows(df, [], slot, order, "_pos", "_n")
    return ranked.filter((F.col("_n") <= trigger) | (F.col("_pos") >= F.col("_n") - target)).drop("_pos", "_n")


def best_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
