"""Splits, folds and walk-forward windows as short period lists, and rows tagged with the periods they fall in.

A period list is fixed by the date range, not by the data, so it travels inside the plan as a literal array; rows
are tagged by filtering that array instead of joining.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_TOTAL_DAYS = 60
MIN_USABLE_DAYS = 45
MIN_FOLD_DAYS = 30


@dataclass(frozen=True)
class Period:
    name: str
    kind: str  # train, test, oos or gap
    start: date
    end: date


def split(start: date, end: date, oos_share: float = 0.2, train_share: float = 0.75, gap_days: int = 5) -> list[Period]:
    """Train, test, gap and out-of-sample periods in time order."""
    total = (end - start).days
    usable = total - gap_days
    if total < MIN_TOTAL_DAYS or usable < MIN_USABLE_DAYS:
        raise ValueError(f"{total} days are too few to split")
    oos = int(usable * oos_share)
    train = int((usable - oos) * train_share)
    test = usable - oos - train
    edges, out = start, []
    for kind, days in (("train", train), ("test", test), ("gap", gap_days), ("oos", oos)):
        out.append(Period(kind, kind, edges, edges + timedelta(days=days)))
        edges += timedelta(days=days)
    return out


def expanding_folds(start: date, end: date, k: int = 5) -> list[Period]:
    """k folds with a growing train period and a test period of constant size."""
    total = (end - start).days
    if total < MIN_FOLD_DAYS * k:
        raise ValueError(f"{total} days are too few for {k} folds")
    size = total // (k + 1)
    out = []
    for n in range(1, k + 1):
        cut = start + timedelta(days=size * n)
        out += [Period(f"fold{n}", "train", start, cut), Period(f"fold{n}", "test", cut, cut + timedelta(days=size))]
    return out


def walk_forward(start: date, end: date, train: int = 120, trade: int = 30, step: int = 30) -> list[Period]:
    """Rolling train/trade windows whose trade period ends no later than ``end``."""
    out, at, n = [], start, 0
    while at + timedelta(days=train + trade) <= end:
        cut = at + timedelta(days=train)
        out += [Period(f"window{n}", "train", at, cut), Period(f"window{n}", "test", cut, cut + timedelta(days=trade))]
        at, n = at + timedelta(days=step), n + 1
    return out


def _literal(periods: list[Period]) -> Column:
    return F.array(*[F.struct(F.lit(p.name).alias("period"), F.lit(p.kind).alias("kind"), F.lit(p.start).alias("start"),
                              F.lit(p.end).alias("end"), F.lit((p.end - p.start).days).alias("days")) for p in periods])


def tag_periods(rows: DataFrame, periods: list[Period], day: str = "day") -> DataFrame:
    """One row per (row, period that contains it); bounds are half-open. Overlapping periods repeat a row."""
    inside = F.filter(_literal(periods), lambda p: (F.col(day) >= p["start"]) & (F.col(day) < p["end"]))
    return rows.withColumn("_p", F.explode(inside)).select(*rows.columns, "_p.period", "_p.kind", "_p.days")


def period_table(spark, periods: list[Period]) -> DataFrame:
    return spark.createDataFrame([(p.name, p.kind, p.start, p.end, (p.end - p.start).days) for p in periods],
                                 "period string, kind string, start date, end date, days int")
