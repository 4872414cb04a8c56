"""Recurrences that are not linear: SuperTrend, parabolic SAR, signal spacing, and running volume."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.core.blocks import DEFAULT_BLOCK, IDX, KEY, lag, running
from barlab.core.carry import carry_scan
from barlab.core.steps import Step, with_indicators
from barlab.operators.indicators import atr

NAN = math.nan


def _blocked(df: DataFrame, block_rows: int) -> DataFrame:
    return df.withColumn("_cb", F.floor(F.col(IDX) / block_rows))


def on_balance_volume(bars: DataFrame) -> DataFrame:
    """Volume summed with the sign of the close change, from the first bar on."""
    signed = Step("signed", ("_v",), lambda d: d.withColumn("_v", F.coalesce(F.signum(F.col("close") - lag("close")) * F.col("tick_volume"), F.lit(0.0))), back=1)
    df = _blocked(with_indicators(bars, signed), DEFAULT_BLOCK)
    return running(df, KEY, "_cb", [IDX], {"obv": ("sum", F.col("_v"))}).drop("_v", "_cb")


def supertrend(bars: DataFrame, period: int = 10, multiplier: float = 3.0, block_rows: int = DEFAULT_BLOCK) -> DataFrame:
    """Ratcheting ATR bands with a direction that flips when the close leaves the active band."""
    df = with_indicators(bars, atr(period, out="_atr")).select(*KEY, IDX, "high", "low", "close", "_atr")

    def step(pdf: pd.DataFrame, state: list[float]):
        upper, lower, trend, prev = state
        lines, dirs, ups, lows = [], [], [], []
        for i, h, l, c, a in zip(pdf[IDX], pdf["high"], pdf["low"], pdf["close"], pdf["_atr"]):
            if i < period or a != a:
                lines.append(NAN), dirs.append(0), ups.append(NAN), lows.append(NAN)
            else:
                mid, width = (h + l) / 2, multiplier * a
                if upper != upper:
                    upper, lower = mid + width, mid - width
                    trend = 1.0 if c > upper else -1.0
                else:
                    upper = min(mid + width, upper) if prev <= upper else mid + width
                    lower = max(mid - width, lower) if prev >= lower else mid - width
                    trend = (1.0 if c >= lower else -1.0) if trend == 1.0 else (-1.0 if c <= upper else 1.0)
                lines.append(lower if trend == 1.0 else upper), dirs.append(int(trend)), ups.append(upper), lows.append(lower)
            prev = c
        out = pdf[[*KEY, IDX]].assign(supertrend=lines, supertrend_dir=dirs, supertrend_upper=ups, supertrend_lower=lows)
        return out, [upper, lower, trend, prev]

    schema = "symbol string, timeframe string, bar_idx bigint, supertrend double, supertrend_dir int, supertrend_upper double, supertrend_lower double"
    return carry_scan(_blocked(df, block_rows), KEY, "_cb", [IDX], step, [NAN, NAN, 0.0, NAN], schema)


def parabolic_sar(bars: DataFrame, start: float = 0.02, increment: float = 0.02, top: float = 0.2, block_rows: int = DEFAULT_BLOCK) -> DataFrame:
    """Stop-and-reverse line with an acceleration factor, kept outside the last two bars' range."""
    df = bars.select(*KEY, IDX, "high", "low")

    def step(pdf: pd.DataFrame, state: list[float]):
        sar, af, ep, side, h1, h2, l1, l2 = state
        sars, dirs = [], []
        for i, h, l in zip(pdf[IDX], pdf["high"], pdf["low"]):
            if sar != sar:  # first bar of the series (or of a block that starts blind)
                sar, af, ep, side = l, start, h, 1.0
            else:
                sar += af * (ep - sar)
                if side > 0:
                    sar = min(sar, l1) if l2 != l2 else min(sar, l1, l2)
                    if h > ep:
                        ep, af = h, min(af + increment, top)
                    if l < sar:
                        side, sar, ep, af = -1.0, ep, l, start
                else:
                    sar = max(sar, h1) if h2 != h2 else max(sar, h1, h2)
                    if l < ep:
                        ep, af = l, min(af + increment, top)
                    if h > sar:
                        side, sar, ep, af = 1.0, ep, h, start
            h1, h2, l1, l2 = h, h1, l, l1
            sars.append(sar), dirs.append(int(side))
        return pdf[[*KEY, IDX]].assign(sar=sars, sar_dir=dirs), [sar, af, ep, side, h1, h2, l1, l2]

    schema = "symbol string, timeframe string, bar_idx bigint, sar double, sar_dir int"
    return carry_scan(_blocked(df, block_rows), KEY, "_cb", [IDX], step, [NAN, start, NAN, 1.0, NAN, NAN, NAN, NAN], schema)


#: Bars to wait between two signals (fixed values); other timeframes 1.
MIN_SPACING = {"M1": 5, "M5": 3, "M15": 2, "M30": 2}


def space_signals(signals: DataFrame, key: list[str], spacing: int, column: str = "signal", block_rows: int = DEFAULT_BLOCK) -> DataFrame:
    """Drop signals closer than ``spacing`` bars to the last kept one. Only signal rows enter the scan."""
    if spacing <= 1:
        return signals
    hits = signals.filter(F.col(column) != 0)

    def step(pdf: pd.DataFrame, state: list[float]):
        last, keep = state[0], []
        for i in pdf[IDX]:
            ok = i - last >= spacing
            keep.append(ok)
            last = float(i) if ok else last
        return pdf[keep][[c for c in pdf.columns if c not in ("_start", "_cb")]], [last]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hits.schema)
    return carry_scan(_blocked(hits, block_rows), key, "_cb", [IDX], step, [-1e18], schema)
