"""Price structure: swings, trend breaks, order blocks, gaps, liquidity levels, volume profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.core.blocks import DEFAULT_BLOCK, IDX, KEY, lag, ordered, rows, running
from barlab.core.steps import Step, decaying, warm, wilder_reach, wilder_span, with_indicators


def swings(lookback: int = 5) -> Step:
    """Bars whose high (low) is the extreme of the ``lookback`` bars on both sides; known ``lookback`` bars later."""

    def apply(df: DataFrame) -> DataFrame:
        frame = rows(-lookback, lookback)
        inside = (F.col(IDX) >= lookback) & (F.col(IDX) < F.col("n_bars") - lookback)
        return df.withColumns({
            "swing_high": F.when(inside & (F.col("high") == F.max("high").over(frame)), F.col("high")),
            "swing_low": F.when(inside & (F.col("low") == F.min("low").over(frame)), F.col("low"))})

    return Step("swings", ("swing_high", "swing_low"), apply, back=lookback, ahead=lookback)


def market_structure(bars: DataFrame, lookback: int = 5, confirm_lag: int = 0) -> DataFrame:
    """Trend (+1/-1/0), breaks of structure and changes of character from the last two swing highs and lows.

    ``confirm_lag=lookback`` moves the outputs to the bar at which the swing is known.
    """
    key, blk = [*KEY], "_rb"
    df = with_indicators(bars, swings(lookback)).withColumn(blk, F.floor(F.col(IDX) / DEFAULT_BLOCK))
    df = running(df, key, blk, [IDX], {"_xh": ("last", F.col("swing_high")), "_xl": ("last", F.col("swing_low"))}, inclusive=False)
    df = df.withColumns({"_lh": F.coalesce("swing_high", "_xh"), "_ll": F.coalesce("swing_low", "_xl")})
    df = running(df, key, blk, [IDX], {"_ph": ("last", F.when(F.col("swing_high").isNotNull(), F.col("_xh"))),
                                       "_pl": ("last", F.when(F.col("swing_low").isNotNull(), F.col("_xl")))})
    sign = (F.when((F.col("_lh") > F.col("_ph")) & (F.col("_ll") > F.col("_pl")), 1)
            .when((F.col("_lh") < F.col("_ph")) & (F.col("_ll") < F.col("_pl")), -1))
    df = df.withColumn("_sign", sign)
    df = running(df, key, blk, [IDX], {"_before": ("last", F.col("_sign"))}, inclusive=False)
    known = F.col("_lh").isNotNull() & F.col("_ph").isNotNull() & F.col("_ll").isNotNull() & F.col("_pl").isNotNull()
    before = F.coalesce("_before", F.lit(0))
    df = df.withColumn("trend", F.coalesce("_sign", before)).withColumn("_b", before)
    df = df.withColumns({
        "bos": F.when(known & (F.col("trend") == F.col("_b")), F.col("trend")).otherwise(0),
        "choch": F.when(known & (F.col("trend") != F.col("_b")) & (F.col("_b") != 0), F.col("trend")).otherwise(0)})
    df = df.drop(blk, "_xh", "_xl", "_lh", "_ll", "_ph", "_pl", "_sign", "_before", "_b")
    if confirm_lag:
        cols = ("trend", "bos", "choch")
        late = Step("confirm", cols, lambda d: d.withColumns({c: F.coalesce(lag(c, confirm_lag), F.lit(0)) for c in cols}), back=confirm_lag)
        df = with_indicators(df, late)
    return df


def _range_mean(df: DataFrame, close: Column, period: int, out: str) -> DataFrame:
    df = df.withColumn("_c", close)
    prev = lag("_c")
    df = df.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))
    return decaying(df, "_tr", out, period, 1 / period).drop("_tr", "_c")


def order_blocks(lookback: int = 10, strength: float = 1.5, move: int = 3) -> Step:
    """Last opposite candle before a move of more than ``strength`` ATR over ``move`` bars.

    A bearish candle is the block of a later trigger when no other bearish candle lies between them, so each
    candle only needs its next trigger and its next candle of the same colour.
    """
    outs = ("ob_bullish", "ob_bearish", "ob_bull_high", "ob_bull_low", "ob_bear_high", "ob_bear_low")

    def apply(df: DataFrame) -> DataFrame:
        df = _range_mean(df, F.col("close"), 14, "_a")
        change = F.col("close") - lag("close", move)
        usable = (F.col(IDX) >= lookback + 2) & F.col("_a").isNotNull()
        df = df.withColumns({"_up": F.when(usable & (change > strength * F.col("_a")), F.col(IDX)),
                             "_dn": F.when(usable & (-change > strength * F.col("_a")), F.col(IDX)),
                             "_red": F.when(F.col("close") < F.col("open"), F.col(IDX)),
                             "_green": F.when(F.col("close") > F.col("open"), F.col(IDX))})
        after = rows(1, lookback - 1)

        def marks(colour: str, trigger: str) -> Column:
            hit, same = F.min(trigger).over(after), F.min(colour).over(after)
            return (F.col(colour).isNotNull() & (F.col(IDX) > 0) & hit.isNotNull() & (same.isNull() | (hit <= same))).cast("int")

        df = df.withColumns({"ob_bullish": marks("_red", "_up"), "ob_bearish": marks("_green", "_dn")})
        bull, bear = F.col("ob_bullish") == 1, F.col("ob_bearish") == 1
        return df.withColumns({"ob_bull_high": F.when(bull, F.col("high")), "ob_bull_low": F.when(bull, F.col("low")),
                               "ob_bear_high": F.when(bear, F.col("high")), "ob_bear_low": F.when(bear, F.col("low"))}).drop(
            "_a", "_up", "_dn", "_red", "_green")

    return Step("order_blocks", outs, apply, back=wilder_reach(14) + move + 2, ahead=lookback, span=wilder_span(14))


def fair_value_gaps() -> Step:
    """Three-bar gaps, marked on the middle bar; known one bar later."""

    def apply(df: DataFrame) -> DataFrame:
        w = ordered()
        df = df.withColumns({"_h": lag("high"), "_l": lag("low"), "_nh": F.lead("high").over(w), "_nl": F.lead("low").over(w)})
        bull, bear = F.col("_nl") > F.col("_h"), F.col("_nh") < F.col("_l")
        return df.withColumns({
            "fvg_bull": F.when(bull, 1).otherwise(0), "fvg_bear": F.when(bear, 1).otherwise(0),
            "fvg_bull_top": F.when(bull, F.col("_nl")), "fvg_bull_bottom": F.when(bull, F.col("_h")),
            "fvg_bear_top": F.when(bear, F.col("_l")), "fvg_bear_bottom": F.when(bear, F.col("_nh"))}).drop("_h", "_l", "_nh", "_nl")

    return Step("fair_value_gaps", ("fvg_bull", "fvg_bear", "fvg_bull_top", "fvg_bull_bottom", "fvg_bear_top", "fvg_bear_bottom"),
                apply, back=1, ahead=1)


def liquidity_levels(lookback: int = 20, touches: int = 2, tolerance: float = 0.3) -> Step:
    """First earlier high (low) of the frame that at least ``touches`` bars came within the tolerance of."""

    def apply(df: DataFrame) -> DataFrame:
        df = _range_mean(df, (F.col("high") + F.col("low")) / 2, 14, "_a")
        frame = rows(-lookback, -1)
        df = df.withColumns({"_hs": F.collect_list("high").over(frame), "_ls": F.collect_list("low").over(frame), "_tol": F.col("_a") * tolerance})

        def level(values: str) -> Column:
            near = lambda lv: F.size(F.filter(values, lambda x: F.abs(x - lv) < F.col("_tol"))) >= touches
            return F.when((F.col(IDX) >= 2 * lookback) & F.col("_a").isNotNull(), F.get(F.filter(values, near), F.lit(0)))

        df = df.withColumns({"resistance": level("_hs"), "support": level("_ls")})
        return df.withColumns({"liquidity_above": F.when(F.col("resistance") > F.col("high"), 1).otherwise(0),
                               "liquidity_below": F.when(F.col("support") < F.col("low"), 1).otherwise(0)}).drop("_a", "_hs", "_ls", "_tol")

    return Step("liquidity_levels", ("resistance", "support", "liquidity_above", "liquidity_below"), apply,
                back=wilder_reach(14) + lookback, span=wilder_span(14))


def _bin_volume(bins: np.ndarray, volume: np.ndarray, n: int) -> np.ndarray:
    """Volume per bin of each row; ``bins`` and ``volume`` have one frame per row."""
    rows_, width = bins.shape
    flat = bins + np.arange(rows_)[:, None] * n
    return np.bincount(flat.ravel(), weights=volume.ravel(), minlength=rows_ * n).reshape(rows_, n)


def _frames(lists: pd.Series, dtype=float) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=dtype) for x in lists])


def _profile_udf(levels: int, share: float):
    @F.pandas_udf("struct<p int, lo int, hi int>")
    def profile(closes: pd.Series, volumes: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"p": pd.array([pd.NA] * len(closes), dtype="Int32")}).assign(lo=lambda d: d["p"], hi=lambda d: d["p"])
        full = closes.notna().to_numpy()
        if not full.any():
            return out
        c, v = _frames(closes[full]), _frames(volumes[full])
        low, high = c.min(axis=1, keepdims=True), c.max(axis=1, keepdims=True)
        vol = _bin_volume(((c - low) / (high - low) * (levels - 1)).astype(int), v, levels)
        at = np.arange(len(vol))
        p = vol.argmax(axis=1)
        lo, hi, cum, target = p.copy(), p.copy(), vol[at, p], vol.sum(axis=1) * share
        padded = np.pad(vol, ((0, 0), (1, 1)))
        for _ in range(levels):  # widen the area towards the larger neighbour until it holds the share
            up, down = padded[at, hi + 2], padded[at, lo]
            open_ = cum < target
            go_up = open_ & (up >= down) & (hi + 1 < levels)
            go_down = open_ & ~go_up & (lo > 0)
            if not (go_up | go_down).any():
                break
            cum = cum + np.where(go_up, up, 0) + np.where(go_down, down, 0)
            hi, lo = hi + go_up, lo - go_down
        for name, values in (("p", p), ("lo", lo), ("hi", hi)):
            out.loc[full, name] = values.astype("int32")
        return out

    return profile


def volume_profile(lookback: int = 100, levels: int = 50, share: float = 0.7) -> Step:
    """Point of control and value area of the previous ``lookback`` closes, weighted by tick volume.

    A histogram per row is the one thing window functions do poorly: the frames go to an Arrow UDF as arrays.
    """
    outs = ("poc", "vah", "val", "above_poc", "below_poc")
    profile = _profile_udf(levels, share)

    def apply(df: DataFrame) -> DataFrame:
        frame = rows(-lookback, -1)
        df = df.withColumns({"_c": F.collect_list("close").over(frame), "_v": F.collect_list(F.col("tick_volume").cast("double")).over(frame),
                             "_min": F.min("close").over(frame), "_max": F.max("close").over(frame)})
        usable = (F.col(IDX) >= lookback) & (F.col("_max") > F.col("_min"))
        df = df.withColumn("_p", profile(F.when(usable, F.col("_c")), F.when(usable, F.col("_v"))))
        price = lambda i: F.col("_min") + F.col(i) * (F.col("_max") - F.col("_min")) / (levels - 1)
        df = df.withColumns({"poc": price("_p.p"), "vah": price("_p.hi"), "val": price("_p.lo")})
        return df.withColumns({"above_poc": F.when(F.col("close") > F.col("poc"), 1).otherwise(0),
                               "below_poc": F.when(F.col("close") < F.col("poc"), 1).otherwise(0)}).drop("_c", "_v", "_min", "_max", "_p")

    return Step("volume_profile", outs, apply, back=lookback)


def _bins_udf(bins: int):
    @F.pandas_udf("double")
    def best(closes: pd.Series, volumes: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=closes.index)
        full = closes.notna().to_numpy()
        if full.any():
            c, v = _frames(closes[full]), _frames(volumes[full])
            low, high = c.min(axis=1, keepdims=True), c.max(axis=1, keepdims=True)
            width = (high - low) / bins
            k = np.clip(np.ceil((c - low) / width).astype(int), 1, bins) - 1
            out[full] = low[:, 0] + (_bin_volume(k, v, bins).argmax(axis=1) + 0.5) * width[:, 0]
        return out

    return best


def binned_poc(lookback: int = 240, bins: int = 20) -> Step:
    """Middle of the fullest of ``bins`` equal, right-closed bins of the closes including the current one, and
    the frame's high and low, as plain prices (``poc_mid``, ``frame_high``, ``frame_low``)."""
    best = _bins_udf(bins)

    def apply(df: DataFrame) -> DataFrame:
        frame = rows(1 - lookback, 0)
        spread = F.max("close").over(frame) - F.min("close").over(frame)
        usable = (F.col(IDX) >= lookback - 1) & (spread > 0)
        df = df.withColumns({"_c": F.when(usable, F.collect_list("close").over(frame)),
                             "_v": F.when(usable, F.collect_list(F.col("tick_volume").cast("double")).over(frame))})
        mid = F.coalesce(F.nanvl(best("_c", "_v"), F.lit(None)), F.col("close"))
        return df.withColumns({"poc_mid": warm(mid, lookback - 1), "frame_high": warm(F.max("high").over(frame), lookback - 1),
                               "frame_low": warm(F.min("low").over(frame), lookback - 1)}).drop("_c", "_v")

    return Step("binned_poc", ("poc_mid", "frame_high", "frame_low"), apply, back=lookback)
