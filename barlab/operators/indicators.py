"""Technical indicators with finite frames and linear recurrences, one ``Step`` constructor each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.core.blocks import IDX, lag, ordered, rows
from barlab.core.steps import (Step, decaying, ema_gain, ema_reach, ema_span, warm, wilder_reach, wilder_span)
from pyspark.sql import Window

# ---------------------------------------------------------------- column helpers


def _mean(col: Column | str, p: int) -> Column:
    return F.avg(col).over(rows(-(p - 1), 0))


def _high(p: int, col: str = "high") -> Column:
    return F.max(col).over(rows(-(p - 1), 0))


def _low(p: int, col: str = "low") -> Column:
    return F.min(col).over(rows(-(p - 1), 0))


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def true_range_col() -> Column:
    prev = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def _cols(df: DataFrame, **named: Column) -> DataFrame:
    return df.withColumns(named)


# ---------------------------------------------------------------- moving averages


def sma(period: int, src: str = "close", out: str | None = None) -> Step:
    out = out or f"sma_{period}"
    return Step("sma", (out,), lambda df: df.withColumn(out, warm(_mean(src, period), period - 1)), back=period)


def _weighted(col: str, p: int) -> Column:
    """Linearly weighted mean, weights 1..p. Offsets are taken from the current row, which keeps the
    weighted sum small and the frame a plain window sum."""
    frame = rows(-(p - 1), 0)
    x = F.col(col)
    return (F.sum(F.col(IDX) * x).over(frame) - (F.col(IDX) - p) * F.sum(x).over(frame)) / (p * (p + 1) / 2)


def wma(period: int, src: str = "close", out: str | None = None) -> Step:
    out = out or f"wma_{period}"
    return Step("wma", (out,), lambda df: df.withColumn(out, warm(_weighted(src, period), period - 1)), back=period)


def hma(period: int, src: str = "close", out: str | None = None) -> Step:
    """Hull average: weighted mean over sqrt(p) of 2*WMA(p/2) - WMA(p)."""
    out = out or f"hma_{period}"
    half, root = max(1, period // 2), max(1, math.isqrt(period))

    def apply(df: DataFrame) -> DataFrame:
        diff = 2 * _weighted(src, half) - _weighted(src, period)
        df = df.withColumn("_d", F.coalesce(warm(diff, period - 1), F.lit(0.0)))
        return df.withColumn(out, warm(_weighted("_d", root), period + root - 2)).drop("_d")

    return Step("hma", (out,), apply, back=period + root)


def ema(period: int, src: str = "close", out: str | None = None) -> Step:
    out = out or f"ema_{period}"
    return Step("ema", (out,), lambda df: decaying(df, src, out, period, ema_gain(period)),
                back=ema_reach(period), span=ema_span(period))


def _chain(df: DataFrame, src: str, period: int, depth: int) -> DataFrame:
    """EMA of EMA ...; warm-up NULLs enter the next level as 0. Adds _e1.._e<depth>."""
    for level in range(1, depth + 1):
        df = decaying(df, src, f"_e{level}", period, ema_gain(period))
        df = df.withColumn("_in", F.coalesce(F.col(f"_e{level}"), F.lit(0.0)))
        src = "_in"
    return df.drop("_in")


def dema(period: int, src: str = "close", out: str | None = None) -> Step:
    out = out or f"dema_{period}"

    def apply(df: DataFrame) -> DataFrame:
        df = _chain(df, src, period, 2)
        enough = F.col("n_bars") - period + 1 >= period
        return df.withColumn(out, F.when(enough, 2 * F.col("_e1") - F.col("_e2")).otherwise(F.col("_e1"))).drop("_e1", "_e2")

    return Step("dema", (out,), apply, back=2 * ema_reach(period), span=ema_span(period))


def tema(period: int, src: str = "close", out: str | None = None) -> Step:
    out = out or f"tema_{period}"

    def apply(df: DataFrame) -> DataFrame:
        df = _chain(df, src, period, 3)
        return df.withColumn(out, 3 * F.col("_e1") - 3 * F.col("_e2") + F.col("_e3")).drop("_e1", "_e2", "_e3")

    return Step("tema", (out,), apply, back=3 * ema_reach(period), span=ema_span(period))


# ---------------------------------------------------------------- oscillators


def _rsi(df: DataFrame, src: str, period: int, out: str) -> DataFrame:
    df = df.withColumn("_d", F.coalesce(F.col(src) - lag(src), F.lit(0.0)))
    df = _cols(df, _gain=F.greatest("_d", F.lit(0.0)), _loss=F.greatest(-F.col("_d"), F.lit(0.0)))
    df = decaying(df, "_gain", "_up", period, 1 / period, start=1)
    df = decaying(df, "_loss", "_down", period, 1 / period, start=1)
    value = (F.when(F.col("_down") != 0, 100 - 100 / (1 + F.col("_up") / F.col("_down")))
             .when(F.col("_up") > 0, 100.0).otherwise(50.0))
    return df.withColumn(out, warm(value, period)).drop("_d", "_gain", "_loss", "_up", "_down")


def rsi(period: int = 14, src: str = "close", out: str | None = None) -> Step:
    out = out or f"rsi_{period}"
    return Step("rsi", (out,), lambda df: _rsi(df, src, period, out), back=wilder_reach(period) + 2, span=wilder_span(period))


def stoch_rsi(rsi_period: int = 14, stoch_period: int = 14, smooth: int = 3) -> Step:
    def apply(df: DataFrame) -> DataFrame:
        df = _rsi(df, "close", rsi_period, "_r")
        frame = rows(-(stoch_period - 1), 0)
        hi, lo, n = F.max("_r").over(frame), F.min("_r").over(frame), F.count("_r").over(frame)
        raw = F.when(n >= 2, F.when(hi != lo, (F.col("_r") - lo) / (hi - lo) * 100).otherwise(50.0))
        df = df.withColumn("_s", F.coalesce(warm(raw, rsi_period + stoch_period - 1), F.lit(50.0)))
        df = df.withColumn("stoch_rsi_k", warm(_mean("_s", smooth), smooth - 1))
        df = df.withColumn("_k", F.coalesce(F.col("stoch_rsi_k"), F.lit(50.0)))
        return df.withColumn("stoch_rsi_d", warm(_mean("_k", smooth), smooth - 1)).drop("_r", "_s", "_k")

    return Step("stoch_rsi", ("stoch_rsi_k", "stoch_rsi_d"), apply,
                back=wilder_reach(rsi_period) + stoch_period + 2 * smooth + 2, span=wilder_span(rsi_period))


def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> Step:
    def apply(df: DataFrame) -> DataFrame:
        df = decaying(df, "close", "_f", fast, ema_gain(fast))
        df = decaying(df, "close", "_s", slow, ema_gain(slow))
        df = df.withColumn("macd", F.col("_f") - F.col("_s")).drop("_f", "_s")
        df = decaying(df, "macd", "macd_signal", signal, ema_gain(signal), start=slow - 1)
        df = df.withColumn("macd_signal", F.when(F.col("n_bars") - slow + 1 > signal, F.col("macd_signal")))
        return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))

    return Step("macd", ("macd", "macd_signal", "macd_hist"), apply,
                back=ema_reach(slow) + ema_reach(signal), span=ema_span(fast, slow, signal))


def stochastic(k: int = 14, d: int = 3, slowing: int = 3) -> Step:
    def apply(df: DataFrame) -> DataFrame:
        hi, lo = _high(k), _low(k)
        raw = F.when(hi != lo, (F.col("close") - lo) / (hi - lo) * 100).otherwise(50.0)
        df = df.withColumn("_raw", F.coalesce(warm(raw, k - 1), F.lit(50.0)))
        df = df.withColumn("stoch_k", warm(_mean("_raw", max(1, slowing)), max(k - 1, slowing - 1)))
        df = df.withColumn("_k", F.coalesce(F.col("stoch_k"), F.lit(50.0)))
        return df.withColumn("stoch_d", warm(_mean("_k", d), max(k + slowing - 2, d - 1))).drop("_raw", "_k")

    return Step("stochastic", ("stoch_k", "stoch_d"), apply, back=k + slowing + d)


def williams_r(period: int = 14) -> Step:
    def apply(df: DataFrame) -> DataFrame:
        hi, lo = _high(period), _low(period)
        value = F.when(hi != lo, (hi - F.col("close")) / (hi - lo) * -100).otherwise(-50.0)
        return df.withColumn("williams_r", warm(value, period - 1))

    return Step("williams_r", ("williams_r",), apply, back=period)


def cci(period: int = 20) -> Step:
    def apply(df: DataFrame) -> DataFrame:
        df = df.withColumn("_tp", typical())
        frame = rows(-(period - 1), 0)
        df = _cols(df, _m=F.avg("_tp").over(frame), _w=F.collect_list("_tp").over(frame))
        dev = F.aggregate("_w", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_m"))) / period
        value = F.when(dev > 0, (F.col("_tp") - F.col("_m")) / (0.015 * dev)).otherwise(0.0)
        return df.withColumn("cci", warm(value, period - 1)).drop("_tp", "_m", "_w")

    return Step("cci", ("cci",), apply, back=period)


def mfi(period: int = 14) -> Step:
    def apply(df: DataFrame) -> DataFrame:
        df = df.withColumn("_tp", typical())
        df = df.withColumn("_dt", F.col("_tp") - lag("_tp"))
        flow = F.col("_tp") * F.col("tick_volume")
        frame = rows(-(period - 1), 0)
        up = F.sum(F.when(F.col("_dt") > 0, flow).otherwise(0.0)).over(frame)
        down = F.sum(F.when(F.col("_dt") < 0, flow).otherwise(0.0)).over(frame)
        value = F.when(down > 0, 100 - 100 / (1 + up / down)).when(up > 0, 100.0).otherwise(50.0)
        return df.withColumn("mfi", warm(value, period)).drop("_tp", "_dt")

    return Step("mfi", ("mfi",), apply, back=period + 1)


def momentum(period: int = 10) -> Step:
    return Step("momentum", ("momentum",), lambda df: df.withColumn("momentum", F.col("close") - lag("close", period)), back=period)


def roc(period: int = 10) -> Step:
    def apply(df: DataFrame) -> DataFrame:
        base = lag("close", period)
        return df.withColumn("roc", F.when(base != 0, (F.col("close") - base) / base * 100))

    return Step("roc", ("roc",), apply, back=period)


# ---------------------------------------------------------------- volatility, bands, channels


def true_range() -> Step:
    return Step("true_range", ("tr",), lambda df: df.withColumn("tr", true_range_col()), back=1)


def _atr(df: DataFrame, period: int, out: str) -> DataFrame:
    return decaying(df.withColumn("_tr", true_range_col()), "_tr", out, period, 1 / period).drop("_tr")


def atr(period: int = 14, out: str | None = None) -> Step:
    out = out or f"atr_{period}"
    return Step("atr", (out,), lambda df: _atr(df, period, out), back=wilder_reach(period) + 1, span=wilder_span(period))


def bollinger(period: int = 20, deviation: float = 2.0) -> Step:
    """Bands, width in percent of the middle, and %B."""

    def apply(df: DataFrame) -> DataFrame:
        std = F.stddev_pop("close").over(rows(-(period - 1), 0))
        df = _cols(df, bb_mid=warm(_mean("close", period), period - 1), _sd=warm(std, period - 1))
        df = _cols(df, bb_upper=F.col("bb_mid") + deviation * F.col("_sd"), bb_lower=F.col("bb_mid") - deviation * F.col("_sd"))
        band = F.col("bb_upper") - F.col("bb_lower")
        return _cols(df, bb_width=F.when(F.col("bb_mid") > 0, band / F.col("bb_mid") * 100).otherwise(0.0),
                     bb_pct=F.when(band > 0, (F.col("close") - F.col("bb_lower")) / band).otherwise(0.5)).drop("_sd")

    return Step("bollinger", ("bb_upper", "bb_mid", "bb_lower", "bb_width", "bb_pct"), apply, back=period)


def donchian(period: int = 20) -> Step:
    def apply(df: DataFrame) -> DataFrame:
        df = _cols(df, donchian_upper=warm(_high(period), period - 1), donchian_lower=warm(_low(period), period - 1))
        return df.withColumn("donchian_mid", (F.col("donchian_upper") + F.col("donchian_lower")) / 2)

    return Step("donchian", ("donchian_upper", "donchian_mid", "donchian_lower"), apply, back=period)


def keltner(ema_period: int = 20, atr_period: int = 10, multiplier: float = 2.0) -> Step:
    def apply(df: DataFrame) -> DataFrame:
        df = decaying(df, "close", "keltner_mid", ema_period, ema_gain(ema_period))
        df = _atr(df, atr_period, "_a")
        return _cols(df, keltner_upper=F.col("keltner_mid") + multiplier * F.col("_a"),
                     keltner_lower=F.col("keltner_mid") - multiplier * F.col("_a")).drop("_a")

    return Step("keltner", ("keltner_upper", "keltner_mid", "keltner_lower"), apply,
                back=max(ema_reach(ema_period), wilder_reach(atr_period) + 1), span=min(ema_span(ema_period), wilder_span(atr_period)))


def adx(period: int = 14) -> Step:
    """Directional index; movements are smoothed by EMA, the range by the Wilder mean."""

    def apply(df: DataFrame) -> DataFrame:
        up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
        df = _cols(df, _up=F.coalesce(up, F.lit(0.0)), _dn=F.coalesce(down, F.lit(0.0)))
        df = _cols(df, _pdm=F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0),
                   _mdm=F.when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn")).otherwise(0.0))
        df = _atr(df, period, "_a")
        df = decaying(df, "_pdm", "_ps", period, ema_gain(period))
        df = decaying(df, "_mdm", "_ms", period, ema_gain(period))
        di = lambda c: F.when(F.col("_a") > 0, F.col(c) / F.col("_a") * 100).otherwise(0.0)
        df = _cols(df, plus_di=di("_ps"), minus_di=di("_ms"))
        total = F.col("plus_di") + F.col("minus_di")
        df = df.withColumn("_dx", F.when(total > 0, F.abs(F.col("plus_di") - F.col("minus_di")) / total * 100).otherwise(0.0))
        df = decaying(df, "_dx", "adx", period, ema_gain(period))
        enough = F.col("n_bars") >= 2 * period
        return df.withColumns({c: F.when(enough, F.col(c)) for c in ("adx", "plus_di", "minus_di")}).drop(
            "_up", "_dn", "_pdm", "_mdm", "_a", "_ps", "_ms", "_dx")

    return Step("adx", ("adx", "plus_di", "minus_di"), apply,
                back=wilder_reach(period) + ema_reach(period) + 2, span=min(ema_span(period), wilder_span(period)))


def ichimoku(tenkan: int = 9, kijun: int = 26, senkou_b: int = 52, displacement: int = 26) -> Step:
    def apply(df: DataFrame) -> DataFrame:
        middle = lambda p: warm((_high(p) + _low(p)) / 2, p - 1)
        df = _cols(df, tenkan=middle(tenkan), kijun=middle(kijun), _b=middle(senkou_b))
        df = _cols(df, span_a=lag((F.col("tenkan") + F.col("kijun")) / 2, displacement), span_b=lag("_b", displacement),
                   chikou=F.lead("close", displacement).over(ordered()))
        return _cols(df, cloud_top=F.greatest("span_a", "span_b"), cloud_bottom=F.least("span_a", "span_b")).drop("_b")

    return Step("ichimoku", ("tenkan", "kijun", "span_a", "span_b", "chikou", "cloud_top", "cloud_bottom"), apply,
                back=senkou_b + displacement, ahead=displacement)


# ---------------------------------------------------------------- volume and levels


def _signed_volume() -> Column:
    return F.coalesce(F.signum(F.col("close") - lag("close")) * F.col("tick_volume"), F.lit(0.0))


def vwap(period: int = 20) -> Step:
    """Rolling volume-weighted price; the frame holds period+1 rows."""

    def apply(df: DataFrame) -> DataFrame:
        frame = rows(-period, 0)
        vol = F.sum("tick_volume").over(frame)
        return df.withColumn("vwap", warm(F.when(vol > 0, F.sum(typical() * F.col("tick_volume")).over(frame) / vol), period))

    return Step("vwap", ("vwap",), apply, back=period)


def pivot_points(period: int = 20) -> Step:
    def apply(df: DataFrame) -> DataFrame:
        frame = rows(-period, -1)
        df = _cols(df, _h=F.max("high").over(frame), _l=F.min("low").over(frame), _c=lag("close"))
        df = df.withColumn("pp", warm((F.col("_h") + F.col("_l") + F.col("_c")) / 3, period))
        pp, h, l = F.col("pp"), F.col("_h"), F.col("_l")
        return _cols(df, r1=2 * pp - l, s1=2 * pp - h, r2=pp + (h - l), s2=pp - (h - l),
                     r3=h + 2 * (pp - l), s3=l - 2 * (h - pp)).drop("_h", "_l", "_c")

    return Step("pivot_points", ("pp", "r1", "r2", "r3", "s1", "s2", "s3"), apply, back=period)


#: Retracement levels (fixed values).
FIB_LEVELS = {"fib_0": 0.0, "fib_236": 0.236, "fib_382": 0.382, "fib_500": 0.5, "fib_618": 0.618, "fib_786": 0.786, "fib_100": 1.0}


def fibonacci(lookback: int = 50) -> Step:
    def apply(df: DataFrame) -> DataFrame:
        frame = rows(-lookback, -1)
        df = _cols(df, _h=F.max("high").over(frame), _l=F.min("low").over(frame))
        diff = F.col("_h") - F.col("_l")
        return _cols(df, **{n: warm(F.when(diff != 0, F.col("_l") + diff * r), lookback) for n, r in FIB_LEVELS.items()}).drop("_h", "_l")

    return Step("fibonacci", tuple(FIB_LEVELS), apply, back=lookback)


def obv_trend(period: int = 20) -> Step:
    """OBV minus its EMA. The difference does not depend on the OBV level, so a block may start at 0."""

    def apply(df: DataFrame) -> DataFrame:
        df = df.withColumn("_v", _signed_volume())
        df = df.withColumn("_obv", F.sum("_v").over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
        df = decaying(df, "_obv", "_e", period, ema_gain(period))
        return df.withColumn("obv_trend", F.col("_obv") - F.col("_e")).drop("_v", "_obv", "_e")

    return Step("obv_trend", ("obv_trend",), apply, back=2 * ema_reach(period), span=ema_span(period))


def obv_slope(period: int = 14) -> Step:
    """Least-squares slope of OBV; also level-free."""

    def apply(df: DataFrame) -> DataFrame:
        df = df.withColumn("_v", _signed_volume())
        df = df.withColumn("_obv", F.sum("_v").over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
        slope = F.regr_slope("_obv", F.col(IDX)).over(rows(-(period - 1), 0))
        return df.withColumn("obv_slope", warm(slope, period - 1)).drop("_v", "_obv")

    return Step("obv_slope", ("obv_slope",), apply, back=period + 1)


def force_index(period: int = 13) -> Step:
    """EMA of price change times volume, over the bars that have a predecessor."""

    def apply(df: DataFrame) -> DataFrame:
        df = df.withColumn("_f", (F.col("close") - lag("close")) * F.col("tick_volume"))
        return decaying(df, "_f", "force_index", period, ema_gain(period), start=1).drop("_f")

    return Step("force_index", ("force_index",), apply, back=ema_reach(period) + 1, span=ema_span(period))
