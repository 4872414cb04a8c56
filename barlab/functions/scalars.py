"""Price, time and money helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barlab.sources.bars import H1_BARS_PER_YEAR, TIMEFRAME_SECONDS

#: Accepted date layouts (fixed values).
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy.MM.dd HH:mm", "yyyy.MM.dd", "dd/MM/yyyy")
MESSAGE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm")
H1_BARS_PER_MONTH = 504


def parse_timestamp(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First layout that fits; NULL when none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def _lookup(values: dict, key: Column, default) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(table, key), F.lit(default))


def timeframe_minutes(timeframe: Column) -> Column:
    minutes = {k: v // 60 for k, v in TIMEFRAME_SECONDS.items() if k != "MN1"} | {"MN1": 43200}
    return _lookup(minutes, F.upper(timeframe), 60)


def timeframe_interval(timeframe: Column, bars: Column) -> Column:
    return F.make_dt_interval(mins=timeframe_minutes(timeframe) * bars)


def years_to_h1_bars(years: Column) -> Column:
    return (years * H1_BARS_PER_YEAR).cast("bigint")


def months_to_h1_bars(months: Column) -> Column:
    return (months * H1_BARS_PER_MONTH).cast("bigint")


def timeframe_to_h1_bars(timeframe: Column) -> Column:
    return _lookup({"H1": 1, "H4": 4, "D1": 24, "W1": 120, "MN1": 504}, F.upper(timeframe), 4)


# ---------------------------------------------------------------- prices


def pip_size(symbol: Column) -> Column:
    return F.when(symbol.contains("JPY"), 0.01).otherwise(0.0001)


def pip_from_digits(point: Column, digits: Column) -> Column:
    return F.when(digits.isin(3, 5), point * 10).otherwise(point)


def price_digits(symbol: Column) -> Column:
    return F.when(symbol.contains("JPY"), 3).otherwise(5)


def round_level_distance(price: Column, pip: Column) -> Column:
    """Pips to the nearest 50- or 100-pip level; ties of the level number go to the even one."""
    pips = price / pip
    dist = lambda step: F.abs(pips - F.bround(pips / step) * step)
    return F.least(dist(50), dist(100))


def session_label(hour: Column) -> Column:
    """Trading session in UTC; where sessions overlap, London wins over New York over Tokyo."""
    return F.when((hour >= 8) & (hour < 16), "London").when((hour >= 13) & (hour < 21), "NY").when(hour < 8, "Tokyo").otherwise("Off")


def spread_pips(spread_points: Column, point: Column, pip: Column) -> Column:
    return spread_points * point / pip


def round_turn_cost(pips: Column, spread: Column, commission: Column) -> Column:
    """Pips left after spread and commission."""
    return pips - spread - commission


def lot_size(capital: Column, risk_pct: Column, stop_pips: Column, pip: Column, tick_size: Column, tick_value: Column,
             lot_min: Column, lot_step: Column) -> Column:
    per_lot = stop_pips * pip / tick_size * tick_value
    lots = F.bround(capital * risk_pct / 100 / per_lot / lot_step) * lot_step
    return F.when(per_lot <= 0, lot_min).otherwise(F.bround(F.greatest(lot_min, lots), 2))


def stop_price(side: Column, price: Column, atr: Column, multiple: float, digits: int = 5) -> Column:
    return F.round(F.when(side == "BUY", price - atr * multiple).otherwise(price + atr * multiple), digits)


def target_price(side: Column, price: Column, atr: Column, multiple: float, digits: int = 5) -> Column:
    return F.round(F.when(side == "BUY", price + atr * multiple).otherwise(price - atr * multiple), digits)


def clamp01(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def finite_or_zero(col: Column) -> Column:
    """Numbers from text or numbers; NULL, NaN and infinities become 0."""
    x = col.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def duration_text(seconds: Column) -> Column:
    part = lambda unit, base: F.floor(F.pmod(seconds, F.lit(float(base))) / unit).cast("int")
    return (F.when(seconds < 60, F.format_string("%d secondes", F.bround(seconds, 0).cast("int")))
            .when(seconds < 3600, F.format_string("%dmin %ds", part(60, 3600), part(1, 60)))
            .otherwise(F.format_string("%dh %dmin", F.floor(seconds / 3600).cast("int"), part(60, 3600))))


def size_text(size: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0 ** 2, 1024.0 ** 3
    return (F.when(size < kb, F.format_string("%d B", size.cast("bigint"))).when(size < mb, F.format_string("%.1f KB", size / kb))
            .when(size < gb, F.format_string("%.1f MB", size / mb)).otherwise(F.format_string("%.2f GB", size / gb)))


# ---------------------------------------------------------------- signals


def trend_direction(above: Column, close: Column, trend_ma: Column) -> Column:
    """BUY or SELL from the trend side, else from close against the average; NULL when both are unknown."""
    return (F.when(above.isNotNull(), F.when(above == 1, "BUY").otherwise("SELL"))
            .when(close.isNotNull() & trend_ma.isNotNull(), F.when(close > trend_ma, "BUY").otherwise("SELL")))


def classifier_signal(p_buy: Column, p_sell: Column, threshold: float = 0.55) -> Column:
    return F.when(p_buy > threshold, 1).when(p_sell > threshold, -1).otherwise(0)
