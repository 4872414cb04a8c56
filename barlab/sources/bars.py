"""Bars from ticks, bar scans, and delimited bar text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.core.blocks import IDX, KEY, index_bars, index_rows

#: Seconds per bar of each timeframe (fixed values); weeks and months are nominal.
TIMEFRAME_SECONDS = {"M1": 60, "M5": 300, "M15": 900, "M30": 1800, "H1": 3600, "H4": 14400, "D1": 86400,
                     "W1": 604800, "MN1": 2592000}

#: Fewest bars a backtest accepts.
MIN_BARS = 200
#: Hourly bars counted per year (260 days).
H1_BARS_PER_YEAR = 6240


def bucket_start(ts: Column, timeframe: str) -> Column:
    """UTC start of the bar that holds ``ts``; weeks start on Monday."""
    if timeframe == "MN1":
        return F.date_trunc("month", ts)
    if timeframe == "W1":
        return F.date_trunc("week", ts)
    step = TIMEFRAME_SECONDS[timeframe]
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / step) * step)


def tick_order(ts: Column, tie: Column) -> Column:
    """(time, non-negative integer tie) as one decimal. An order of fixed width keeps the bar aggregation a hash
    aggregate; a struct would make Spark sort all ticks first."""
    micros = F.unix_micros(ts.cast("timestamp")).cast("decimal(18,0)")
    return micros * F.lit("1" + "0" * 19).cast("decimal(20,0)") + tie.cast("decimal(19,0)")


def build_bars(ticks: DataFrame, timeframe: str, symbol: str, ts: str, price: str, tie: str) -> DataFrame:
    """Ticks to bars. First and last price are partial aggregates on (ts, tie), so a symbol or hour with a
    third of all ticks is reduced before the shuffle. ``tie`` is a non-negative integer column."""
    order = tick_order(F.col(ts), F.col(tie))
    return (ticks.groupBy(F.col(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"),
                          bucket_start(F.col(ts), timeframe).alias("ts"))
            .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
                 F.max_by(price, order).alias("close"), F.count(F.lit(1)).alias("tick_volume")))


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Coarser bars from finer ones."""
    return (bars.groupBy("symbol", F.lit(timeframe).alias("timeframe"), bucket_start(F.col("ts"), timeframe).alias("ts"))
            .agg(F.min_by("open", F.col("ts")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                 F.max_by("close", F.col("ts")).alias("close"), F.sum("tick_volume").alias("tick_volume")))


def indexed(bars: DataFrame, timeframe: str) -> DataFrame:
    return index_bars(bars, TIMEFRAME_SECONDS[timeframe])


def write_bars(bars: DataFrame, path: str, mode: str = "append") -> None:
    """Store bars by symbol and timeframe, so time-range scans prune folders and row groups."""
    bars.repartition("symbol", "timeframe", F.year("ts")).sortWithinPartitions("symbol", "timeframe", "ts").write.mode(
        mode).partitionBy("symbol", "timeframe").parquet(path)


# ---------------------------------------------------------------- scans


def latest(bars: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` bars of each series."""
    return bars.filter(F.col(IDX) >= F.col("n_bars") - n)


def history_chunk(bars: DataFrame, years: int, chunk: int, per_year: int = H1_BARS_PER_YEAR) -> DataFrame:
    """Chunk ``chunk`` (1 = oldest) of the last ``years`` years, counted back from the newest bar."""
    back = F.col("n_bars") - F.col(IDX)
    return bars.filter((back > (years - chunk) * per_year) & (back <= (years - chunk + 1) * per_year))


def time_range(bars: DataFrame, start: str, end: str, timeframe: str, warmup: int = 0) -> DataFrame:
    """Bars from ``warmup`` bar widths before ``start`` to ``end``; a plain range on ``ts``, pushed to the scan."""
    first = F.lit(start).cast("timestamp") - F.make_dt_interval(secs=F.lit(float(warmup * TIMEFRAME_SECONDS[timeframe])))
    return bars.filter((F.col("ts") >= first) & (F.col("ts") <= F.lit(end).cast("timestamp")))


def backtest_scan(bars: DataFrame, timeframe: str, start: str | None = None, end: str | None = None,
                  minimum: int = MIN_BARS, depth: int | None = None) -> DataFrame:
    """Date window, else the newest ``depth`` bars, else the whole history; series shorter than ``minimum`` give no rows."""
    if start and end:
        picked = time_range(bars, start, end, timeframe)
    else:
        picked = latest(bars, depth) if depth else bars
    enough = picked.groupBy(*KEY).count().filter(F.col("count") >= minimum).drop("count")
    return picked.join(enough, KEY, "left_semi")


def parse_bar_text(texts: DataFrame, symbol: str = "symbol", text: str = "data") -> DataFrame:
    """``time,open,high,low,close,volume;...`` records; malformed records are dropped."""
    rec = texts.select(F.col(symbol).alias("symbol"), F.explode(F.split(text, ";")).alias("rec"))
    parts = F.split("rec", ",")
    num = lambda i, t: F.trim(F.get(parts, F.lit(i))).try_cast(t)
    out = rec.filter(F.size(parts) == 6).select(
        "symbol", F.timestamp_seconds(num(0, "bigint")).alias("ts"), num(1, "double").alias("open"), num(2, "double").alias("high"),
        num(3, "double").alias("low"), num(4, "double").alias("close"), num(5, "bigint").alias("tick_volume"))
    return out.dropna()
