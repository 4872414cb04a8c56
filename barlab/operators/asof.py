"""Backward as-of joins and the features built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.core.blocks import lag, rows, running
from barlab.core.steps import Step, with_indicators
from barlab.operators.indicators import atr, sma
from barlab.sources.bars import TIMEFRAME_SECONDS, indexed, resample


def asof_join(left: DataFrame, rights: Sequence[tuple[DataFrame, Sequence[str]]], key: Sequence[str], block_seconds: int,
              ts: str = "ts", skip_nulls: bool = False) -> DataFrame:
    """For each left row the columns of the latest row of every right side with the same key and time <= its own.

    ``rights`` lists (frame, columns). All sides are stacked once and the last right rows are carried forward,
    first inside time blocks, then over one row per block. No side is broadcast and no pair is formed.
    ``skip_nulls`` carries the last known value of each column instead of the last row.
    """
    key = list(key)
    stacked = left.withColumns({"_t": F.col(ts), "_side": F.lit(1)})
    aggs, outputs = {}, []
    for n, (right, cols) in enumerate(rights):
        packed = F.struct(*[F.col(c) for c in cols]).alias(f"_r{n}")
        stacked = stacked.unionByName(right.select(*key, F.col(ts).alias("_t"), F.lit(0).alias("_side"), packed), allowMissingColumns=True)
        for c in cols if skip_nulls else [None]:
            name = f"_m{n}_{c}" if c else f"_m{n}"
            aggs[name] = ("last", F.col(f"_r{n}.{c}") if c else F.col(f"_r{n}"))
            outputs += [F.col(name).alias(c)] if c else [F.col(f"{name}.{x}").alias(x) for x in cols]
    stacked = stacked.withColumn("_tb", F.floor(F.unix_timestamp("_t") / block_seconds))
    joined = running(stacked, key, "_tb", ["_t", "_side"], aggs)
    return joined.filter("_side = 1").select(*left.columns, *outputs)


def higher_timeframe_features(base: DataFrame, timeframes: dict[str, DataFrame], anchor: str = "prev") -> DataFrame:
    """Trend (SMA5/SMA20-1) and volatility (ATR14/close) of higher timeframes on the base bars, carried forward.

    ``timeframes`` maps a name such as ``H4`` to indexed bars. ``anchor="current"`` matches the open bar of the
    higher timeframe, which is still forming; ``"prev"`` only uses finished bars.
    """
    rights = []
    for name, bars in timeframes.items():
        low = name.lower()
        feats = with_indicators(bars, sma(5, out="_s5"), sma(20, out="_s20"), atr(14, out="_a"))
        shift = TIMEFRAME_SECONDS[name] if anchor == "prev" else 0
        feats = feats.select("symbol", (F.col("ts") + F.make_dt_interval(secs=F.lit(float(shift)))).alias("ts"),
                             (F.col("_s5") / F.col("_s20") - 1).alias(f"trend_{low}"), (F.col("_a") / F.col("close")).alias(f"volatility_{low}"))
        rights.append((feats, [f"trend_{low}", f"volatility_{low}"]))
    widest = max(TIMEFRAME_SECONDS[n] for n in timeframes)
    return asof_join(base, rights, ["symbol"], widest * 1024, skip_nulls=True)


def trend_filter(base: DataFrame, trend_bars: DataFrame, period: int, timeframe: str, anchor: str = "prev") -> DataFrame:
    """Trend average of another timeframe (shifted one bar when ``anchor="prev"``) and the side of the close."""
    ma = with_indicators(trend_bars, sma(period, out="_ma"))
    shift = Step("shift", ("trend_filter_ma",), lambda d: d.withColumn("trend_filter_ma", lag("_ma") if anchor == "prev" else F.col("_ma")), back=1)
    ma = with_indicators(ma, shift).select("symbol", "ts", "trend_filter_ma")
    out = asof_join(base, [(ma, ["trend_filter_ma"])], ["symbol"], TIMEFRAME_SECONDS[timeframe] * 1024)
    above = F.when(F.col("trend_filter_ma").isNull(), F.lit(0)).otherwise((F.col("close") > F.col("trend_filter_ma")).cast("int"))
    return out.withColumn("trend_filter_above", above)


def trend_filter_from_base(base: DataFrame, period: int, timeframe: str) -> DataFrame:
    """Trend average when no bars of the trend timeframe exist: resample the base, average over up to
    ``period`` buckets (empty ones count), shift one bucket, carry forward."""
    coarse = indexed(resample(base, timeframe), timeframe)
    step = TIMEFRAME_SECONDS[timeframe]

    def apply(df: DataFrame) -> DataFrame:
        df = df.withColumn("_bucket", F.floor(F.unix_timestamp("ts") / step))
        frame = Window.partitionBy("symbol", "timeframe", "_blk").orderBy("_bucket").rangeBetween(-period, -1)
        return df.withColumn("trend_filter_ma", F.avg("close").over(frame)).drop("_bucket")

    ma = with_indicators(coarse, Step("partial_mean", ("trend_filter_ma",), apply, back=period))
    out = asof_join(base, [(ma, ["trend_filter_ma"])], ["symbol"], step * 1024)
    return out.withColumn("trend_filter_above", F.coalesce((F.col("close") > F.col("trend_filter_ma")).cast("int"), F.lit(0)))


def rolling_correlation(base: DataFrame, others: Sequence[str], window: int = 50, block_seconds: int = 3600 * 4096) -> DataFrame:
    """Correlation of each series' returns with the latest return of the reference symbols ``others``
    (output ``corr_0``, ``corr_1``, ... in their order; NULL against itself)."""
    names = [f"corr_{n}" for n in range(len(others))]
    out = with_indicators(base, Step("returns", ("_ret",), lambda d: d.withColumn("_ret", F.col("close") / lag("close") - 1), back=1))
    per_ts = out.groupBy("ts").agg(*[F.max(F.when(F.col("symbol") == o, F.col("_ret"))).alias(f"_at{n}") for n, o in enumerate(others)])
    per_ts = per_ts.withColumn("_tb", F.floor(F.unix_timestamp("ts") / block_seconds))
    refs = running(per_ts, [], "_tb", ["ts"], {f"_ref{n}": ("last", F.col(f"_at{n}")) for n in range(len(others))})
    out = out.join(refs.select("ts", *[f"_ref{n}" for n in range(len(others))]), "ts")

    def corr(df: DataFrame) -> DataFrame:
        frame = rows(-(window - 1), 0)
        for n, (name, other) in enumerate(zip(names, others)):
            both = F.count(F.when(F.col("_ret").isNotNull() & F.col(f"_ref{n}").isNotNull(), 1)).over(frame)
            df = df.withColumn(name, F.when((both == window) & (F.col("symbol") != other), F.corr("_ret", f"_ref{n}").over(frame)))
        return df

    out = with_indicators(out, Step("correlation", tuple(names), corr, back=window))
    return out.drop("_ret", *[f"_ref{n}" for n in range(len(others))])
