"""Inputs of the registered queries: the given tables and what Spark derives from them.

Bars are built once per session and folder and kept (memory and disk), as a bars table would be.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.sources.bars import build_bars, indexed

_kept: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def forget() -> None:
    """Drop kept frames, so that a timing includes building the bars."""
    for df in _kept.values():
        df.unpersist()
    _kept.clear()


def _keep(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _kept:
        _kept[key] = build().persist()
    return _kept[key]


def event_bars(spark: SparkSession, sf: str, timeframe: str = "H1") -> DataFrame:
    """Bars of ``events``: one symbol per event type, price = value."""
    return _keep(spark, sf, timeframe, lambda: indexed(build_bars(
        table(spark, sf, "events"), timeframe, "event_type", "ts", "value", "event_id"), timeframe))


def order_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars of ``orders``: one symbol per priority, price = total."""
    return _keep(spark, sf, "orders", lambda: indexed(build_bars(
        table(spark, sf, "orders"), "D1", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey"), "D1"))


def hash_int(*parts) -> F.Column:
    """32-bit integer from the md5 of the parts joined by '-'; the same in every engine."""
    text = F.concat_ws("-", *[p if not isinstance(p, (int, str)) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def predictions(bars: DataFrame, models: int = 3) -> DataFrame:
    """Stand-in for model output: pseudo-random probability pairs per bar and model."""
    m = bars.select("symbol", "timeframe", "bar_idx", "ts", F.explode(F.array(*[F.lit(i) for i in range(1, models + 1)])).alias("model_id"))
    p = hash_int(F.col("symbol"), F.unix_timestamp("ts").cast("string"), F.col("model_id").cast("string")) % 10001 / 10000.0
    return m.withColumn("p_buy", p).withColumn("p_sell", 1 - F.col("p_buy"))


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """One closed trade per order and return flag: strategy, trade number, day, profit or loss (exact 1/10000)."""
    units = (F.round(F.col("l_extendedprice") * 100) * (F.round(F.col("l_discount") * 100) - F.round(F.col("l_tax") * 100))).cast("bigint")
    return (table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("strategy_id"), F.col("l_orderkey").alias("trade_no"))
            .agg((F.sum(units) / 10000.0).alias("pnl"), F.to_date(F.max("l_shipdate")).alias("day")))


def fixed(col, dp: int = 4):
    """Round half up with a guard for ties, so that the last bits of two engines cannot disagree."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c.cast("double") * 10 ** dp + 0.5000001) / float(10 ** dp)


def show(df: DataFrame, ints: str = "", doubles: str = "", texts: str = "", dp: int = 4) -> DataFrame:
    """Project to comparable types: bigint, rounded double, string."""
    cols = [F.col(c).cast("bigint").alias(c) for c in ints.split()] + [fixed(c, dp).alias(c) for c in doubles.split()]
    return df.select(*[F.col(c).cast("string").alias(c) for c in texts.split()], *cols)
