"""Stop/target grid over horizons and ATR timeframes in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.core.blocks import IDX, KEY
from barlab.operators.asof import asof_join
from barlab.operators.touch import first_touch
from barlab.core.steps import with_indicators
from barlab.operators.indicators import atr
from barlab.sources.bars import TIMEFRAME_SECONDS

#: Default grid (fixed values).
SL_GRID = (0.5, 1.0, 1.5, 2.0)
TP_GRID = (1.0, 2.0, 3.0, 4.0)


def atr_by_timeframe(base: DataFrame, timeframes: dict[str, DataFrame], period: int = 14) -> DataFrame:
    """``atr_<tf>`` of every timeframe on the base bars, matched backward on the bar time and carried forward."""
    rights = []
    for name, bars in timeframes.items():
        col = f"atr_{name.lower()}"
        rights.append((with_indicators(bars, atr(period, out=col)).select("symbol", "ts", col), [col]))
    return asof_join(base, rights, ["symbol"], max(TIMEFRAME_SECONDS[n] for n in timeframes) * 1024, skip_nulls=True)


def barrier_grid(entries: DataFrame, bars: DataFrame, timeframes: list[str], sl_grid=SL_GRID, tp_grid=TP_GRID) -> DataFrame:
    """Profit per (symbol, horizon, sl timeframe, tp timeframe, sl, tp).

    Entries carry horizon, signal (+1/-1), close and ``atr_<tf>``. A stop and a target are reached independently
    of each other, so only len(tf)*(len(sl)+len(tp)) searches per bar and side are needed, shared by all horizons
    and combined into the grid inside the row.
    """
    tfs = [t.lower() for t in timeframes]
    cols = [f"atr_{t}" for t in tfs]
    levels = []
    for t in tfs:
        for kind, grid in (("sl", sl_grid), ("tp", tp_grid)):
            for n, m in enumerate(grid):
                levels.append(F.struct(F.lit(kind).alias("kind"), F.lit(t).alias("tf"), F.lit(n).alias("n"), (F.col(f"atr_{t}") * m).alias("dist")))
    points = entries.select(*KEY, IDX, "close", "signal", *cols).distinct()
    cells = points.select(*KEY, IDX, "close", "signal", F.explode(F.array(*levels)).alias("l")).select("*", "l.*").drop("l").filter("dist is not null")
    inf = float("inf")
    above = (F.col("signal") == 1) == (F.col("kind") == "tp")
    cells = cells.withColumns({"_up": F.when(above, F.col("close") + F.col("dist")).otherwise(inf), "_dn": F.when(above, -inf).otherwise(F.col("close") - F.col("dist"))})
    hits = first_touch(cells, bars, "_up", "_dn")
    never = F.lit((1 << 62))
    hits = hits.withColumn("hit", F.coalesce("hit_idx", never))
    per_entry = hits.groupBy(*KEY, IDX, "signal").agg(*[
        F.collect_list(F.when(F.col("kind") == k, F.struct("tf", "n", "dist", "hit"))).alias(k) for k in ("sl", "tp")])
    grid = per_entry.select(*KEY, IDX, "signal", F.explode("sl").alias("s"), "tp").select(*KEY, IDX, "signal", "s", F.explode("tp").alias("t"))
    profit = F.when((F.col("s.hit") == never) & (F.col("t.hit") == never), 0.0).when(F.col("s.hit") <= F.col("t.hit"), -F.col("s.dist")).otherwise(F.col("t.dist"))
    grid = grid.select(*KEY, IDX, "signal", F.col("s.tf").alias("sl_tf"), F.col("t.tf").alias("tp_tf"), F.col("s.n").alias("sl_n"), F.col("t.n").alias("tp_n"), profit.alias("profit"))
    joined = entries.select(*KEY, IDX, "signal", "horizon").join(grid, [*KEY, IDX, "signal"])
    out = joined.groupBy("symbol", "horizon", "sl_tf", "tp_tf", "sl_n", "tp_n").agg(F.sum("profit").alias("profit"), F.count(F.lit(1)).alias("entries"))
    sl_values, tp_values = (F.array(*[F.lit(x) for x in g]) for g in (sl_grid, tp_grid))
    return out.withColumns({"sl_mult": F.get(sl_values, F.col("sl_n")), "tp_mult": F.get(tp_values, F.col("tp_n"))})


def best_cells(grid: DataFrame, by: list[str], timeframes: list[str], horizons: list[str]) -> DataFrame:
    """Most profitable cell per ``by`` (profits equal to 6 digits tie); ties go to the earlier horizon, timeframe pair, stop and target."""
    rank = lambda col, values: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(col))
    tfs = [t.lower() for t in timeframes]
    order = [F.round("profit", 6).desc(), rank("horizon", horizons), rank("sl_tf", tfs), rank("tp_tf", tfs), F.col("sl_n"), F.col("tp_n")]
    w = Window.partitionBy(*by).orderBy(*order)
    return grid.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "sl_n", "tp_n")
