"""Trade outcomes: barrier labels, barrier profit, and full trade records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.core.blocks import IDX, KEY, rows
from barlab.core.steps import Step, with_indicators
from barlab.functions.scalars import pip_size, price_digits
from barlab.operators.touch import CHUNK, first_touch

HORIZON = 200
SL_ATR = 1.5
TP_ATR = 2.0


def _levels(entries: DataFrame, stop: Column, target: Column) -> DataFrame:
    """Upper/lower touch prices from distances below/above the entry in trade direction."""
    buy = F.col("direction") == "BUY"
    return entries.withColumns({"_up": F.col("close") + F.when(buy, target).otherwise(stop), "_down": F.col("close") - F.when(buy, stop).otherwise(target)})


def _stopped() -> Column:
    """The stop wins when one bar reaches both prices."""
    return F.when(F.col("direction") == "BUY", F.col("hit_lower")).otherwise(F.col("hit_upper"))


def barrier_outcome(entries: DataFrame, bars: DataFrame, stop: Column, target: Column, horizon: int | None = HORIZON) -> DataFrame:
    """Add ``outcome`` WIN, LOSS or OPEN and ``exit_idx``. Entries carry direction, close and bar_idx."""
    hit = first_touch(_levels(entries, stop, target), bars, "_up", "_down", horizon)
    outcome = F.when(F.col("hit_idx").isNull(), "OPEN").when(_stopped(), "LOSS").otherwise("WIN")
    return hit.withColumns({"outcome": outcome, "exit_idx": F.col("hit_idx")}).drop("_up", "_down", "hit_idx", "hit_upper", "hit_lower")


def barrier_profit(entries: DataFrame, bars: DataFrame, stop: Column, target: Column) -> DataFrame:
    """Add ``profit`` in price units; trades that reach neither price before the series ends give 0."""
    out = barrier_outcome(entries.withColumns({"_sl": stop, "_tp": target}), bars, F.col("_sl"), F.col("_tp"), None)
    return out.withColumn("profit", F.when(F.col("outcome") == "WIN", F.col("_tp")).when(F.col("outcome") == "LOSS", -F.col("_sl")).otherwise(0.0)).drop("_sl", "_tp")


def excursions(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Highest high and lowest low over (bar_idx, exit_idx]. Inner chunks use their extremes, the two outer
    ones their bars, so a long trade adds one row per 256 bars."""
    packed = (bars.groupBy(*KEY, F.floor(F.col(IDX) / CHUNK).alias("_grp"))
              .agg(F.collect_list(F.struct(F.col(IDX).alias("pos"), "high", "low")).alias("_arr"), F.max("high").alias("_mh"), F.min("low").alias("_ml")))
    spans = trades.withColumn("_tid", F.struct(*KEY, IDX, "direction")).withColumn(
        "_grp", F.explode(F.sequence(F.floor((F.col(IDX) + 1) / CHUNK), F.floor(F.col("exit_idx") / CHUNK))))
    j = spans.select(*KEY, "_tid", "_grp", F.col(IDX).alias("_from"), F.col("exit_idx").alias("_to")).join(packed, [*KEY, "_grp"])
    whole = (F.col("_from") < F.col("_grp") * CHUNK) & (F.col("_to") >= (F.col("_grp") + 1) * CHUNK - 1)
    part = F.filter("_arr", lambda b: (b.pos > F.col("_from")) & (b.pos <= F.col("_to")))
    j = j.withColumns({"_hi": F.when(whole, F.col("_mh")).otherwise(F.array_max(F.transform(part, lambda b: b.high))),
                       "_lo": F.when(whole, F.col("_ml")).otherwise(F.array_min(F.transform(part, lambda b: b.low)))})
    ext = j.groupBy(F.col("_tid")).agg(F.max("_hi").alias("max_high"), F.min("_lo").alias("min_low"))
    ext = ext.select(*[F.col(f"_tid.{c}").alias(c) for c in (*KEY, IDX, "direction")], "max_high", "min_low")
    return trades.join(ext, [*KEY, IDX, "direction"], "left")


def trade_records(entries: DataFrame, bars: DataFrame, sl_mult: float = SL_ATR, tp_mult: float = TP_ATR, window: int = 24,
                  pip: Column | None = None) -> DataFrame:
    """Closed trades with pips, R multiple, excursions in ATR, reachability of the target, and the loss reason.

    Entries carry symbol, timeframe, bar_idx, ts, close, atr, direction.
    """
    reach = Step("reach", ("_fh", "_fl"), lambda d: d.withColumns({"_fh": F.max("high").over(rows(1, window)), "_fl": F.min("low").over(rows(1, window))}), ahead=window)
    ahead = with_indicators(bars, reach).select(*KEY, IDX, "_fh", "_fl")
    entries = entries.filter(F.col("atr") > 0)
    hit = barrier_outcome(entries, bars, F.col("atr") * sl_mult, F.col("atr") * tp_mult, None).filter("outcome <> 'OPEN'")
    t = excursions(hit, bars).join(ahead, [*KEY, IDX], "left")
    buy, won = F.col("direction") == "BUY", F.col("outcome") == "WIN"
    sign = F.when(buy, 1.0).otherwise(-1.0)
    pip, digits = pip_size(F.col("symbol")) if pip is None else pip, price_digits(F.col("symbol"))
    move = F.when(won, F.col("atr") * tp_mult).otherwise(-F.col("atr") * sl_mult)
    target = F.col("close") + sign * F.col("atr") * tp_mult
    reachable = won | F.coalesce(F.when(buy, F.col("_fh") >= target).otherwise(F.col("_fl") <= target), F.lit(False))
    return t.withColumns({
        "result": F.when(won, "Gain").otherwise("Perte"), "result_pips": move / pip, "r_multiple": move / (F.col("atr") * sl_mult),
        "exit_price": F.col("close") + sign * move, "digits": digits,
        "issue_order": F.when(won, "TP_First").otherwise("SL_First"), "tp_reachable": F.when(reachable, "Oui").otherwise("Non"),
        "loss_reason": F.when(~won, F.when(reachable, "SL_Trop_Serré").otherwise("Prediction_Incorrecte")),
        "excursion_up_atr": (F.col("max_high") - F.col("close")) / F.col("atr"),
        "excursion_down_atr": (F.col("close") - F.col("min_low")) / F.col("atr"),
        "drawdown_max_atr": F.when(won, F.when(buy, F.col("close") - F.col("min_low")).otherwise(F.col("max_high") - F.col("close")) / F.col("atr")),
    }).drop("_fh", "_fl", "max_high", "min_low", "outcome")
