"""Signal generation and the trade report as single plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.core.blocks import IDX, KEY
from barlab.core.steps import with_indicators
from barlab.functions.scalars import round_level_distance, session_label, trend_direction
from barlab.operators import gates
from barlab.operators.asof import higher_timeframe_features, trend_filter
from barlab.operators.audits import report_totals
from barlab.operators.features import ma_distance, market_state, volume_ratios
from barlab.operators.outcomes import barrier_outcome, trade_records

SEQUENCE_LENGTH = 180


def decision_frame(bars: DataFrame, trend_bars: DataFrame, trend_timeframe: str, trend_period: int, predictions: DataFrame,
                   first_bar: int = SEQUENCE_LENGTH) -> DataFrame:
    """Bars with features, trend side, direction, ensemble statistics and directional confidence.

    A prediction for the ``first_bar`` rows before bar i is attached to bar i, so bars before it have none.
    """
    df = with_indicators(bars, ma_distance(), market_state(), volume_ratios())
    df = trend_filter(df, trend_bars, trend_period, trend_timeframe)
    votes = gates.ensemble(predictions, [*KEY, IDX])
    df = df.filter(F.col(IDX) >= first_bar).join(votes, [*KEY, IDX])
    df = df.withColumn("direction", trend_direction(F.col("trend_filter_above"), F.col("close"), F.col("trend_filter_ma")))
    return df.withColumn("confidence", gates.directional_confidence(F.col("direction"), F.col("proba_buy"), F.col("proba_sell")))


def gated(df: DataFrame, threshold: float = gates.DECISION_CONFIDENCE_PCT, adx_min: float = gates.ADX_MIN) -> DataFrame:
    ok = gates.technical_gate(F.col("direction"), F.col("adx"), F.col("volume_momentum"), F.col("ma_fast"), F.col("ma_slow"),
                              F.col("trend_filter_above"), adx_min=adx_min)
    return df.filter(gates.confidence_gate(F.col("direction"), F.col("confidence"), threshold) & ok)


def generate_signals(decisions: DataFrame, bars: DataFrame, sl_points: float, tp_points: float, point: float,
                     threshold: float = gates.DECISION_CONFIDENCE_PCT, adx_min: float = gates.ADX_MIN) -> DataFrame:
    """Signals that pass the gates, with their simulated outcome; after a losing one the day is closed."""
    out = barrier_outcome(gated(decisions, threshold, adx_min), bars, F.lit(float(sl_points)) * point, F.lit(float(tp_points)) * point)
    return gates.daily_lock(out, F.col("outcome") == "LOSS", keep_first_loss=False)


def trade_report(decisions: DataFrame, bars: DataFrame, higher: dict[str, DataFrame], pip: Column, threshold: float = gates.DECISION_CONFIDENCE_PCT,
                 green_only: bool = True) -> DataFrame:
    """Detail rows of the report: gated, risk-checked, closed trades under the daily lock (the loser is kept)."""
    context = higher_timeframe_features(bars.select(*KEY, IDX, "ts"), higher).drop("ts")
    df = decisions.join(context, [*KEY, IDX])
    df = df.withColumns({"round_dist_pips": round_level_distance(F.col("close"), pip), "session": session_label(F.hour("ts"))})
    df = gates.risk_flags(gated(df, threshold))
    df = gates.all_green(df) if green_only else df
    trades = trade_records(df, bars, pip=pip)
    trades = trades.withColumn("ma_extension", (F.col("close") - F.col("ma_fast")) / F.col("atr"))
    return gates.daily_lock(trades, F.col("result") == "Perte", keep_first_loss=True)


__all__ = ["decision_frame", "gated", "generate_signals", "trade_report", "report_totals"]
