"""Signal gates, ensemble votes and structural risk flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gate and risk thresholds (fixed values).
ADX_MIN = 0.0
VOLUME_MOMENTUM_MIN = 0.0
DECISION_CONFIDENCE_PCT = 20.0
TREND_DISTANCE_MIN_ATR = 0.30
ROUND_LEVEL_MIN_PIPS = 10.0
EXTENSION_MAX_ATR = 1.8
MARGIN_MIN_PCT = 6.0
DIVERGENCE_MARGIN_MIN_PCT = 12.0


def _known_and(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def technical_gate(signal: Column, adx: Column, volume_momentum: Column, ma_fast: Column, ma_slow: Column,
                   trend_above: Column | None = None, adx_min: float = ADX_MIN, volume_min: float = VOLUME_MOMENTUM_MIN) -> Column:
    """True unless a known value speaks against the signal; unknown values pass."""
    against = [adx < adx_min, volume_momentum < volume_min,
               (signal == "BUY") & (ma_fast < ma_slow), (signal == "SELL") & (ma_fast > ma_slow)]
    if trend_above is not None:
        against += [(signal == "BUY") & (trend_above == 0), (signal == "SELL") & (trend_above == 1)]
    return ~reduce(lambda a, b: a | b, [_known_and(c) for c in against])


def news_gate(signal: Column, sentiment: Column) -> Column:
    """Longs need non-negative sentiment, shorts non-positive."""
    return ~(_known_and((signal == "BUY") & (sentiment < 0)) | _known_and((signal == "SELL") & (sentiment > 0)))


def ensemble(predictions: DataFrame, key: list[str]) -> DataFrame:
    """Per key: mean class probabilities, margin, ensemble confidence, votes and consensus over the models."""
    vote = F.when(F.col("p_buy") >= F.col("p_sell"), "BUY").otherwise("SELL")
    agg = predictions.withColumn("_vote", vote).groupBy(*key).agg(
        F.avg("p_buy").alias("proba_buy"), F.avg("p_sell").alias("proba_sell"),
        (F.avg(F.greatest("p_buy", "p_sell")) * 100).alias("ensemble_conf"),
        F.count_if(F.col("_vote") == "BUY").alias("n_buy"), F.count(F.lit(1)).alias("n_models"))
    n_sell = F.col("n_models") - F.col("n_buy")
    consensus = (F.when(F.col("n_buy") > n_sell, F.concat_ws(" ", F.concat_ws("/", "n_buy", "n_models"), F.lit("BUY")))
                 .when(n_sell > F.col("n_buy"), F.concat_ws(" ", F.concat_ws("/", n_sell, "n_models"), F.lit("SELL")))
                 .otherwise(F.concat_ws(" ", F.concat_ws("/", "n_buy", "n_models"), F.lit("EGALITE"))))
    return agg.withColumns({"margin": F.abs(F.col("proba_buy") - F.col("proba_sell")) * 100, "consensus": consensus,
                            "unanimous": (F.col("n_buy").isin(0) | (F.col("n_buy") == F.col("n_models"))).cast("int")})


def directional_confidence(direction: Column, proba_buy: Column, proba_sell: Column) -> Column:
    """Mean probability of the chosen side, in percent; 0 without a direction."""
    return F.when(direction == "BUY", proba_buy * 100).when(direction.isNotNull(), proba_sell * 100).otherwise(0.0)


def confidence_gate(direction: Column, confidence: Column, threshold: float = DECISION_CONFIDENCE_PCT) -> Column:
    return direction.isNotNull() & (confidence >= threshold)


def risk_flags(df: DataFrame, direction: str = "direction", compat_never_extended: bool = False) -> DataFrame:
    """Six risk flags, score, reasons and the absolute trend distance.

    Needs close, atr, trend_filter_ma, ma_fast, round_dist_pips, margin, session, trend_h4. The session flag is
    informative and does not count in the score.
    """
    c = F.col
    distance = F.when(c("atr") > 0, F.abs((c("close") - c("trend_filter_ma")) / c("atr")))
    extension = F.when(c("atr") > 0, (c("close") - c("ma_fast")) / c("atr"))
    sign = F.when(c(direction) == "BUY", 1).otherwise(-1)
    diverges = (sign * F.signum("trend_h4") < 0) & (c("margin") < DIVERGENCE_MARGIN_MIN_PCT)
    tests = {
        "risk_trend_near": (distance < TREND_DISTANCE_MIN_ATR, "Proche_MA_Tendance"),
        "risk_round_near": (c("round_dist_pips") < ROUND_LEVEL_MIN_PIPS, "Proche_Round"),
        "risk_extended": (F.lit(False) if compat_never_extended else F.abs(extension) > EXTENSION_MAX_ATR, "Sur_Extension"),
        "risk_low_margin": (c("margin") < MARGIN_MIN_PCT, "Marge_Faible"),
        "risk_off_session": (c("session") == "Off", "Session_Off"),
        "risk_diverge_h4": (diverges, "Divergence_H4"),
    }
    df = df.withColumns({name: _known_and(test).cast("int") for name, (test, _) in tests.items()})
    scored = [n for n in tests if n != "risk_off_session"]
    reasons = F.concat_ws(",", *[F.when(c(n) == 1, reason) for n, (_, reason) in tests.items()])
    return df.withColumns({"risk_score": reduce(lambda a, b: a + b, [c(n) for n in scored]), "risk_reasons": reasons, "trend_distance_atr": distance})


def all_green(df: DataFrame) -> DataFrame:
    return df.filter(F.col("risk_score") == 0)


# ---------------------------------------------------------------- daily loss lock


def daily_lock(signals: DataFrame, is_loss: Column, keep_first_loss: bool) -> DataFrame:
    """Signals allowed while the day holds no loss yet.

    ``keep_first_loss`` keeps the losing signal itself; otherwise it is dropped too. A day of one series bounds
    the partition, and everything after the first loss is dropped, so a running count is exact.
    """
    day = Window.partitionBy("symbol", "timeframe", F.to_date("ts")).orderBy("ts").rowsBetween(
        Window.unboundedPreceding, -1 if keep_first_loss else 0)
    losses = F.coalesce(F.sum(F.when(is_loss, 1).otherwise(0)).over(day), F.lit(0))
    return signals.withColumn("_losses", losses).filter("_losses = 0").drop("_losses")
