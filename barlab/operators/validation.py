"""Overfitting analysis, walk-forward reports, candidate acceptance and evaluation history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.scoring import evaluation_verdict, robustness
from barlab.operators.performance import summarise


@dataclass(frozen=True)
class Thresholds:
    """Verdict limits; override any of them per call."""

    degradation_robust: float = 0.70
    degradation_suspect: float = 0.40
    consistency: float = 0.50
    min_oos_profit: float = 0.30
    min_trades: int = 50


def period_results(tagged: DataFrame, key: list[str] = ["strategy_id"]) -> DataFrame:
    """Trades tagged with periods to one result row per key and period."""
    return summarise(tagged, [*key, "period", "kind", "days"])


def _daily(kind: str) -> Column:
    here = F.col("kind") == kind
    return F.coalesce(F.sum(F.when(here, F.col("profit"))) / F.nullif(F.sum(F.when(here, F.col("days"))), F.lit(0)), F.lit(0.0))


def overfit_report(results: DataFrame, key: list[str] = ["strategy_id"], limits: Thresholds = Thresholds()) -> DataFrame:
    """Degradation, consistency, out-of-sample check, verdict and confidence per key from period results."""
    test = lambda c: F.when(F.col("kind") == "test", c)
    df = results.groupBy(*key).agg(
        _daily("train").alias("train_daily"), _daily("test").alias("test_daily"), _daily("oos").alias("oos_daily"),
        F.count_if(F.col("kind") == "train").alias("_ntrain"), F.count_if(F.col("kind") == "test").alias("_ntest"), F.count_if(F.col("kind") == "oos").alias("_noos"),
        F.sum(F.when(F.col("kind").isin("train", "test"), F.col("trades")).otherwise(0)).alias("total_trades"),
        F.avg(test((F.col("profit") > 0).cast("double"))).alias("_share"), F.avg(test(F.col("profit"))).alias("_mean"),
        F.stddev_pop(test(F.col("profit"))).alias("_sd"), F.avg(test(F.col("winrate"))).alias("_wr"))
    ratio = F.when((F.col("_ntrain") > 0) & (F.col("_ntest") > 0) & (F.col("train_daily") > 0),
                   F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("test_daily") / F.col("train_daily")))).otherwise(0.0)
    stability = F.when(F.col("_mean") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("_sd") / F.abs(F.col("_mean")) / 3))
    consistency = F.when(F.col("_ntest") < 2, 1.0).otherwise(
        0.4 * F.col("_share") + 0.35 * stability + 0.25 * F.least(F.lit(1.0), F.col("_wr") / 0.45))
    df = df.withColumns({"degradation_ratio": ratio, "consistency_score": consistency,
                         "oos_ratio": F.when(F.col("_noos") > 0, F.when(F.col("train_daily") > 0, F.col("oos_daily") / F.col("train_daily")).otherwise(0.0))})
    graded = lambda x, full, half: F.when(x >= full, 1.0).when(x >= half, 0.5).otherwise(0.0)
    oos = F.when((F.col("oos_ratio") >= limits.min_oos_profit) & (F.col("oos_daily") > 0), 1.0).when(F.col("oos_daily") > 0, 0.5).otherwise(0.0)
    # one test period says nothing about consistency, and a missing out-of-sample period nothing about that: neither is graded
    grades = F.array_compact(F.array(
        graded(F.col("degradation_ratio"), limits.degradation_robust, limits.degradation_suspect),
        F.when(F.col("_ntest") >= 2, graded(F.col("consistency_score"), limits.consistency, limits.consistency * 0.6)),
        F.when(F.col("_noos") > 0, oos)))
    score = F.aggregate(grades, F.lit(0.0), lambda acc, g: acc + g) / F.size(grades)
    thin = F.col("total_trades") < limits.min_trades
    df = df.withColumn("_score", score)
    verdict = F.when(thin, "insufficient_data").when(F.col("_score") >= 0.75, "robust").when(F.col("_score") >= 0.40, "suspect").otherwise("overfitted")
    confidence = F.when(thin, 0.0).otherwise(F.least(F.lit(1.0), F.abs(F.col("_score") - 0.5) * 2 + 0.3))
    df = df.withColumns({"verdict": verdict, "confidence": confidence, "degradation_ratio": F.when(thin, 0.0).otherwise(F.col("degradation_ratio")),
                         "consistency_score": F.when(thin, 0.0).otherwise(F.col("consistency_score"))})
    return df.drop("_ntrain", "_ntest", "_noos", "_share", "_mean", "_sd", "_wr", "_score")


def walk_forward_report(results: DataFrame, key: list[str] = ["strategy_id"]) -> DataFrame:
    """Sums over trade windows, efficiency against the training profit, share of profitable windows, verdict."""
    paired = results.groupBy(*key, "period").agg(*[
        F.sum(F.when(F.col("kind") == kind, F.col(c))).alias(f"{kind}_{c}") for kind, c in (("train", "profit"), ("test", "profit"), ("test", "trades"), ("test", "wins"))])
    df = paired.filter(F.col("test_trades").isNotNull()).groupBy(*key).agg(
        F.count(F.lit(1)).alias("windows"), F.sum("test_profit").alias("overall_profit"), F.sum("test_trades").alias("overall_trades"),
        F.sum("test_wins").alias("_wins"), F.sum("train_profit").alias("_is"), F.avg((F.col("test_profit") > 0).cast("double")).alias("consistency_ratio"))
    df = df.withColumns({"overall_winrate": F.when(F.col("overall_trades") > 0, F.col("_wins") / F.col("overall_trades")).otherwise(0.0),
                         "wfe": F.when(F.col("_is") > 0, F.col("overall_profit") / F.col("_is")).otherwise(0.0)})
    verdict = (F.when(F.col("windows") < 3, "insufficient_data").when((F.col("wfe") >= 0.5) & (F.col("consistency_ratio") >= 0.6), "robust")
               .when((F.col("wfe") >= 0.3) & (F.col("consistency_ratio") >= 0.45), "suspect").otherwise("overfitted"))
    return df.withColumn("wf_verdict", verdict).drop("_wins", "_is")


def accept_candidates(candidates: DataFrame, minimum: float = 40.0) -> DataFrame:
    """Acceptance from verdict, wf_verdict (NULL when not run), train_score, test_score, oos_score."""
    penalty, rob, adjusted = robustness(F.col("train_score"), F.col("test_score"), F.col("oos_score"))
    bonus = F.when(F.col("wf_verdict") == "robust", 1.1).when(F.col("wf_verdict") == "suspect", 0.9).otherwise(1.0)
    overfit = F.coalesce(F.col("verdict") == "overfitted", F.lit(False))
    failed = F.coalesce(F.col("wf_verdict") == "overfitted", F.lit(False))
    df = candidates.withColumns({"penalty": penalty, "robustness_score": F.when(overfit, 0.0).otherwise(rob), "adjusted_score": F.when(overfit, 0.0).otherwise(adjusted * bonus)})
    reason = F.when(overfit, "overfitted").when(failed, "walk_forward").when(F.col("robustness_score") < minimum, "robustness")
    return df.withColumn("rejection_reason", reason).withColumn("accepted", reason.isNull())


def evaluate(results: DataFrame, score: str = "adjusted_score", significant: str | None = None) -> DataFrame:
    """Verdict and recommendation; results that failed the resampling tests are questionable."""
    verdict, recommendation = evaluation_verdict(F.col(score))
    if significant:
        doubt = ~F.col(significant)
        verdict = F.when(doubt, "statistically_questionable").otherwise(verdict)
        recommendation = F.when(doubt, "reject_or_investigate").otherwise(recommendation)
    return results.withColumns({"evaluation": verdict, "recommendation": recommendation})


def abandon(history: DataFrame, key: str = "strategy_id", order: str = "eval_no", score: str = "adjusted_score", last: int = 3, floor: float = 15.0) -> DataFrame:
    """Keys whose latest ``last`` evaluations average below ``floor``. The top rows are cut map-side by the window limit."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    recent = history.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= last)
    agg = recent.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.avg(score).alias("recent_score"))
    return agg.withColumn("abandon", (F.col("_n") == last) & (F.col("recent_score") < floor)).drop("_n")
