"""Report totals and grouped error audits over trade records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Inner bin edges of the audits (fixed values); bins are right-closed and unbounded at both ends.
AUDIT_EDGES = {
    "trend_distance": (0.15, 0.30, 0.45, 0.60, 0.90),
    "round_distance": (5.0, 8.0, 10.0, 15.0, 20.0, 50.0),
    "ma_extension": (0.5, 1.0, 1.5, 1.8, 2.0, 2.5),
    "margin": (3.0, 5.0, 7.0, 10.0, 15.0, 20.0, 30.0),
}


def report_totals(trades: DataFrame, key: list[str] = ["symbol"]) -> DataFrame:
    wrong = lambda reason: F.count_if(F.coalesce(F.col("loss_reason") == reason, F.lit(False)))
    return trades.groupBy(*key).agg(
        F.sum("result_pips").alias("sum_pips"), F.count_if(F.col("result") == "Gain").alias("gains"),
        F.count_if(F.col("result") == "Perte").alias("losses"), wrong("Prediction_Incorrecte").alias("wrong_predictions"),
        wrong("SL_Trop_Serré").alias("stops_too_tight"))


def _bin(value: str, edges: tuple[float, ...]):
    """Number of edges strictly below the value: 0 for (-inf, e0], 1 for (e0, e1], ..."""
    x = F.abs(F.col(value))
    out = F.lit(len(edges))
    for n in reversed(range(len(edges))):
        out = F.when(x <= edges[n], n).otherwise(out)
    return F.when(x.isNotNull() & ~F.isnan(x), out.cast("string"))


def risk_audit(trades: DataFrame, measures: dict[str, str]) -> DataFrame:
    """Trades, gains, wrong predictions and error rate per bin of every measure, per session and per H4 divergence.

    ``measures`` maps an audit name of ``AUDIT_EDGES`` to a column. All groupings share one pass: each trade is
    copied once per grouping and reduced map-side. Empty bins are kept.
    """
    diverge = F.coalesce((F.when(F.col("direction") == "BUY", 1).otherwise(-1) * F.signum("trend_h4") < 0).cast("int"), F.lit(0))
    tags = [F.struct(F.lit(a).alias("audit"), _bin(c, AUDIT_EDGES[a]).alias("bin")) for a, c in measures.items()]
    tags += [F.struct(F.lit("session").alias("audit"), F.col("session").alias("bin")),
             F.struct(F.lit("diverge_h4").alias("audit"), diverge.cast("string").alias("bin"))]
    rows = trades.select("result", "loss_reason", F.explode(F.array(*tags)).alias("t")).select("result", "loss_reason", "t.*")
    agg = rows.filter(F.col("bin").isNotNull()).groupBy("audit", "bin").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("result") == "Gain").alias("n_gain"),
        F.count_if(F.coalesce(F.col("loss_reason") == "Prediction_Incorrecte", F.lit(False))).alias("n_wrong"))
    bins = [(a, str(n)) for a in measures for n in range(len(AUDIT_EDGES[a]) + 1)]
    frame = trades.sparkSession.createDataFrame(bins, "audit string, bin string")
    full = agg.join(F.broadcast(frame.withColumn("_listed", F.lit(1))), ["audit", "bin"], "full")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_total", "n_gain", "n_wrong")}
    return full.drop("_listed").withColumns(zero).withColumn("err_rate", F.when(F.col("n_total") > 0, F.col("n_wrong") / F.col("n_total") * 100))
