"""Model preparation: scaling, sequences, labels, splits, ensembles, feature-group selection and stacking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.core.blocks import IDX, KEY, lag, ordered, rows
from barlab.core.steps import Step, with_indicators
from barlab.session import cut

SEQUENCE_LENGTH = 180


def exact_quantiles(values: DataFrame, group: Sequence[str], at: Sequence[float], value: str = "value", bins: int = 4096, small: int = 100_000) -> DataFrame:
    """(group, q, quantile): exact quantiles, interpolated between neighbours, by refinement of histograms.

    Each asked rank has a range of values in which it lies. A round cuts the range into bins, counts them (partly before the
    shuffle) and goes on with the bin that holds the rank, narrowed to the least and greatest value found in it, until that is
    one value or holds at most ``small`` rows, which are then numbered. So no task sees more than bins or ``small`` rows of a
    group, however many distinct values it has. Nulls, NaN and infinities are left out; a group without values gives no row.
    """
    group = list(group)
    v = values.select(*group, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v) AND abs(_v) < double('inf')")
    ends = v.groupBy(*group).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    position = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    asked = cut(ends.select("*", F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), position(q).alias("position")) for q in at])).alias("a")).select(*group, "n", "lo", "hi", "a.q", "a.position"))
    ranks = F.explode(F.array_distinct(F.array(F.floor("position"), F.ceil("position"))))
    state = cut(asked.select(*group, "lo", "hi", F.col("n").alias("inside"), ranks.alias("k")).distinct().withColumn("skip", F.lit(0).cast("bigint")))
    names = ["_lo", "_hi", "_inside", "_k", "_skip"]

    def met(open_: DataFrame) -> DataFrame:
        side = open_.select(*[F.col(c).alias(f"_g_{c}") for c in group], *[F.col(n[1:]).alias(n) for n in names])
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group], F.col("_v").between(F.col("_lo"), F.col("_hi")))
        return v.join(side, same).drop(*[f"_g_{c}" for c in group])

    while True:
        wide = F.col("lo") < F.col("hi")
        busy = state.where(wide & (F.col("inside") > small))
        if busy.isEmpty():
            break
        place = F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins).cast("int"))
        per = met(busy).groupBy(*group, "_k", "_skip", place.alias("bin")).agg(F.count("*").alias("inside"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = F.coalesce(F.sum("inside").over(Window.partitionBy(*group, "_k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # bins
        per = per.withColumn("skip", F.col("_skip") + before).where((F.col("skip") <= F.col("_k")) & (F.col("_k") < F.col("skip") + F.col("inside")))
        state = cut(state.where(~(wide & (F.col("inside") > small))).unionByName(per.select(*group, "lo", "hi", "inside", F.col("_k").alias("k"), "skip")))
    number = F.row_number().over(Window.partitionBy(*group, "_k").orderBy("_v")) - 1 + F.col("_skip")
    open_ = met(state.where("lo < hi")).withColumn("at", number).where("at = _k").select(*group, F.col("_k").alias("k"), F.col("_v").alias("found"))
    found = cut(state.where("lo = hi").select(*group, "k", F.col("lo").alias("found")).unionByName(open_))

    def at_rank(df: DataFrame, rank: Column, name: str) -> DataFrame:
        side = found.select(*[F.col(c).alias(f"_g_{c}") for c in group], "k", F.col("found").alias(name))
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group], rank == F.col("k"))
        return df.join(side, same).drop("k", *[f"_g_{c}" for c in group])

    both = at_rank(at_rank(asked, F.floor("position"), "low"), F.ceil("position"), "high")
    return both.select(*group, "q", (F.col("low") + (F.col("position") - F.floor("position")) * (F.col("high") - F.col("low"))).alias("quantile"))


def scaler_statistics(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Median and interquartile range per feature (long form: feature, median, iqr), exact or by a bounded-memory sketch."""
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    long = df.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.feature", "c.value")
    if exact:
        quartiles = exact_quantiles(long, [*by, "feature"], (0.25, 0.5, 0.75))
        of = lambda q: F.max(F.when(F.col("q") == q, F.col("quantile")))
        agg = quartiles.groupBy(*by, "feature").agg(of(0.5).alias("median"), (of(0.75) - of(0.25)).alias("iqr"))
    else:
        fn = lambda q: F.percentile_approx("value", q, F.lit(100000))
        agg = long.groupBy(*by, "feature").agg(fn(0.5).alias("median"), (fn(0.75) - fn(0.25)).alias("iqr"))
    return agg.withColumn("iqr", F.when(F.col("iqr") == 0, 1.0).otherwise(F.col("iqr")))


def robust_scale(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """(x - median) / IQR; the statistics are one row per group and are joined, not collected."""
    stats = scaler_statistics(df, features, by, exact)
    pick = lambda c, f: F.max(F.when(F.col("feature") == f, F.col(c)))
    wide = stats.groupBy(*by).agg(*[pick(c, f).alias(f"_{c}_{f}") for f in features for c in ("median", "iqr")])
    if by:
        joined = df.join(wide, list(by))
    else:  # a single row of statistics
        joined = df.withColumn("_k", F.lit(0)).join(F.broadcast(wide.withColumn("_k", F.lit(0))), "_k")
    out = joined.withColumns({f: (F.col(f) - F.col(f"_median_{f}")) / F.col(f"_iqr_{f}") for f in features})
    return out.select(*df.columns)


def sequences(bars: DataFrame, features: Sequence[str], length: int = SEQUENCE_LENGTH, horizon: int = 1, price: str = "close") -> DataFrame:
    """For bar i the ``length`` rows before it and whether the price rises over the next ``horizon`` bars."""
    def apply(df: DataFrame) -> DataFrame:
        frame = F.collect_list(F.struct(*[F.col(f).cast("double").alias(f) for f in features])).over(rows(-length, -1))
        later = F.lead(price, horizon).over(ordered())
        return df.withColumns({"sequence": frame, "label": F.when(later.isNotNull(), (later > F.col(price)).cast("int"))})

    df = with_indicators(bars, Step("sequences", ("sequence", "label"), apply, back=length, ahead=horizon))
    return df.filter((F.col(IDX) >= length) & F.col("label").isNotNull())


def horizon_labels(bars: DataFrame, horizons: dict[str, int]) -> DataFrame:
    def apply(df: DataFrame) -> DataFrame:
        return df.withColumns({f"label_{n.lower()}": (F.lead("close", h).over(ordered()) > F.col("close")).cast("int") for n, h in horizons.items()})

    return with_indicators(bars, Step("labels", tuple(f"label_{n.lower()}" for n in horizons), apply, ahead=max(horizons.values())))


def temporal_split(bars: DataFrame, share: float = 0.85) -> DataFrame:
    """First ``share`` of each series is train, the rest validation; from the bar index, without a sort."""
    return bars.withColumn("part", F.when(F.col(IDX) < F.floor(F.col("n_bars") * share), "train").otherwise("validation"))


def ensemble_weights(predictions: DataFrame, model: str = "model_id") -> DataFrame:
    """Model weight = mean of its larger class probability, normalised over the models."""
    w = predictions.groupBy(model).agg(F.avg(F.greatest("p_buy", "p_sell")).alias("_w"))
    return w.withColumn("weight", F.col("_w") / F.sum("_w").over(Window.partitionBy(F.lit(1)))).drop("_w")  # one row per model


def combine_ensemble(predictions: DataFrame, key: Sequence[str], model: str = "model_id") -> DataFrame:
    weighted = predictions.join(ensemble_weights(predictions, model), model)
    return weighted.groupBy(*key).agg(F.sum(F.col("p_buy") * F.col("weight")).alias("p_buy"), F.sum(F.col("p_sell") * F.col("weight")).alias("p_sell"))


def stack_predictions(predictions: DataFrame, key: Sequence[str], models: Sequence[int], model: str = "model_id") -> DataFrame:
    """One column per model and class; the model list is given, so no extra pass finds the pivot values."""
    cells = [F.max(F.when(F.col(model) == m, F.col(c))).alias(f"{c}_{m}") for m in models for c in ("p_sell", "p_buy")]
    return predictions.groupBy(*key).agg(*cells)


# ---------------------------------------------------------------- MLlib


def _classifier(features: Sequence[str], label: str, iterations: int):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep"),
                            LogisticRegression(featuresCol="_x", labelCol=label, maxIter=iterations, regParam=0.01)])


def validation_accuracy(df: DataFrame, features: Sequence[str], label: str = "label", iterations: int = 10) -> float:
    """Accuracy of a logistic model on the validation part (``part`` column from ``temporal_split``)."""
    clean = df.filter(F.col(label).isNotNull()).fillna(0.0, list(features))
    model = _classifier(features, label, iterations).fit(clean.filter("part = 'train'"))
    scored = model.transform(clean.filter("part = 'validation'"))
    return scored.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0] or 0.0


def select_groups(df: DataFrame, groups: dict[str, Sequence[str]], base: Sequence[str], top_n: int = 5, label: str = "label", done: list[dict] | None = None) -> list[dict]:
    """Greedy forward selection of feature groups: rank every group once, then try the best ``top_n`` per step
    and stop without a gain. ``done`` holds the steps of an interrupted run; it is continued."""
    history = list(done or [])
    chosen = list(history[-1]["groups"]) if history else []
    best = history[-1]["accuracy"] if history else 0.0
    cols = lambda gs: [*base, *[f for g in gs for f in groups[g]]]
    ranked = list(groups)
    while len(chosen) < len(groups):
        rest = [g for g in ranked if g not in chosen]
        tried = rest if not chosen else rest[:top_n]
        scores = sorted(((validation_accuracy(df, cols([*chosen, g]), label), g) for g in tried), key=lambda s: (-s[0], s[1]))
        if not chosen:
            ranked = [g for _, g in scores]
        if not scores or scores[0][0] <= best:
            break
        best, chosen = scores[0][0], [*chosen, scores[0][1]]
        history.append({"groups": list(chosen), "accuracy": best})
    return history


def fit_stack(stacked: DataFrame, features: Sequence[str], label: str = "label", iterations: int = 20):
    """Meta learner over base predictions."""
    return _classifier(features, label, iterations).fit(stacked.filter(F.col(label).isNotNull()).fillna(0.5, list(features)))
