"""Conditional volatility by a likelihood grid, and swing distances from separated peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.core.blocks import IDX, KEY, lag, rows
from barlab.core.steps import Step, decaying, memory, span, with_indicators
from barlab.operators.touch import first_touch
from barlab.session import cut

#: GARCH(1,1) grid (fixed values): weight of the last squared return and of the last variance.
ALPHAS = (0.02, 0.05, 0.08, 0.12, 0.18)
BETAS = (0.75, 0.80, 0.85, 0.90, 0.95)
MIN_RETURNS = 252


def garch(bars: DataFrame, alphas=ALPHAS, betas=BETAS, minimum: int = MIN_RETURNS) -> DataFrame:
    """Conditional volatility of log returns at the most likely grid cell per series.

    For fixed weights the variance is a linear recurrence, so every cell is one window sum and all cells share one
    pass; the constant follows from the long-run variance. Series with fewer than ``minimum`` returns get NULL.
    """
    df = with_indicators(bars, Step("ret", ("_r",), lambda d: d.withColumn("_r", F.log(F.col("close") / lag("close"))), back=1))
    stats = df.groupBy(*KEY).agg(F.avg("_r").alias("_mu"), F.var_pop("_r").alias("_var"), F.count("_r").alias("_n"))
    df = df.join(stats, KEY).withColumn("_e", F.col("_r") - F.col("_mu"))
    cells = [(a, b) for a in alphas for b in betas if a + b < 0.999]
    names = [f"_s{n}" for n in range(len(cells))]

    def apply(d: DataFrame) -> DataFrame:
        for name, (a, b) in zip(names, cells):
            shock = (F.col("_var") * (1 - a - b) + a * F.pow(lag("_e"), 2)) / (1 - b)
            d = d.withColumn("_x", F.when(F.col(IDX) == 1, F.col("_var")).otherwise(shock))
            d = decaying(d, "_x", name, 1, 1 - b, start=1)
        return d.drop("_x")

    reach = max(memory(b) for _, b in cells) + 2
    df = with_indicators(df, Step("garch", tuple(names), apply, back=reach, span=min(span(b) for _, b in cells)))
    fit = lambda s: F.sum(-0.5 * (F.log(F.col(s)) + F.pow("_e", 2) / F.col(s)))
    best = df.groupBy(*KEY).agg(F.array(*[fit(s) for s in names]).alias("_ll"))
    best = best.select(*KEY, (F.array_position("_ll", F.array_max("_ll")) - 1).cast("int").alias("_cell"))
    df = df.join(best, KEY)
    value = F.sqrt(F.get(F.array(*[F.col(s) for s in names]), F.col("_cell")))
    table = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a, b in cells])
    df = df.withColumns({"garch_volatility": F.when(F.col("_n") >= minimum, value), "_w": F.get(table, F.col("_cell"))})
    return df.withColumns({"garch_alpha": F.col("_w.alpha"), "garch_beta": F.col("_w.beta")}).drop("_r", "_mu", "_var", "_n", "_e", "_cell", "_w", *names)


def local_maxima(bars: DataFrame, col: str) -> DataFrame:
    """(key, bar_idx, _open) of bars higher than what is before and behind them. A flat top is one peak at its middle (the
    earlier of two); one that reaches an end of the series is none."""
    def apply(d: DataFrame) -> DataFrame:
        after = F.lead(col).over(Window.partitionBy(*KEY, "_blk").orderBy(IDX))
        return d.withColumns({"_rise": F.col(col) > lag(col), "_fall": after < F.col(col), "_flat": after == F.col(col)})

    df = with_indicators(bars.select(*KEY, IDX, "n_bars", col), Step("maxima", ("_rise", "_fall", "_flat"), apply, back=1, ahead=1)).where("_rise")
    sharp = df.where("_fall").select(*KEY, IDX, F.col(col).alias("_open"))
    tops = df.where("_flat").select(*KEY, IDX, F.col(col).alias("_open"), F.col(col).alias("_same"))
    ends = first_touch(tops, _one_line(bars, col), "_open", "_same", strict="upper lower").where("hit_lower")
    return sharp.unionByName(ends.select(*KEY, F.floor((F.col(IDX) + F.col("hit_idx") - 1) / 2).alias(IDX), "_open"))


def _one_line(bars: DataFrame, col: str, backwards: bool = False) -> DataFrame:
    """The column as bars whose high and low are one value, numbered from the end if ``backwards``."""
    at = F.col("n_bars") - 1 - F.col(IDX) if backwards else F.col(IDX)
    return bars.select(*KEY, at.alias(IDX), F.col(col).alias("high"), F.col(col).alias("low"))


def prominent(peaks: DataFrame, bars: DataFrame, col: str, prominence: float) -> DataFrame:
    """The peaks (key, bar_idx, _open) that stand out by at least ``prominence``.

    A peak's prominence is its height over the higher of two valleys, each being the lowest value between the peak and the
    nearest higher bar on its side, or the series' end. It is enough if, on both sides, a value as low as height less
    prominence comes before a higher one: a first-touch search in either direction.
    """
    sizes = bars.select(*KEY, "n_bars").distinct()
    out = peaks.join(sizes, KEY).withColumn("_floor", F.col("_open") - prominence)
    for backwards in (False, True):
        turned = out.withColumn(IDX, F.col("n_bars") - 1 - F.col(IDX)) if backwards else out
        hit = first_touch(turned, _one_line(bars, col, backwards), "_open", "_floor", strict="upper").where("hit_lower").select(*turned.columns)
        out = cut(hit.withColumn(IDX, F.col("n_bars") - 1 - F.col(IDX)) if backwards else hit)
    return out.select(*KEY, IDX)


def separated_peaks(bars: DataFrame, col: str, distance: int = 5, prominence: float = 0.001, rounds: int = 3) -> DataFrame:
    """(key, bar_idx) of peaks at least ``distance`` bars apart (higher peaks win, equal ones the later) that stand out by
    ``prominence``.

    Each round keeps candidates without a higher open neighbour and drops neighbours of kept ones. Rounds are plain
    windows over ``distance`` bars; they repeat, ``rounds`` per job, until nothing is open.
    """
    df = bars.select(*KEY, IDX, "n_bars", col).join(local_maxima(bars, col), [*KEY, IDX], "left").withColumn("_kept", F.lit(0))
    near = distance - 1

    def settle(d: DataFrame) -> DataFrame:
        before, after = rows(-near, -1), rows(1, near)
        for _ in range(rounds):
            # ties: an equal earlier peak does not stop a later one, an equal later one stops an earlier one
            free = (F.coalesce(F.max("_open").over(before), F.lit(float("-inf"))) <= F.col("_open")) & (F.coalesce(F.max("_open").over(after), F.lit(float("-inf"))) < F.col("_open"))
            d = d.withColumn("_kept", F.when((F.col("_kept") == 1) | F.coalesce(free, F.lit(False)), 1).otherwise(0))
            close_to_kept = F.greatest(F.max("_kept").over(before), F.max("_kept").over(after)) == 1
            d = d.withColumn("_open", F.when((F.col("_kept") == 0) & ~F.coalesce(close_to_kept, F.lit(False)), F.col("_open")))
        return d

    step = Step("settle", ("_open", "_kept"), settle, back=2 * near * rounds, ahead=2 * near * rounds)
    while True:
        df = cut(with_indicators(df, step))
        if df.filter(F.col("_open").isNotNull()).isEmpty():
            return prominent(df.where("_kept = 1").select(*KEY, IDX, F.col(col).alias("_open")), bars, col, prominence)


def swing_distances(bars: DataFrame, distance: int = 5, prominence: float = 0.001, back_fill: bool = False) -> DataFrame:
    """Distance of the close to the last swing high and low and the width between them, in ATR. Needs ``atr``.

    Bars before the first swing are NULL; ``back_fill`` gives them the first one, which looks ahead.
    """
    from barlab.core.blocks import DEFAULT_BLOCK, running

    low = bars.withColumn("_neg", -F.col("low"))
    highs = separated_peaks(bars, "high", distance, prominence).withColumn("_hi", F.lit(1))
    lows = separated_peaks(low, "_neg", distance, prominence).withColumn("_lo", F.lit(1))
    df = bars.join(highs, [*KEY, IDX], "left").join(lows, [*KEY, IDX], "left").withColumn("_cb", F.floor(F.col(IDX) / DEFAULT_BLOCK))
    df = running(df, KEY, "_cb", [IDX], {"_sh": ("last", F.when(F.col("_hi") == 1, F.col("high"))), "_sl": ("last", F.when(F.col("_lo") == 1, F.col("low")))})
    if back_fill:
        first = df.groupBy(*KEY).agg(F.min_by("_sh", F.when(F.col("_sh").isNotNull(), F.col(IDX))).alias("_fh"), F.min_by("_sl", F.when(F.col("_sl").isNotNull(), F.col(IDX))).alias("_fl"))
        df = df.join(first, KEY).withColumns({"_sh": F.coalesce("_sh", "_fh"), "_sl": F.coalesce("_sl", "_fl")}).drop("_fh", "_fl")
    a = F.col("atr")
    return df.withColumns({"distance_from_swing_high": (F.col("close") - F.col("_sh")) / a, "distance_from_swing_low": (F.col("close") - F.col("_sl")) / a,
                           "swing_range_width": (F.col("_sh") - F.col("_sl")) / a}).drop("_hi", "_lo", "_cb", "_sh", "_sl")
