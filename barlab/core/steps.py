"""Indicator steps and their fused evaluation.

A ``Step`` knows its outputs, how many rows it looks back and ahead, and how to add its columns to a frame of
halo blocks. ``with_indicators`` evaluates any number of steps behind one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.core.blocks import BASE, DEFAULT_BLOCK, IDX, drop_halo, halo_blocks, ordered, rows
from pyspark.sql import Window

#: Past weight below which a decaying recurrence no longer changes a double.
NEGLIGIBLE = 1e-17
#: Largest natural exponent used when scaling decaying sums inside a block.
EXPONENT_RANGE = 430.0


@dataclass(frozen=True)
class Step:
    name: str
    outputs: tuple[str, ...]
    apply: Callable[[DataFrame], DataFrame]
    back: int = 0
    ahead: int = 0
    span: int = 1 << 30  # most rows per block the step can scale without overflow


def with_indicators(bars: DataFrame, *steps: Step, block_rows: int = DEFAULT_BLOCK) -> DataFrame:
    """Add the outputs of ``steps`` to indexed bars. Steps that tolerate a common block size share one
    shuffle; a short recurrence and a very long look-back get separate passes."""
    passes: list[list[Step]] = []
    for step in steps:
        for group in passes:
            both = [*group, step]
            if max(s.back + s.ahead for s in both) <= min(s.span for s in both):
                group.append(step)
                break
        else:
            passes.append([step])
    for group in passes:
        keep = list(dict.fromkeys([*bars.columns, *[o for s in group for o in s.outputs]]))
        size = min([block_rows, *[s.span for s in group]])
        df = halo_blocks(bars, max(s.back for s in group), max(s.ahead for s in group), size)
        for step in group:
            df = step.apply(df)
        bars = drop_halo(df).select(*keep)
    return bars


def aside(df: DataFrame, step: Step, prefix: str) -> DataFrame:
    """Add the outputs of ``step`` under ``prefix``; columns of the same names stay as they are."""
    held = {o: f"_held_{o}" for o in step.outputs if o in df.columns}
    df = step.apply(df.withColumnsRenamed(held)).withColumnsRenamed({o: f"{prefix}{o}" for o in step.outputs})
    return df.withColumnsRenamed({v: k for k, v in held.items()})


def warm(col: Column, first: int) -> Column:
    """NULL before bar ``first``."""
    return F.when(F.col(IDX) >= first, col)


def memory(keep: float) -> int:
    """Rows after which a recurrence with factor ``keep`` has forgotten its start."""
    return 1 if keep <= 0 else math.ceil(math.log(NEGLIGIBLE) / math.log(keep))


def span(keep: float) -> int:
    return 1 << 30 if keep <= 0 else int(EXPONENT_RANGE / -math.log(keep))


def decaying(df: DataFrame, src: str, out: str, period: int, gain: float, start: int = 0) -> DataFrame:
    """y = (1-gain)*y' + gain*x, seeded at ``start+period-1`` with the mean of the first ``period`` values.

    The recurrence is a growing-frame sum of x scaled by powers of (1-gain), so it stays a JVM window
    aggregate. A block that does not hold the seed starts ``memory`` rows early instead.
    """
    keep = 1.0 - gain
    seed_at = start + period - 1
    x = F.col(src).cast("double")
    if keep <= 0:
        return df.withColumn(out, warm(x, seed_at))
    df = df.withColumn("_seed", F.avg(x).over(rows(-(period - 1), 0)) if period > 1 else x)
    power = (F.col(IDX) - F.col(BASE) - F.col("_size") / 2).cast("double")
    impulse = F.when(F.col(IDX) == seed_at, F.col("_seed")).when(F.col(IDX) > seed_at, x * gain).otherwise(0.0)
    df = df.withColumn("_imp", impulse * F.pow(F.lit(keep), -power))
    growing = ordered().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, warm(F.sum("_imp").over(growing) * F.pow(F.lit(keep), power), seed_at)).drop("_seed", "_imp")


def ema_gain(period: int) -> float:
    return 2.0 / (period + 1)


def ema_reach(period: int) -> int:
    return memory(1 - ema_gain(period)) + period


def wilder_reach(period: int) -> int:
    return memory(1 - 1 / period) + period


def ema_span(*periods: int) -> int:
    return min(span(1 - ema_gain(p)) for p in periods)


def wilder_span(period: int) -> int:
    return span(1 - 1 / period)
