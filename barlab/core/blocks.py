"""Window evaluation that never puts one whole series into one task.

A symbol's series is cut into blocks of consecutive bars. ``index_bars`` numbers the bars without a
per-symbol sort, ``halo_blocks`` copies the few preceding (following) rows a finite frame needs into each
block, and ``running`` evaluates unbounded frames in two levels: inside blocks, then over one summary row per
block. All of them shuffle on ``(symbol, timeframe, block)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ["symbol", "timeframe"]
BLOCK = "_blk"
BASE = "_base"
IDX = "bar_idx"
DEFAULT_BLOCK = 4096


def index_rows(df: DataFrame, key: Sequence[str], slot: Column, order: Sequence, out: str = IDX,
               total: str | None = None) -> DataFrame:
    """Number the rows of each key 0..n-1 in ``order``.

    ``slot`` must be monotone in ``order`` and bound the rows per (key, slot): only those rows share a task.
    Slot counts are prefix-summed on a table with one row per slot.
    """
    key = list(key)
    slotted = df.withColumn("_slot", slot)
    per_slot = slotted.groupBy(*key, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slot.select(*key, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                              *([F.sum("_n").over(Window.partitionBy(*key)).alias(total)] if total else []))
    inside = Window.partitionBy(*key, "_slot").orderBy(*order)
    return (slotted.join(offsets, [*key, "_slot"])
            .withColumn(out, (F.col("_off") + F.row_number().over(inside) - 1).cast("bigint"))
            .drop("_slot", "_off"))


def index_bars(bars: DataFrame, seconds: int, block_rows: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``bar_idx`` (0-based) and ``n_bars`` per series. A slot spans ``block_rows`` bar widths, and a
    series has at most one bar per width, so a slot holds at most ``block_rows`` bars."""
    slot = F.floor(F.unix_timestamp("ts") / F.lit(seconds * block_rows))
    return index_rows(bars, KEY, slot, ["ts"], IDX, "n_bars")


def halo_blocks(df: DataFrame, back: int, ahead: int = 0, block_rows: int = DEFAULT_BLOCK) -> DataFrame:
    """Copy each bar to its own block and to the blocks for which it is one of the ``back`` rows before or
    the ``ahead`` rows after. Adds ``_blk`` and ``_base`` (index of the block's first own bar)."""
    size = max(block_rows, back, ahead, 1)
    first = F.greatest(F.lit(0), F.floor((F.col(IDX) - ahead) / size))
    last = F.floor((F.col(IDX) + back) / size)
    last = F.least(last, F.floor((F.col("n_bars") - 1) / size))
    return (df.withColumn(BLOCK, F.explode(F.sequence(first, last)))
            .withColumn(BASE, F.col(BLOCK) * size).withColumn("_size", F.lit(size)))


def drop_halo(df: DataFrame) -> DataFrame:
    own = (F.col(IDX) >= F.col(BASE)) & (F.col(IDX) < F.col(BASE) + F.col("_size"))
    return df.filter(own).drop(BLOCK, BASE, "_size")


def rows(start: int, end: int) -> WindowSpec:
    """Row frame inside a halo block."""
    return ordered().rowsBetween(start, end)


def ordered() -> WindowSpec:
    return Window.partitionBy(*KEY, BLOCK).orderBy(IDX)


def lag(col: Column | str, n: int = 1) -> Column:
    return F.lag(col, n).over(ordered())


def running(df: DataFrame, key: Sequence[str], block: str, order: Sequence,
            aggs: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Unbounded-preceding aggregates in two levels.

    ``aggs`` maps an output to ``(kind, expr)`` with kind in sum, max, min, last (last non-null).
    ``inclusive=False`` excludes the current row.
    """
    key = list(key)
    local = Window.partitionBy(*key, block).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = Window.partitionBy(*key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    fn = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    exprs = {out: f"_x_{out}" for out in aggs}
    base = df.select("*", *[e.alias(exprs[o]) for o, (_, e) in aggs.items()])

    def summary(out: str, kind: str) -> Column:
        x = F.col(exprs[out])
        if kind == "last":
            return F.max_by(x, F.when(x.isNotNull(), F.struct(*[F.col(c) for c in order])))
        return fn[kind](x)

    per_block = base.groupBy(*key, block).agg(*[summary(o, k).alias(f"_s_{o}") for o, (k, _) in aggs.items()])
    carry = per_block.select(*key, block,
                             *[fn[k](F.col(f"_s_{o}")).over(earlier).alias(f"_c_{o}") for o, (k, _) in aggs.items()])
    out = base.select("*", *[fn[k](F.col(exprs[o])).over(local).alias(f"_l_{o}") for o, (k, _) in aggs.items()])
    out = out.join(carry, [*key, block], "left")
    for o, (k, _) in aggs.items():
        here, before = F.col(f"_l_{o}"), F.col(f"_c_{o}")
        merged = {"sum": F.coalesce(here + before, here, before), "max": F.greatest(here, before),
                  "min": F.least(here, before), "last": F.coalesce(here, before)}[k]
        out = out.withColumn(o, merged)
    return out.drop(*[f"_{t}_{o}" for o in aggs for t in "xlc"])
