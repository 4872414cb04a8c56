"""First bar after an entry that reaches an upper or a lower price.

Bars are packed into arrays of ``CHUNK`` consecutive bars; above them, arrays of chunk extremes form a pyramid.
An entry is matched to one array per level, so no entry/bar pairs are built and long searches cost a few joins.
Entries that have nothing to look up get a negative group of their own, which spreads them over the partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.core.blocks import IDX, KEY

CHUNK = 256


def _pack(level: DataFrame) -> DataFrame:
    """Rows (key, pos, hi, lo) to one array per group of CHUNK positions."""
    return (level.groupBy(*KEY, F.floor(F.col("pos") / CHUNK).alias("grp"))
            .agg(F.sort_array(F.collect_list(F.struct("pos", "hi", "lo"))).alias("arr"), F.max("hi").alias("hi"), F.min("lo").alias("lo")))


def _reaches(bar: Column, upper: str, lower: str, strict: str) -> tuple[Column, Column]:
    """Whether a bar (or the extremes of many) touches the upper and the lower price; ``strict`` names sides to be passed."""
    up = bar["hi"] > F.col(upper) if "upper" in strict else bar["hi"] >= F.col(upper)
    return up, bar["lo"] < F.col(lower) if "lower" in strict else bar["lo"] <= F.col(lower)


def _first(arr: str, after: Column, upper: str, lower: str, strict: str = "") -> Column:
    def touched(b: Column) -> Column:
        up, down = _reaches(b, upper, lower, strict)
        return (b.pos > after) & (up | down)

    hit = F.filter(arr, touched)
    return F.get(hit, F.lit(0))


def first_touch(entries: DataFrame, bars: DataFrame, upper: str, lower: str, horizon: int | None = None,
                depth: int | None = None, strict: str = "") -> DataFrame:
    """Add ``hit_idx``, ``hit_upper``, ``hit_lower`` to entries (symbol, timeframe, bar_idx, upper, lower).

    Reaching a price is touching it; sides named in ``strict`` ("upper", "lower" or both) must be passed.

    With ``horizon`` only the next ``horizon`` bars count. Without it the search runs to the end of the series;
    ``depth`` is the number of pyramid levels, by default enough for the longest series in ``bars``.
    """
    base = bars.select(*KEY, F.col(IDX).alias("pos"), F.col("high").alias("hi"), F.col("low").alias("lo"))
    if horizon is not None:
        return _bounded(entries, base, upper, lower, horizon, strict)
    if depth is None:
        longest = bars.agg(F.max(IDX)).first()[0] or 0
        depth, reach = 1, CHUNK
        while reach <= longest:
            depth, reach = depth + 1, reach * CHUNK
    levels, current = [], base
    for _ in range(depth):
        packed = _pack(current)
        levels.append(packed.select(*KEY, "grp", "arr"))
        current = packed.select(*KEY, F.col("grp").alias("pos"), "hi", "lo")

    out = entries.withColumn("_at", F.col(IDX)).withColumn("_found", F.lit(None).cast("bigint")).withColumn("_lvl", F.lit(-1))
    for n, level in enumerate(levels):  # upwards: look right of the current position inside its own group
        out = _look(out, level, n, F.floor(F.col("_at") / CHUNK), F.col("_at"), upper, lower, F.col("_found").isNull(), strict)
        out = out.withColumn("_at", F.when(F.col("_found").isNull(), F.floor(F.col("_at") / CHUNK)).otherwise(F.col("_at")))
    for n in range(depth - 2, -1, -1):  # downwards: open the first group that holds a touch
        going = F.col("_found").isNotNull() & (F.col("_lvl") == n + 1)
        out = _look(out, levels[n], n, F.col("_found"), F.lit(-1), upper, lower, going, strict)
    last = levels[0].withColumnRenamed("arr", "_arr")
    out = out.withColumn("_grp", F.coalesce(F.floor(F.col("_found") / CHUNK), -1 - F.col(IDX))).join(last.withColumnRenamed("grp", "_grp"), [*KEY, "_grp"], "left")
    bar = F.get(F.filter("_arr", lambda b: b.pos == F.col("_found")), F.lit(0))
    up, down = _reaches(F.col("_bar"), upper, lower, strict)
    return (out.withColumn("_bar", bar).withColumns({
        "hit_idx": F.col("_found"), "hit_upper": F.coalesce(up, F.lit(False)), "hit_lower": F.coalesce(down, F.lit(False))})
        .select(*entries.columns, "hit_idx", "hit_upper", "hit_lower"))


def _look(out: DataFrame, level: DataFrame, n: int, group: Column, after: Column, upper: str, lower: str, when: Column, strict: str = "") -> DataFrame:
    keyed = out.withColumn("_go", when).withColumn("_grp", F.when(F.col("_go"), group).otherwise(-1 - F.col(IDX))).withColumn("_after", after)
    hit = _first("arr", F.col("_after"), upper, lower, strict)
    joined = keyed.join(level.withColumnRenamed("grp", "_grp"), [*KEY, "_grp"], "left").withColumn("_hit", hit)
    found = F.col("_go") & F.col("_hit").isNotNull()
    return (joined.withColumn("_lvl", F.when(found, F.lit(n)).otherwise(F.col("_lvl")))
            .withColumn("_found", F.when(found, F.col("_hit.pos")).otherwise(F.col("_found")))
            .drop("_go", "_grp", "_after", "arr", "_hit"))


def _bounded(entries: DataFrame, base: DataFrame, upper: str, lower: str, horizon: int, strict: str = "") -> DataFrame:
    """Chunks carry ``horizon`` extra bars of look-ahead, so one equi join resolves every entry."""
    size = max(CHUNK, horizon)
    chunks = (base.withColumn("_grp", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("pos") - horizon) / size)), F.floor(F.col("pos") / size))))
              .groupBy(*KEY, "_grp").agg(F.sort_array(F.collect_list(F.struct("pos", "hi", "lo"))).alias("arr")))
    out = entries.withColumn("_grp", F.floor(F.col(IDX) / size)).join(chunks, [*KEY, "_grp"], "left")
    window = F.slice("arr", F.greatest(F.lit(1), (F.col(IDX) - F.col("_grp") * size + 2).cast("int")), horizon)
    out = out.withColumn("arr", window).withColumn("_bar", _first("arr", F.col(IDX), upper, lower, strict))
    up, down = _reaches(F.col("_bar"), upper, lower, strict)
    return (out.withColumns({"hit_idx": F.col("_bar.pos"), "hit_upper": F.coalesce(up, F.lit(False)), "hit_lower": F.coalesce(down, F.lit(False))})
            .select(*entries.columns, "hit_idx", "hit_upper", "hit_lower"))
