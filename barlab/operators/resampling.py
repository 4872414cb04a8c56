"""Permutation, bootstrap and noise tests of a trade list as distributed resampling.

Trades are packed once into arrays of ``BLOCK`` positions. No row of a replicate is ever shuffled:

* noise moves a block's own values, all replicates one after the other;
* a strategy of up to ``BIG`` trades is one array, and a task makes all its replicates;
* a bigger one is dealt in units that read its blocks as a stream, in any order. Up to ``HELD`` trades a unit has ``WIDTH`` replicates
  or more and holds the strategy's values once (and 32 bits a trade for a permutation), so the trades are read ``replicates / WIDTH``
  times at most, however many they are, and a replicate exists in pieces of ``SPAN`` values only;
* beyond that a unit is some replicates and one part: of the drawn positions (bootstrap) or of the random keys that are sorted by
  (permutation). It holds ``UNIT`` numbers at most: for the bootstrap those of its own positions and a window of ``PART`` source
  values at a time, for a permutation the values whose key falls into its part. Each unit reads all trades, so the reading grows
  with their square there.

Units meet blocks in a cross join without a shuffle, each strategy's blocks as one stream. A unit ends as one row per replicate: sum,
highest, lowest value and deepest fall of its part of the equity curve. These merge in order.

Random numbers are 32-bit mixes of (seed, test, strategy, replicate) and position, so results do not depend on partitioning
or retries. A replicate's numbers at its first 2**32 positions are all different, so a permutation has no ties.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.core.blocks import index_rows
from barlab.operators.performance import chain_blocks
from barlab.session import cut

BLOCK = 4096
#: Replicates that noise draws at a time; small enough for a processor's cache.
CHUNK = 16
#: Trades of a strategy from which on units read it as a stream; random numbers that a unit holds, and of those the most of one replicate.
BIG, UNIT, PART = 1 << 15, 1 << 24, 1 << 23
#: Trades of a strategy up to which a unit holds all its values, and the least replicates of such a unit.
HELD, WIDTH = 1 << 26, 25
#: Values of a replicate that are drawn at a time, and lanes' length: sums run along ``STEPS`` values in many lanes at once.
SPAN, STEPS = 1 << 17, 32
#: Trades of the strategies that share a stream.
SHARED = 1 << 22
SPREAD = float(1 << 32)
#: Fixed multipliers of the random numbers.
MIX, REP, POS = 73244475, 2654435761, 40503
_MASK = np.uint64(0xFFFFFFFF)
_UNMIX, _UNPOS = pow(MIX, -1, 1 << 32), pow(POS, -1, 1 << 32)
_SUMMARY = ["total", "high", "low", "fall"]


def mix(x: np.ndarray, by: int = MIX) -> np.ndarray:
    """Scatter 32-bit numbers, in place."""
    t = np.empty_like(x)
    for _ in range(2):
        x ^= np.right_shift(x, np.uint32(16), out=t)
        x *= np.uint32(by)
    x ^= np.right_shift(x, np.uint32(16), out=t)
    return x


def unmix(x: np.ndarray) -> np.ndarray:
    """The numbers that ``mix`` scattered, in place."""
    return mix(x, _UNMIX)


def salt_of(seed: int, test: str) -> int:
    return zlib.crc32(f"{seed}-{test}".encode())


def of_replicates(salt: int, key: int, reps: np.ndarray) -> np.ndarray:
    return mix((np.uint64(salt) + np.uint64(key) + reps.astype(np.uint64) * np.uint64(REP) & _MASK).astype(np.uint32))


def of_positions(positions: np.ndarray) -> np.ndarray:
    if positions.dtype != np.uint32:
        positions = (positions.astype(np.uint64) & _MASK).astype(np.uint32)
    return mix(positions * np.uint32(POS))


def draws(salt: int, key: int, reps: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """32-bit random numbers, replicates x positions."""
    return mix(of_replicates(salt, key, reps)[:, None] ^ of_positions(positions)[None, :])


def summary(curve: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sum, highest, lowest value and deepest inner fall of the running sums of each row."""
    run = np.cumsum(curve, axis=1)
    total, high, low = run[:, -1].copy(), run.max(axis=1), run.min(axis=1)
    return total, high, low, np.subtract(np.maximum.accumulate(run, axis=1), run, out=run).max(axis=1)


def laned(x: np.ndarray) -> np.ndarray:
    """Consecutive numbers as ``curve`` takes them: the first of every ``STEPS``, the second ones and so on, then what is left over."""
    lanes = len(x) // STEPS
    return np.concatenate([x[: lanes * STEPS].reshape(lanes, STEPS).T.ravel(), x[lanes * STEPS :]])


def joined(total: np.ndarray, high: np.ndarray, low: np.ndarray, fall: np.ndarray) -> tuple[float, ...]:
    """The summary of consecutive stretches of one curve."""
    ends = np.cumsum(total)
    before = ends - total
    top, bottom = np.maximum.accumulate(before + high), before + low
    return ends[-1], top[-1], bottom.min(), max(fall.max(), (top[:-1] - bottom[1:]).max(initial=0.0))


def curve(values: np.ndarray) -> tuple[float, ...]:
    """``summary`` of one replicate's values in the order of ``laned``: all lanes advance together."""
    lanes = len(values) // STEPS
    tail = summary(values[None, lanes * STEPS :]) if len(values) > lanes * STEPS else (np.empty(0),) * 4
    if not lanes:
        return tuple(x[0] for x in tail)
    rows = values[: lanes * STEPS].reshape(STEPS, lanes)
    total, high, low, fall, t = rows[0].copy(), rows[0].copy(), rows[0].copy(), np.zeros(lanes), np.empty(lanes)
    for row in rows[1:]:
        total += row
        np.maximum(high, total, out=high)
        np.minimum(low, total, out=low)
        np.maximum(fall, np.subtract(high, total, out=t), out=fall)
    return joined(*(np.concatenate(x) for x in zip((total, high, low, fall), tail)))


def indexed_trades(trades: DataFrame) -> DataFrame:
    """Add position ``pos`` 0..n-1 and count ``n`` per strategy; trades carry strategy_id, trade_no, pnl."""
    return index_rows(trades, ["strategy_id"], F.floor(F.col("trade_no") / BLOCK), ["trade_no"], "pos", "n")


def packed(indexed: DataFrame) -> DataFrame:
    """(strategy_id, key, n, block, pnl): the values of ``BLOCK`` positions as an array."""
    block = F.floor(F.col("pos") / BLOCK).cast("int").alias("block")
    rows = indexed.groupBy("strategy_id", block).agg(F.max("n").cast("bigint").alias("n"), F.sort_array(F.collect_list(F.struct("pos", F.col("pnl").cast("double").alias("pnl")))).alias("rows"))
    key = F.conv(F.substring(F.md5(F.col("strategy_id").cast("string")), 1, 8), 16, 10).cast("bigint")
    return cut(rows.select("strategy_id", key.alias("key"), "n", "block", F.transform("rows", lambda r: r["pnl"]).alias("pnl")))


def _summaries(strategy, block: int, reps: np.ndarray, found: tuple[np.ndarray, ...], kind: pa.DataType) -> pa.RecordBatch:
    n = len(reps)
    return pa.RecordBatch.from_arrays([pa.array([strategy] * n, kind), pa.array(reps.astype(np.int32)), pa.array(np.full(n, block, np.int32)), *(pa.array(x) for x in found)], ["strategy_id", "rep", "block", *_SUMMARY])


def _merged(parts: DataFrame) -> DataFrame:
    """(strategy_id, rep, max_drawdown, final_equity) from the summaries of blocks."""
    return chain_blocks(parts, ["strategy_id", "rep"], "block", *_SUMMARY)


def _schema(df: DataFrame, *more: str) -> str:
    return f"strategy_id {dict(df.dtypes)['strategy_id']}, " + ", ".join(more)


_OUT = ("rep int", "block int", "total double", "high double", "low double", "fall double")


def noise(indexed: DataFrame, replicates: int = 1000, seed: int = 42, pct: float = 0.10) -> DataFrame:
    """Every trade moved by up to ``pct`` of itself."""
    salt, size, width = salt_of(seed, "noise"), BLOCK, CHUNK

    def run(batches):
        for batch in batches:
            kind = batch.column("strategy_id").type
            for strategy, key, block, pnl in zip(*(batch.column(c).to_pylist() for c in ("strategy_id", "key", "block")), batch.column("pnl")):
                value = pnl.values.to_numpy()
                for first in range(0, replicates, width):
                    reps = np.arange(first, min(replicates, first + width))
                    x = draws(salt, key, reps, block * size + np.arange(len(value))) * (2 / SPREAD)
                    x -= 1
                    x *= pct
                    x += 1
                    x *= value
                    yield _summaries(strategy, block, reps, summary(x), kind)

    blocks = packed(indexed)
    return _merged(blocks.repartition("strategy_id", "block").mapInArrow(run, _schema(blocks, *_OUT)))


#: Replicates of one unit from (key, n, reps, part, parts, pieces); ``pieces`` are positions in any order, and their values.
Work = Callable[[int, int, np.ndarray, int, int, Iterator[tuple[np.ndarray, np.ndarray]]], tuple[np.ndarray, ...]]


def _source(n: int, pieces: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    source = np.empty(n)
    for at, value in pieces:
        source[at] = value
    return source


def _picked(source: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return source.take(positions.astype(np.intp), mode="clip")  # all positions are in range: nothing is clipped, and nothing checked


def _chained(found: np.ndarray) -> tuple[np.ndarray, ...]:
    """Summaries of replicates from those of their pieces: replicates x pieces x 4."""
    return tuple(np.array(x) for x in zip(*(joined(*pieces.T) for pieces in found)))


def _stacked(curves: Iterator[np.ndarray]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*(summary(c[None, :]) for c in curves)))


def _resampled(indexed: DataFrame, replicates: int, work: Work) -> DataFrame:
    """Run ``work`` over all units of all strategies."""
    size, big, unit_size, part_size, held, least = BLOCK, BIG, UNIT, PART, HELD, WIDTH
    blocks = packed(indexed)
    out_schema = _schema(blocks, *_OUT)

    def whole(batches):
        for batch in batches:
            kind = batch.column("strategy_id").type
            for strategy, key, n, pnl in zip(*(batch.column(c).to_pylist() for c in ("strategy_id", "key", "n")), batch.column("pnl")):
                reps = np.arange(replicates)
                yield _summaries(strategy, 0, reps, work(key, n, reps, 0, 1, iter([(np.arange(n), pnl.values.to_numpy())])), kind)

    small = blocks.where(F.col("n") <= big).groupBy("strategy_id", "key", "n").agg(F.sort_array(F.collect_list(F.struct("block", "pnl"))).alias("rows"))
    out = small.select("strategy_id", "key", "n", F.flatten(F.transform("rows", lambda r: r["pnl"])).alias("pnl")).mapInArrow(whole, out_schema)

    def streamed(group: list, parts: int, width: int):
        chunks = -(-replicates // width)

        def run(batches):
            head = next(batches, None)
            if head is None:
                return
            at, unit = divmod(head.column("unit")[0].as_py(), chunks * parts)
            chunk, part = divmod(unit, parts)
            strategy, key, n = group[at]

            def pieces():
                for batch in chain([head], batches):
                    own = batch.filter(pc.equal(batch.column("strategy_id"), strategy))
                    if own.num_rows:
                        lengths = pc.list_value_length(own.column("pnl")).to_numpy()
                        start = own.column("block").to_numpy().astype(np.int64) * size
                        ends = np.cumsum(lengths)
                        yield np.repeat(start - (ends - lengths), lengths) + np.arange(ends[-1]), own.column("pnl").flatten().to_numpy()

            reps = np.arange(chunk * width, min(replicates, (chunk + 1) * width))
            yield _summaries(strategy, part, reps, work(key, n, reps, part, parts, pieces()), head.column("strategy_id").type)

        units = blocks.sparkSession.range(0, len(group) * chunks * parts, 1, len(group) * chunks * parts).withColumnRenamed("id", "unit")
        values = blocks.where(F.col("strategy_id").isin([g[0] for g in group])).select("strategy_id", "block", "pnl").coalesce(1)
        return values.hint("shuffle_replicate_nl").crossJoin(units).mapInArrow(run, out_schema)

    many = blocks.where(F.col("n") > big).groupBy("strategy_id", "key", "n").count().orderBy("n", "strategy_id").collect()  # one row per ``BIG`` trades at most
    group: list = []
    for i, row in enumerate(many):
        group.append((row["strategy_id"], row["key"], row["n"]))
        if i + 1 == len(many) or sum(g[2] for g in group) + many[i + 1]["n"] > SHARED:
            n = group[-1][2]
            parts = 1 if n <= held else -(-n // part_size)
            out = out.unionByName(streamed(group, parts, max(1 if n > held else least, unit_size // -(-n // parts))))
            group = []
    return _merged(out)


def bootstrap(indexed: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Replicates drawn with replacement."""
    salt, size, window = salt_of(seed, "boot"), BLOCK, PART

    def held(key, n, reps, source):
        found = np.empty((len(reps), -(-n // SPAN), 4))
        for i, first in enumerate(range(0, n, SPAN)):
            b = laned(of_positions(np.arange(first, min(n, first + SPAN), dtype=np.uint32)))
            for r, a in enumerate(of_replicates(salt, key, reps)):
                h = mix(b ^ a)
                h -= h // np.uint32(n) * np.uint32(n)
                found[r, i] = curve(_picked(source, h))
        return _chained(found)

    def work(key, n, reps, part, parts, pieces):
        if parts == 1:
            return held(key, n, reps, _source(n, pieces))
        span = -(-n // parts)
        b, count = of_positions(np.arange(part * span, min(n, (part + 1) * span))), -(-n // size)
        pick = np.empty((len(reps), len(b)), np.uint32 if n < 1 << 32 else np.uint64)
        for row, a in zip(pick, of_replicates(salt, key, reps)):
            np.remainder(mix(b ^ a), pick.dtype.type(n), out=row)
        value = np.empty(pick.shape)
        near: list[tuple[np.ndarray, np.ndarray]] = []

        def look_up():
            at, known = (np.concatenate(x) for x in zip(*near))
            slot = np.full(count, -1, np.int64)
            first = np.flatnonzero(at % size == 0)
            slot[at[first] // size] = first
            for row, to in zip(pick, value):
                found = slot[row // size]
                mine = np.flatnonzero(found >= 0)
                to[mine] = known[found[mine] + row[mine] % size]
            near.clear()

        for piece in pieces:
            near.append(piece)
            if sum(len(at) for at, _ in near) >= window:
                look_up()
        if near:
            look_up()
        return _stacked(iter(value))

    return _resampled(indexed, replicates, work)


def permutation(indexed: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Replicates in random order: profit is unchanged, drawdown is not."""
    salt = salt_of(seed, "perm")

    def held(key, n, reps, source):
        found, h = np.empty((len(reps), -(-n // SPAN), 4)), np.empty(n, np.uint32)
        for r, a in enumerate(of_replicates(salt, key, reps)):
            for first in range(0, n, SPAN):
                h[first : first + SPAN] = mix(of_positions(np.arange(first, min(n, first + SPAN), dtype=np.uint32)) ^ a)
            h.sort()
            for i, first in enumerate(range(0, n, SPAN)):
                at = unmix(unmix(laned(h[first : first + SPAN])) ^ a)  # no two positions share a number, so it tells the position
                at *= np.uint32(_UNPOS)
                found[r, i] = curve(_picked(source, at))
        return _chained(found)

    def work(key, n, reps, part, parts, pieces):
        if parts == 1:
            return held(key, n, reps, _source(n, pieces))
        a = of_replicates(salt, key, reps)
        lo, hi = -(-part * 2**32 // parts), -(-(part + 1) * 2**32 // parts) - 1
        own: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in reps]
        for at, value in pieces:
            b = of_positions(at)
            for r, found in enumerate(own):
                h = mix(b ^ a[r])
                mine = np.flatnonzero((h >= np.uint32(lo)) & (h <= np.uint32(hi)))
                found.append((h[mine], value[mine]))

        def curves():
            for r in range(len(reps)):
                h, value = (np.concatenate(x) for x in zip(*own[r]))
                own[r] = []
                order = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
                order.sort()
                yield value[(order & _MASK).astype(np.int64)] if len(h) else np.zeros(1)

        return _stacked(curves())

    return _resampled(indexed, replicates, work)


def significance(replicates: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Order-statistic percentiles, loss probability and significance per strategy. The replicates of one
    strategy are bounded by their chosen number."""
    n = F.count(F.lit(1)).over(Window.partitionBy("strategy_id"))
    by_profit = F.row_number().over(Window.partitionBy("strategy_id").orderBy("final_equity", "rep"))
    by_fall = F.row_number().over(Window.partitionBy("strategy_id").orderBy("max_drawdown", "rep"))
    df = replicates.withColumns({"_n": n, "_p": by_profit, "_d": by_fall})
    at = lambda rank, q, value: F.max(F.when(F.col(rank) == F.floor(F.col("_n") * q) + 1, F.col(value)))
    out = df.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("replicates"), at("_p", 0.05, "final_equity").alias("p5"), at("_p", 0.50, "final_equity").alias("p50"),
        at("_p", 0.95, "final_equity").alias("p95"), F.avg((F.col("final_equity") < 0).cast("double")).alias("loss_probability"),
        at("_d", 0.95, "max_drawdown").alias("worst_drawdown_95"))
    out = out.withColumn("confidence", 1 - F.col("loss_probability"))
    return out.withColumn("significant", ((F.col("confidence") >= confidence) & (F.col("p5") > 0)).cast("int"))


def full_analysis(trades: DataFrame, replicates: int = 1000, seed: int = 42, pct: float = 0.10) -> DataFrame:
    """All three tests side by side."""
    idx = indexed_trades(trades)
    tests = {"permutation": permutation(idx, replicates, seed), "bootstrap": bootstrap(idx, replicates, seed), "noise": noise(idx, replicates, seed, pct)}
    parts = [significance(r).withColumn("test", F.lit(name)) for name, r in tests.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
