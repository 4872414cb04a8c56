"""Parameter search: every round evaluates all its candidates in one Spark job."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.operators.backtest import STARTING_CAPITAL, SymbolInfo, backtest
from barlab.operators.catalog import FAMILIES, crossover, generate, mutate
from barlab.operators.votes import Strategy, vote_signals
from barlab.session import cut, ensure_checkpoint_dir

#: An evaluator turns candidates into result rows (strategy_id, symbol, timeframe, trades, score, ...).
Evaluator = Callable[[list[Strategy]], DataFrame]


def risk_table(spark: SparkSession, strategies: list[Strategy]) -> DataFrame:
    return spark.createDataFrame([(s.id, s.stop_loss, s.take_profit, float(s.risk_per_trade)) for s in strategies],
                                 "strategy_id string, stop_loss int, take_profit int, risk_per_trade double")


def strategy_table(spark: SparkSession, strategies: list[Strategy]) -> DataFrame:
    """Strategies as rows with nested indicator parameters."""
    rows = [(s.id, s.timeframe, s.family, s.variant, [(k, {n: float(v) for n, v in p}) for k, p in s.indicators], s.stop_loss, s.take_profit, float(s.risk_reward), float(s.risk_per_trade)) for s in strategies]
    return spark.createDataFrame(rows, "strategy_id string, timeframe string, family string, variant string, indicators array<struct<type:string,params:map<string,double>>>, "
                                       "stop_loss int, take_profit int, risk_reward double, risk_per_trade double")


def evaluator(bars: dict[str, DataFrame], info: SymbolInfo, capital: float = STARTING_CAPITAL, width: int = 12, at_once: int = 3) -> Evaluator:
    """Backtest evaluator over indexed bars per timeframe.

    Votes are computed for ``width`` strategies a pass, which keeps a pass within what the compiler can fuse however many
    strategies there are, with ``at_once`` passes running side by side; their signals are sparse rows and are written. All
    strategies then go through one backtest as rows.
    """

    def signals_of(job: tuple[str, list[Strategy]]) -> DataFrame:
        tf, part = job
        return cut(vote_signals(bars[tf], part, tf))

    def run(strategies: list[Strategy]) -> DataFrame:
        jobs = []
        for tf in bars:
            mine = [s for s in strategies if s.timeframe == tf]
            jobs += [(tf, mine[i : i + width]) for i in range(0, len(mine), width)]
        if not jobs:
            raise ValueError("no strategy of a timeframe that has bars")
        for frame in bars.values():
            ensure_checkpoint_dir(frame.sparkSession)
        with ThreadPoolExecutor(at_once) as pool:
            signals = list(pool.map(signals_of, jobs))
        out = None
        for tf, frame in bars.items():
            mine = [s for s in strategies if s.timeframe == tf]
            if not mine:
                continue
            every = reduce(DataFrame.unionByName, [s for (t, _), s in zip(jobs, signals) if t == tf])
            part = backtest(every, frame, risk_table(frame.sparkSession, mine), info, capital)
            out = part if out is None else out.unionByName(part)
        return out

    return run


def planned(timeframes: list[str], variants: int = 3, limit: int | None = None, families: list[str] | None = None, seed: int = 42) -> list[Strategy]:
    """Family x timeframe x variant grid, in that order, up to the budget if one is given."""
    grid = [(f, tf, n) for f in (families or FAMILIES) for tf in timeframes for n in range(variants)]
    return [generate(f, tf, n, seed) for f, tf, n in grid[:limit]]


def viable(results: DataFrame, min_trades: int = 10) -> DataFrame:
    return results.filter((F.col("trades") >= min_trades) & F.col("score").isNotNull())


def top_k(results: DataFrame, k: int = 10, by: list[str] | None = None) -> DataFrame:
    """Best ``k`` rows by score (ties by id) with their rank; a global top-k uses a sort with limit."""
    order = [F.col("score").desc(), F.col("strategy_id"), F.col("symbol")]
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        return results.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return results.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _pool_scores(results: DataFrame) -> DataFrame:
    return results.groupBy("strategy_id").agg(F.avg("score").alias("score"), F.first("symbol").alias("symbol"))


def exhaustive(evaluate: Evaluator, strategies: list[Strategy], keep: int = 10, mutations: int = 5, min_trades: int = 10, seed: int = 42) -> DataFrame:
    """Explore all planned strategies, mutate the best ones, and rank everything together."""
    first = cut(viable(evaluate(strategies), min_trades))
    by_id = {s.id: s for s in strategies}
    best = [r["strategy_id"] for r in top_k(first, keep).select("strategy_id").collect()]  # at most ``keep`` rows
    children = [mutate(by_id[i], n, seed=seed) for i in dict.fromkeys(best) for n in range(mutations)]
    if not children:
        return top_k(first, keep)
    second = cut(viable(evaluate(children), min_trades))
    return top_k(first.unionByName(second), keep)


def generational(evaluate: Evaluator, population: list[Strategy], generations: int = 3, min_trades: int = 1, seed: int = 42) -> DataFrame:
    """Survivors (better half, at least two) breed mutated and crossed children; returns all evaluated rows."""
    size, by_id, everything = len(population), {}, None
    for g in range(generations):
        by_id.update({s.id: s for s in population})
        rows = cut(viable(evaluate(population), min_trades).withColumn("generation", F.lit(g)))  # checkpointed: rounds do not nest
        everything = rows if everything is None else everything.unionByName(rows)
        ranked = [r["strategy_id"] for r in _pool_scores(everything).orderBy(F.col("score").desc(), "strategy_id").limit(max(2, size // 2)).collect()]
        if len(ranked) < 2:
            break
        parents = [by_id[i] for i in ranked]
        children = []
        for n in range(size - len(parents)):
            a, b = parents[n % len(parents)], parents[(n + 1) % len(parents)]
            children.append(crossover(a, b, g * size + n, seed) if n % 2 else mutate(a, g * size + n, seed=seed))
        population = children
        if not population:
            break
    return everything


def improve(evaluate: Evaluator, start: Strategy, steps: int = 5, width: int = 4, seed: int = 42) -> DataFrame:
    """Hill climb: ``width`` mutations per step in one job; the best one so far is kept. Returns the history."""
    best, history = start, None
    top = evaluate([start]).agg(F.avg("score")).first()[0] or 0.0
    for step in range(steps):
        children = [mutate(best, step * width + n, seed=seed) for n in range(width)]
        rows = cut(evaluate(children).withColumn("step", F.lit(step)))
        history = rows if history is None else history.unionByName(rows)
        lead = _pool_scores(rows).orderBy(F.col("score").desc(), "strategy_id").limit(1).collect()
        if lead and lead[0]["score"] > top:
            top, best = lead[0]["score"], {s.id: s for s in children}[lead[0]["strategy_id"]]
    return history


def optimise_candidates(evaluate: Evaluator, candidates: list[Strategy], steps: int, give_up_after: int = 10, give_up_below: float = 20.0,
                        validate_above: float = 15.0, seed: int = 42) -> DataFrame:
    """All candidates climb in parallel, one job per step; weak ones drop out after ``give_up_after`` steps.
    Returns the best row per candidate that is worth validating, best first."""
    alive, best = {s.id: s for s in candidates}, {s.id: (0.0, s) for s in candidates}
    for step in range(steps):
        trial = {root: (s if step == 0 else mutate(best[root][1], step, seed=seed)) for root, s in alive.items()}
        rows = {r["strategy_id"]: r["score"] for r in _pool_scores(cut(evaluate(list(trial.values())))).collect()}  # one row per candidate
        for root, s in trial.items():
            score = rows.get(s.id)
            if score is not None and score > best[root][0]:
                best[root] = (score, s)
        if step + 1 >= give_up_after:
            alive = {r: s for r, s in alive.items() if best[r][0] >= give_up_below}
        if not alive:
            break
    spark = SparkSession.getActiveSession()
    rows = [(root, s.id, float(score)) for root, (score, s) in best.items() if score > validate_above]
    return spark.createDataFrame(rows, "candidate string, strategy_id string, score double").orderBy(F.col("score").desc(), "candidate")


def group_stats(results: DataFrame) -> DataFrame:
    """Count, best and mean score per family and per timeframe in one pass."""
    agg = results.groupingSets([["family"], ["timeframe"]], "family", "timeframe").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.bround(F.avg("score"), 1).alias("mean"))
    return agg


def session_report(results: DataFrame) -> DataFrame:
    """Runs, hall-of-fame size, best and mean score, accepted and rejected counts."""
    return results.agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("score") > 0).alias("hall_of_fame"),
                       F.max("score").alias("best_score"), F.avg("score").alias("mean_score"),
                       F.count_if(F.col("accepted")).alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))
