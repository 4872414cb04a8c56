from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barlab.functions import scoring
from barlab.operators import catalog, mlprep, performance as perf, periods, resampling as mc, validation as val
from barlab.operators.volatility import garch
from helpers import bars, frame, series

START, END = date(2023, 1, 1), date(2024, 1, 1)


def test_split_order_and_limits():
    parts = periods.split(START, END)
    assert [p.kind for p in parts] == ["train", "test", "gap", "oos"] and parts[-1].end == END
    assert all(a.end == b.start for a, b in zip(parts, parts[1:])) and (parts[2].end - parts[2].start).days == 5
    with pytest.raises(ValueError):
        periods.split(START, START + timedelta(days=30))


def test_folds_grow_and_windows_roll():
    folds = periods.expanding_folds(START, END, 5)
    sizes = [(p.end - p.start).days for p in folds if p.kind == "train"]
    assert len(sizes) == 5 and sizes == sorted(sizes) and len({(p.end - p.start).days for p in folds if p.kind == "test"}) == 1
    windows = periods.walk_forward(START, END, 90, 30, 30)
    assert windows and windows[-1].end <= END and len(periods.walk_forward(START, END, 60, 20, 20)) > len(windows)


def _results(spark, *rows):
    return spark.createDataFrame([("s", f"p{n}", *r) for n, r in enumerate(rows)], "strategy_id string, period string, kind string, profit double, trades int, winrate double, days int")


@pytest.mark.parametrize("train, test, verdict", [
    ((1000.0, 50, 0.55, 100), (800.0, 40, 0.52, 50), "robust"),
    ((5000.0, 100, 0.70, 100), (-500.0, 40, 0.35, 50), "overfitted"),
    ((100.0, 10, 0.60, 100), (50.0, 5, 0.50, 50), "insufficient_data")])
def test_overfit_verdicts(spark, train, test, verdict):
    row = val.overfit_report(_results(spark, ("train", *train), ("test", *test))).first()
    assert row["verdict"] == verdict


def test_sharpe_and_profit_factor(spark):
    rows = [("const", n, 10.0) for n in range(100)] + [("mixed", n, x) for n, x in enumerate((10.0, -2.0, 8.0, -1.0, 12.0, -3.0) * 20)] + [("factor", n, x) for n, x in enumerate((10.0, 10.0, 10.0, -5.0, -5.0))]
    out = {r["strategy_id"]: r for r in perf.summarise(spark.createDataFrame(rows, "strategy_id string, trade_no int, pnl double"), ["strategy_id"]).collect()}
    assert out["const"]["sharpe"] == 0 and out["mixed"]["sharpe"] > 0 and out["factor"]["profit_factor"] == 3.0


@pytest.mark.parametrize("train, test, oos, rob, adj", [(70.0, 60.0, 55.0, 57.1, 48.9), (90.0, 10.0, None, 18.9, 1.1)])
def test_robustness(spark, train, test, oos, rob, adj):
    df = spark.createDataFrame([(train, test, oos)], "a double, b double, c double")
    p, r, a = df.select(*scoring.robustness(F.col("a"), F.col("b"), F.col("c"))).first()
    assert round(r, 1) == rob and round(a, 1) == adj and p > 0


def test_drawdown_over_blocks(spark):
    pnl = [5.0, -3, 4, -10, 2, 8, -1, -1, 20, -4, -9, 3]
    df = spark.createDataFrame([("s", n, x) for n, x in enumerate(map(float, pnl))], "k string, n int, pnl double")
    eq, peak, worst = 0.0, 0.0, 0.0
    for x in pnl:
        eq += x
        peak = max(peak, eq)
        worst = max(worst, peak - eq)
    for block in (1, 3, 100):
        row = perf.max_drawdown(df, ["k"], F.floor(F.col("n") / block), ["n"]).first()
        assert row["max_drawdown"] == worst and row["final_equity"] == sum(pnl)


def test_resampling(spark, monkeypatch):
    monkeypatch.setattr(mc, "BLOCK", 16)
    trades = spark.createDataFrame([("s", n, 10.0 if n % 5 else -5.0) for n in range(100)], "strategy_id string, trade_no bigint, pnl double")
    idx = mc.indexed_trades(trades)
    perm = mc.permutation(idx, 30).toPandas()
    assert set(perm["final_equity"]) == {700.0} and perm["max_drawdown"].nunique() > 1 and (perm["max_drawdown"] >= 0).all()
    full = {r["test"]: r for r in mc.full_analysis(trades, 60).collect()}
    assert set(full) == {"permutation", "bootstrap", "noise"}
    assert full["bootstrap"]["significant"] == 1 and full["bootstrap"]["confidence"] > 0.9 and full["bootstrap"]["p5"] <= full["bootstrap"]["p50"] <= full["bootstrap"]["p95"]
    again = mc.bootstrap(idx.repartition(7), 30).toPandas().sort_values("rep")
    assert list(again["final_equity"]) == list(mc.bootstrap(idx, 30).toPandas().sort_values("rep")["final_equity"])


def test_score_bounds_and_parts(spark):
    names = ("trades", "profit", "winrate", "drawdown", "drawdown_pct", "sharpe", "profit_factor", "starting_capital", "ending_capital", "avg_win", "avg_loss", "degradation", "consistency")
    good = (120.0, 0.0, 0.6, 0.0, 0.0, 2.0, 1.5, 10000.0, 13000.0, 10.0, -5.0, 0.9, 0.8)
    none = (0.0,) * 13
    df = spark.createDataFrame([good, none], ", ".join(f"{n} double" for n in names))
    scores = [r[0] for r in df.select(scoring.strategy_score({n: F.col(n) for n in names})).collect()]
    assert scores == [18.0 + 15.0 + 7.5 + 10.0 + 10.0 + 10.0, 0.0]


def test_strategy_generation_is_reproducible_and_bounded():
    for family in catalog.FAMILIES:
        a, b = catalog.generate(family, "H1", 0), catalog.generate(family, "H1", 0)
        assert a == b and a.indicators and 20 <= a.stop_loss <= 70
        child = catalog.mutate(a, 1)
        assert [k for k, _ in child.indicators] == [k for k, _ in a.indicators] and child.stop_loss >= 5 and child.take_profit == int(child.stop_loss * child.risk_reward)
    x = catalog.crossover(catalog.generate("ichimoku", "H1", 0), catalog.generate("rsi_divergence", "H1", 0), 1)
    assert 1 <= len(x.indicators) <= 5 and len(catalog.FAMILIES) == 25
    assert 1 <= len(catalog.free_form("H1", 3).indicators) <= 5


def test_scaling_guards_zero_range(spark):
    df = spark.createDataFrame([("A", float(x), 7.0) for x in (1, 2, 3, 4, 100)], "symbol string, x double, y double")
    out = frame(mlprep.robust_scale(df, ["x", "y"], ["symbol"]), "x")
    assert list(out["x"]) == [-1.0, -0.5, 0.0, 0.5, 48.5] and set(out["y"]) == {0.0}


def test_group_selection_resumes(spark):
    rows = [("A", float(i % 2), float(i % 7), i % 2, "train" if i < 80 else "validation") for i in range(100)]
    df = spark.createDataFrame(rows, "symbol string, good double, noise double, label int, part string")
    groups = {"good": ["good"], "noise": ["noise"]}
    steps = mlprep.select_groups(df, groups, [])
    assert steps[0]["groups"] == ["good"] and steps[0]["accuracy"] == 1.0
    assert mlprep.select_groups(df, groups, [], done=steps) == steps


def test_garch_recurrence(spark):
    import math

    rows = series(400, 14)
    out = frame(garch(bars(spark, rows)))
    r = [math.log(b[6] / a[6]) for a, b in zip(rows, rows[1:])]
    mu = sum(r) / len(r)
    e = [x - mu for x in r]
    var = sum(x * x for x in e) / len(e)
    a, b = out["garch_alpha"].iloc[5], out["garch_beta"].iloc[5]
    s = var
    for i, got in enumerate(out["garch_volatility"][1:]):
        if i:
            s = var * (1 - a - b) + a * e[i - 1] ** 2 + b * s
        assert abs(got - math.sqrt(s)) < 1e-12
    assert frame(garch(bars(spark, series(100, 14))))["garch_volatility"].isna().all()


def test_supplier_results_shuffle_lines_before_summing(spark, monkeypatch):
    """Lines go to tasks of bounded size at once; a sum of nearly distinct keys before the shuffle would hold a whole split."""
    from barlab.catalog import validation_and_search as vs

    monkeypatch.setattr(vs, "TASK_ROWS", 500)
    plan = vs.supplier_results(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    lines = plan[plan.index("RepartitionByExpression") if "RepartitionByExpression" in plan else plan.index("REPARTITION_BY_NUM"):]
    assert "Aggregate" not in lines[: lines.index("lineitem")]
